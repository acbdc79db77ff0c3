"""Centroid clustering (dealt operator 13): k-means on whole numbers, with the nearest centroid found by the threshold algorithm.

Each dimension has the list of centroids in order of their value there. From a vector's own value every list is walked outward, one
centroid a step; what is met for the first time is measured exactly. No centroid unmet so far can be nearer than the sum of squares
of the distances to the lists' next entries, so a vector is done when that sum strictly exceeds its best distance (strictly: an unmet
centroid may tie and have a smaller number). Centroids (k x dimensions numbers) go to the tasks, sums of a task for each centroid go
back through one aggregation; vectors stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Whole components are held within this on either side, so that distances of 64 dimensions fit a long.
LARGEST = 2**27


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For int64 rows of `vectors`, the number of the nearest row of `centroids` (ties: the smaller one) and the squared distance."""
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    n = len(vectors)
    right = np.stack([np.searchsorted(values[:, d], vectors[:, d]) for d in range(dims)], axis=1) if n else np.zeros((0, dims), dtype=np.int64)
    left = right - 1
    met = np.zeros((n, k), dtype=bool)
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    live, axis = np.arange(n), np.arange(dims)
    while len(live):
        x, lo, hi = vectors[live], left[live], right[live]
        down, up = x - values[np.maximum(lo, 0), axis], values[np.minimum(hi, k - 1), axis] - x
        go_down = (lo >= 0) & ((hi >= k) | (down <= up))
        chosen = order[np.where(go_down, lo, hi), axis]
        lo, hi = lo - go_down, hi + ~go_down
        left[live], right[live] = lo, hi
        new = np.zeros((len(live), k), dtype=bool)
        np.put_along_axis(new, chosen, True, axis=1)
        new &= ~met[live]
        met[live] |= new
        row, c = np.nonzero(new)
        exact = np.full((len(live), k), np.iinfo(np.int64).max)
        exact[row, c] = ((x[row] - centroids[c]) ** 2).sum(axis=1)
        number = exact.argmin(axis=1)  # the first of equal ones
        least = exact[np.arange(len(live)), number]
        better = (least < best[live]) | ((least == best[live]) & (number < who[live]))
        best[live[better]], who[live[better]] = least[better], number[better]
        down, up = x - values[np.maximum(lo, 0), axis], values[np.minimum(hi, k - 1), axis] - x
        frontier = np.where((lo >= 0) & ((hi >= k) | (down <= up)), down, up)
        over = ((lo < 0) & (hi >= k)).any(axis=1)  # a list walked to both ends: every centroid has been met
        live = live[~(over | ((frontier**2).sum(axis=1) > best[live]))]
    return who, best


def whole(embedding: Column) -> Column:
    """floor(256 * x) of each component, x as a double; beyond 2^27 on either side that bound."""
    return F.transform(embedding, lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-LARGEST / 256)), F.lit(LARGEST / 256)) * 256).cast("bigint"))


def _blocks(batch: pa.RecordBatch, dims: int, most: int = 1024) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, most):
        part = batch.slice(at, most)
        yield part, part.column("v").flatten().to_numpy().reshape(part.num_rows, dims)


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors: their number and the sums of their components (k rows of the driver's)."""
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            for _, x in _blocks(batch, dims):
                who, _ = nearest(x, centroids)
                np.add.at(total, who, np.column_stack([np.ones(len(x), dtype=np.int64), x]))
        had = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(had.astype(np.int32)), *(pa.array(total[had, d]) for d in range(dims + 1))], ["cluster", *(f"s{d}" for d in range(dims + 1))])

    schema = "cluster int, " + ", ".join(f"s{d} bigint" for d in range(dims + 1))
    summed = rows.select("v").mapInArrow(partial, schema).groupBy("cluster").agg(*(F.sum(F.col(f"s{d}").cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims + 1)))
    return {r[0]: (int(r[1]), [int(x) for x in r[2:]]) for r in summed.collect()}


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256) for each vector of exactly `dims`
    finite components; others are left out.

    Centroids 0, 1, ... start as the k vectors with the smallest hex sha256 of `<seed>:<id>` (null ids last; ties: by components; fewer
    vectors: as many). In each round every vector goes to its nearest centroid (ties: the smaller number), then a centroid becomes the
    componentwise floor of its vectors' mean, an empty one stays. Repeated rows count each time. Sums of distances that do not fit
    a long are given as the largest long. An empty table gives an empty one. Other columns are ignored.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "centroids")
    fits = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & F.coalesce(fits, F.lit(False)))
    rows = scratch.write(kept.select(F.col(id_col).alias("id"), whole(F.col(vector_col)).alias("v")), "whole")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    schema = f"{id_col} {dict(rows.dtypes)['id']}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        for c, (n, sums) in _sums(rows, centroids).items():
            centroids[c] = [s // n for s in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, dims):
                who, distance = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(who.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    found = scratch.write(rows.mapInArrow(assign, f"id {dict(rows.dtypes)['id']}, cluster int, distance bigint"), "assigned")
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fit = lambda n: min(n, 2**63 - 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    each = [fit(inertia.get(c, 0)) for c in range(len(centroids))]
    return found.select(F.col("id").alias(id_col), "cluster", "distance", of(each, "bigint").alias("cluster_inertia"), F.lit(fit(sum(inertia.values()))).cast("bigint").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def _nearest_sql(v: str, c: str) -> str:
    return f"""SELECT v.vec_id, v.v, arg_min(c.cluster, (c.d, c.cluster)) AS cluster, min(c.d) AS distance FROM {v} v, LATERAL (
      SELECT c.cluster, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM {c} c) c GROUP BY v.vec_id, v.v"""


def oracle_sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    """For tables whose ids are all there and differ."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {dims} AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, v AS c FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({_nearest_sql('v', f'c{r}')}),
      m{r} AS (SELECT cluster, list(f ORDER BY i) AS c FROM (SELECT cluster, i, (CASE WHEN sum(x) < 0 THEN -((-sum(x) + count(*) - 1) // count(*)) ELSE sum(x) // count(*) END)::BIGINT AS f FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
      c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""WITH {", ".join(steps)}, a AS ({_nearest_sql('v', f'c{rounds}')})
      SELECT a.vec_id, a.cluster::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
      FROM a JOIN c{rounds} c USING (cluster)"""


ORACLE_SQL = oracle_sql()
