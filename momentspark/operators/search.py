"""Vector search over a table of queries: exact top-M, neighbour-sum rerank, weighted fusion, discovery.

vectors: model, name, video, pos (place in its video), vec. queries: query_id, model, qvec. Scores are rounded to
six places before they are ranked, and ties go by name, so that results do not depend on the order of additions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentspark.functions.vectors import dot, readable

DIGITS = 6


SLICE = 512  # vectors in one matrix product
HELD = 6_000_000  # hits that a block holds at most, of 20 bytes each
BEST = "query_id long, model string, name string, video string, pos long, score double, near double, n_near int"


def neighbor_sums(vectors: DataFrame, reach: int = 3) -> DataFrame:
    """Adds near (sum of the vectors up to `reach` places away in the same video, itself excluded) and n_near (how many there are, of its own length)."""
    w = Window.partitionBy("model", "video").orderBy("pos").rangeBetween(-reach, reach)
    v = vectors.where(readable(F.col("vec"))).withColumn("_all", F.collect_list(F.struct("pos", "vec")).over(w))
    others = F.transform(F.filter("_all", lambda x: (x["pos"] != F.col("pos")) & (F.size(x["vec"]) == F.size("vec"))), lambda x: x["vec"])
    zero = F.transform("vec", lambda _: F.lit(0.0))
    v = v.withColumn("_all", others)
    return v.withColumn("near", F.aggregate("_all", zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b.cast("double")))).withColumn("n_near", F.size("_all")).drop("_all")


def _room(m: int) -> tuple[int, int]:
    """For a query: how many hits wait until it is cut to its m best, and how many there can be after one more slice."""
    return m + max(64, m // 4), m + max(64, m // 4) + SLICE


class _Best:
    """The m best vectors of each query of a block, while vectors come in the order that decides ties: a tie is won by the one that came first.

    Each query has a row of hits in the order they came in; a row that fills is cut to its m best, so what is held does not grow with what was met.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, m: int):
        self.ids, self.q, self.m = ids, q, m
        self.least = np.full(len(ids), -np.inf)  # a query's m-th score so far
        self.limit, most = _room(m)
        self.n = np.zeros(len(ids), dtype=np.int64)  # hits of a query; the rest of its row is -inf
        self.score, self.at, self.sums = np.full((len(ids), most), -np.inf), np.zeros((len(ids), most), dtype=np.int32), None

    def meet(self, v: np.ndarray, at: np.ndarray, near: np.ndarray | None) -> None:
        """v: up to SLICE vectors, `at` their numbers."""
        if near is not None and self.sums is None:
            self.sums = np.zeros(self.score.shape)
        for k in range(0, len(self.ids), 256):
            self._meet(k, min(k + 256, len(self.ids)), v, at, near)

    def _meet(self, lo: int, hi: int, v: np.ndarray, at: np.ndarray, near: np.ndarray | None) -> None:
        s, least = self.q[lo:hi] @ v.T, self.least[lo:hi]
        if s.shape[1] > self.m and not self.n[lo:hi].any():  # nothing is ruled out yet: the slice's own m-th score
            least = np.partition(s, s.shape[1] - self.m, axis=1)[:, s.shape[1] - self.m]
        qi, vi = np.nonzero(s > (least - 10.0**-DIGITS)[:, None])
        score = np.round(s[qi, vi], DIGITS)
        on = score > self.least[lo + qi]
        qi, vi, score = qi[on], vi[on], score[on]
        times = np.bincount(qi, minlength=hi - lo)
        row, column = lo + qi, self.n[lo + qi] + np.arange(len(qi)) - np.repeat(np.cumsum(times) - times, times)
        self.score[row, column], self.at[row, column] = score, at[vi]
        for k in range(0, len(qi) if near is not None else 0, 10_000):
            some = slice(k, k + 10_000)
            self.sums[row[some], column[some]] = np.einsum("ij,ij->i", self.q[row[some]], near[vi[some]])
        self.n[lo:hi] += times
        self._cut(lo + np.flatnonzero(self.n[lo:hi] > self.limit))

    def _cut(self, rows: np.ndarray) -> None:
        """Leaves the m best of rows that hold more, in the order they came in; of equal ones the first."""
        m, step = self.m, max(1, 200_000 // self.score.shape[1])
        for few in (rows[k : k + step] for k in range(0, len(rows), step)):
            s = self.score[few]
            least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
            above, equal = s > least[:, None], s == least[:, None]
            keep = above | equal & (np.cumsum(equal, axis=1) <= (m - above.sum(axis=1))[:, None])
            for held in (self.score, self.at, self.sums):
                if held is not None:
                    held[few, :m] = held[few][keep].reshape(len(few), m)
            self.score[few, m:] = -np.inf
            self.n[few], self.least[few] = m, least

    def settle(self) -> None:
        self._cut(np.flatnonzero(self.n > self.m))

    def rows(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """After `settle`, of queries lo to hi - 1 their places in the block, the vectors' numbers, scores and sums; the best first."""
        qi, column = np.nonzero(self.score[lo:hi, : self.m] > -np.inf)
        qi += lo
        at, score, sums = (np.zeros(0) if held is None else held[qi, column] for held in (self.at, self.score, self.sums))
        order = np.lexsort((at, -score, qi))
        return qi[order], at[order], score[order], sums[order] if len(sums) else sums

    @property
    def kept(self) -> tuple[np.ndarray, ...]:
        return self.rows(0, len(self.ids))


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """From a length to the rows of that length and their matrix."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(n):
        rows = np.flatnonzero(n == size)
        part = column if len(rows) == len(n) else column.take(pa.array(rows))
        out[int(size)] = rows, part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    return out


def top_m(vectors: DataFrame, queries: DataFrame, m: int = 50, size: int = 2000, summed: bool = False, tie: str = "name") -> DataFrame:
    """The m best rows of each (query, model): query_id, model, name, video, pos, score, rank; with `summed` also near and n_near of `rerank`.

    Queries of a model are dealt into blocks of about `size`, vectors into parts; each block meets each part in one stream of vectors, sorted by Spark,
    which meet the block in matrix products of `SLICE` vectors and leave the m best of each query. The parts are then merged by rank. A
    task holds a block (with a greater m a smaller one), at most `HELD` hits of it, the names of its part and one slice, whatever the number of vectors; the score
    matrix never exists, and neither side is broadcast or collected.
    Vectors that cannot be read (null, empty, not finite) are found by no query, and a query meets only vectors of its own length. Ties go by the
    column `tie` (name or pos).
    """
    vectors, queries = vectors.where(readable(F.col("vec"))), queries.where(readable(F.col("qvec")))
    per_part = max(50_000, min(500 * m, 1_000_000))  # a part gives up to m rows a query: parts are much larger than that
    size = max(1, min(size, HELD // _room(m)[1]))
    vectors = neighbor_sums(vectors) if summed else vectors.withColumn("near", F.lit(None).cast("array<double>")).withColumn("n_near", F.lit(0))
    ceil = lambda n: F.ceil(F.count(F.lit(1)) / n).cast("int")
    models = queries.groupBy("model").agg(ceil(size).alias("blocks")).join(vectors.groupBy("model").agg(ceil(per_part).alias("parts")), "model")
    models = F.broadcast(models)  # a row for each model
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["model", "part", "block"]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("video", "string"), ("pos", "long"))]
    q = queries.join(models, "model").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", every("parts"))
    q = q.select(*key, F.lit(0).alias("kind"), F.col("query_id").cast("long").alias("query_id"), *nothing, F.col("qvec").alias("vec"), F.lit(None).cast("array<double>").alias("near"), F.lit(0).alias("n_near"))
    v = vectors.join(models, "model").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")).withColumn("block", every("blocks"))
    v = v.select(*key, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("query_id"), "name", "video", F.col("pos").cast("long").alias("pos"), "vec", "near", "n_near")

    def product(batches):
        now, ids, found, seen, n_seen = None, {}, {}, [], 0

        def done():
            rows = pa.Table.from_batches(seen).combine_chunks() if seen else None
            seen.clear()
            step = max(1, 20_000 // m)
            for best in found.values():
                best.settle()
                for k in range(0, len(best.ids), step):
                    qi, at, score, sums = best.rows(k, k + step)
                    t = rows.take(pa.array(at)).combine_chunks()
                    near = pa.array(np.round(sums, DIGITS)) if summed else pa.nulls(len(qi), pa.float64())
                    yield from pa.table([pa.array(best.ids[qi]), pa.array([now[0]] * len(qi), pa.string()), t["name"], t["video"], t["pos"], pa.array(score), near, t["n_near"]], names=NAMES).to_batches()

        for whole in batches:
            keys = list(zip(*(whole.column(c).to_pylist() for c in key), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if keys[lo] != now:
                    yield from done()
                    now, ids, found, seen, n_seen = keys[lo], {}, {}, [], 0
                b = whole.slice(lo, hi - lo)
                n_q = int((b.column("kind").to_numpy() == 0).sum())
                if n_q:
                    asked = b.slice(0, n_q)
                    for n, (rows, x) in _vectors(asked.column("vec")).items():
                        ids.setdefault(n, []).append((asked.column("query_id").to_numpy()[rows], x))
                for at in range(n_q, b.num_rows, SLICE):
                    part = b.slice(at, min(SLICE, b.num_rows - at))
                    found = found or {n: _Best(np.concatenate([i for i, _ in x]), np.concatenate([y for _, y in x]), m) for n, x in ids.items()}
                    for n, (rows, x) in _vectors(part.column("vec")).items():
                        if n in found:
                            found[n].meet(x, rows + n_seen, _vectors(part.column("near").take(pa.array(rows)))[n][1] if summed else None)
                    n_seen += part.num_rows
                if n_q < b.num_rows:  # a copy: a slice would hold its batch with all vectors
                    seen.append(b.select(["name", "video", "pos", "n_near"]).take(pa.array(np.arange(n_q, b.num_rows))))
        yield from done()

    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    stream = q.union(v).repartition(tasks, *key).sortWithinPartitions(*key, "kind", tie)
    scored = stream.mapInArrow(product, BEST).repartition("query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "model").orderBy(F.desc("score"), tie))
    return (scored if summed else scored.drop("near", "n_near")).withColumn("rank", rank).where(F.col("rank") <= m)


NAMES = [c.split()[0] for c in BEST.split(", ")]


def top_reranked(vectors: DataFrame, queries: DataFrame, m: int = 50) -> DataFrame:
    """`rerank` of `top_m` without a join: sums of neighbouring vectors go along with the vectors, and only the m best of a query are reranked."""
    hits = top_m(vectors, queries, m, summed=True).select("query_id", "model", "name", "video", "pos", F.col("score").alias("raw_score"), F.col("near").alias("score"), F.col("n_near").cast("long").alias("n_neighbors"))
    rank = F.row_number().over(Window.partitionBy("query_id", "model").orderBy(F.desc("score"), F.desc("raw_score"), "name"))
    return hits.withColumn("rank", rank)


def rerank(hits: DataFrame, vectors: DataFrame, queries: DataFrame, reach: int = 3) -> DataFrame:
    """Each hit's score becomes the sum of its neighbours' inner products (up to `reach` places away, itself excluded).

    Missing neighbours are skipped; a hit without any stays, with score 0. Adds n_neighbors and raw_score; ranks anew.
    """
    steps = F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d])
    asked = hits.select("query_id", "model", "name", "video", "pos", F.col("score").alias("raw_score"), F.explode(steps).alias("step")).withColumn("at", F.col("pos") + F.col("step"))
    there = vectors.where(readable(F.col("vec"))).select("model", "video", F.col("pos").alias("at"), "vec")
    joined = asked.join(there, ["model", "video", "at"], "left").join(queries, ["query_id", "model"]).withColumn("vec", F.when(F.size("vec") == F.size("qvec"), F.col("vec")))
    sums = joined.groupBy("query_id", "model", "name", "video", "pos", "raw_score").agg(F.round(F.coalesce(F.sum(dot(F.col("qvec"), F.col("vec"))), F.lit(0.0)), DIGITS).alias("score"), F.count("vec").alias("n_neighbors"))
    rank = F.row_number().over(Window.partitionBy("query_id", "model").orderBy(F.desc("score"), F.desc("raw_score"), "name"))
    return sums.withColumn("rank", rank)


def fuse(hits: DataFrame, weights: dict[str, float], k: int = 100, groups: list[str] | None = None) -> DataFrame:
    """Max-normalised weighted sum over the models that have hits: query_id, name, video, distance (0-100), routes, n_routes, rank.

    With `groups` only videos of those stay (`in_groups`): the maxima are those of the unscoped pool, and the `k` best are taken of what is left.
    """
    weight_of = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    weight = lambda model: F.coalesce(weight_of[model], F.lit(0.5))
    by_model, by_query = Window.partitionBy("query_id", "model"), Window.partitionBy("query_id")
    h = hits.withColumn("top", F.max("score").over(by_model)).withColumn("total", F.aggregate(F.array_sort(F.collect_set("model").over(by_query)), F.lit(0.0), lambda s, x: s + weight(x)))
    h = h.withColumn("share", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")) * weight(F.col("model")))
    h = in_groups(h, groups) if groups else h
    routes = F.array_sort(F.collect_list(F.struct("model", F.col("rank").alias("rank"), "score")))
    out = h.groupBy("query_id", "name", "video").agg(F.sum("share").alias("share"), routes.alias("routes"), F.max("total").alias("total"))
    out = out.withColumn("distance", F.round(100 * F.col("share") / F.col("total"), DIGITS)).withColumn("n_routes", F.size("routes"))
    rank = F.row_number().over(by_query.orderBy(F.desc("distance"), "name"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "name", "video", "distance", "routes", "n_routes", "rank")


def ensemble_search(vectors: DataFrame, queries: DataFrame, weights: dict[str, float], k: int = 100, m: int = 50, use_rerank: bool = True, groups: list[str] | None = None) -> DataFrame:
    """Search by every model of `weights` that has vectors, rerank, fuse. With `groups` at least 2,000 hits a model are looked at before the
    scope is applied, so that it is filled from beyond the first `m`."""
    m = max(m, 2000) if groups else m
    models = list(weights)
    v, q = vectors.where(F.col("model").isin(models)), queries.where(F.col("model").isin(models))
    return fuse((top_reranked if use_rerank else top_m)(v, q, m), weights, k, groups)


def in_groups(results: DataFrame, groups: list[str], known: tuple[str, ...] = ("K", "L", "M", "N", "S")) -> DataFrame:
    """Results whose video starts with one of the groups. Applied after fusion: the maxima are those of the unscoped pool."""
    wanted = sorted({g.strip().upper() for g in groups})
    if unknown := set(wanted) - set(known):
        raise ValueError(f"unknown groups {sorted(unknown)}")
    return results.where(F.upper(F.substring("video", 1, 1)).isin(wanted)) if wanted else results


def discover_videos(hits: DataFrame, min_score: float = 0.1, part: str = "query_id", group: str = "group_id") -> DataFrame:
    """Videos by the number of query parts that hit them: group, video, anchor_name, frequency, score_sum, rank.

    hits: group, part, video, name, score. A part counts once for a video, with its best frame there.
    """
    best = F.row_number().over(Window.partitionBy(group, part, "video").orderBy(F.desc("score"), "name"))
    first = hits.where(F.col("score") >= min_score).withColumn("k", best).where("k = 1")
    out = first.groupBy(group, "video").agg(F.count(F.lit(1)).alias("frequency"), F.round(F.sum("score"), 4).alias("score_sum"), F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("top"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("frequency"), F.desc("score_sum"), "video"))
    return out.select(group, "video", F.col("top.name").alias("anchor_name"), "frequency", "score_sum").withColumn("rank", rank)


def one_per_video(results: DataFrame, score: str = "distance") -> DataFrame:
    """One card for each (query, video): the best frame (NaN worst, earlier rank on ties), count and members in order of rank."""
    key = F.coalesce("video", "name")
    worth = F.struct(F.nanvl(F.col(score).cast("double"), F.lit(float("-inf"))).alias("s"), (-F.col("rank")).alias("r"))
    out = results.groupBy("query_id", key.alias("card")).agg(F.max_by("name", worth).alias("name"), F.max(F.col(score)).alias(score), F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("members"))
    return out


def percent_of_set(results: DataFrame, score: str = "distance") -> DataFrame:
    """Adds percent: the score between the least and the greatest of its query, 0 to 100; 100 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return results.withColumn("percent", F.when(high > low, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (F.col(score) - low) / (high - low)))).otherwise(100.0))
