"""Embedding near-duplicates (dealt operator 10): lattice hashing into E8 cells, cosines verified in double precision.

Vectors are brought to unit length. In each of several tables a fixed random projection to eight dimensions is decoded to
the nearest point of the lattice E8, whose cell is the bucket. A vector is stored in its own cell and also looks into the
neighbouring cells whose centres are nearest to it. Vectors that meet in a cell are compared in blocks.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, block_pairs, whole_groups
from .components import components


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.vstack([out, signs[(signs < 0).sum(axis=1) % 2 == 0] / 2])


NEAR = _minimal_vectors()


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: where the sum is odd, the worst rounding goes the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    gap = x[odd] - r[odd]
    worst = np.abs(gap).argmax(axis=1)
    r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points of rows of eight numbers: E8 is D8 and D8 shifted by one half."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _mix(cells: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit number of each lattice point (its doubled coordinates are integers) and table."""
    h = np.full(len(cells), table * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
    for k in range(8):
        h ^= (2 * cells[:, k]).astype(np.int64).view(np.uint64)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Grid(NamedTuple):
    """Ten tables with two probes found 99 % of pairs at a cosine of 0.95 and all at 0.98 (simulated, 64 dimensions).

    A wider cell finds more and compares more: at width 1 two unrelated vectors share a table's cells in 1 of 6,000 cases.
    """

    tables: int = 10
    probes: int = 2
    width: float = 1.0
    seed: int = 7


def cells(unit: np.ndarray, grid: Grid) -> np.ndarray:
    """[table, 1 + probes, row]: the bucket of each unit vector's own cell, and of the neighbours it looks into."""
    tables, probes, width, seed = grid
    rng = np.random.default_rng(seed)
    out = np.empty((tables, 1 + probes, len(unit)), dtype=np.int64)
    for t in range(tables):
        x = unit @ rng.standard_normal((unit.shape[1], 8)) / width
        own = decode_e8(x)
        out[t, 0] = _mix(own, t)
        if probes:
            nearest = np.argpartition(-((x - own) @ NEAR.T), probes - 1, axis=1)[:, :probes]
            for p in range(probes):
                out[t, 1 + p] = _mix(own + NEAR[nearest[:, p]], t)
    return out


def unit_rows(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors in double precision) for each length of vector that occurs; none may be zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    at = vectors.offsets.to_numpy()
    flat, n = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(at)
    out = []
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        x = flat[at[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def _first_meetings(codes: np.ndarray, table: np.ndarray, looks: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Which pairs (a, b: rows of this chunk; `where`: columns of codes) meet here and in no table, nor cell, before.

    In one table two vectors of unlike cells may meet twice, each looking into the other's: then the cell of the smaller id counts.
    """
    t, i, j = table[a], where[a], where[b]
    first = np.ones(len(a), dtype=bool)
    for m in range(codes.shape[0]):
        later = np.flatnonzero((t > m) & first)
        if len(later):
            x, y = i[later], j[later]
            met = (codes[m, 0, x] == codes[m, 0, y]) | (codes[m, 1:, x] == codes[m, 0, y][:, None]).any(axis=1) | (codes[m, 1:, y] == codes[m, 0, x][:, None]).any(axis=1)
            first[later[met]] = False
    mixed = np.flatnonzero(first & (looks[a] != looks[b]))
    looker, stored = np.where(looks[a[mixed]], a[mixed], b[mixed]), np.where(looks[a[mixed]], b[mixed], a[mixed])
    at = table[looker]
    both = (codes[at, 1:, where[stored]] == codes[at, 0, where[looker]][:, None]).any(axis=1)
    first[mixed[both & (ids[stored] > ids[looker])]] = False
    return first


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.95, grid: Grid = Grid(), id_col: str = "vec_id", vec_col: str = "embedding", most: int = 1000) -> DataFrame:
    """One row (id_col, n_links long, component_id, kept boolean) for each row of `vectors`.

    n_links: other rows found with a cosine of `least_cosine` or more; component_id: the smallest id that links reach; kept: the
    row has that id. Equal vectors are gathered into one class first, which counts as many rows as it has. Vectors that are null,
    empty, zero or hold a null or non-finite number link with nothing and are kept; vectors of unlike lengths are not compared.
    Repeated ids keep their rows; a null id takes part, is no component_id where another id is, and is not kept. Other columns are
    ignored. An empty table gives an empty one. A cell of more than `most` rows is compared in stripe pairs (`block_pairs`); a task
    returns sums and spanning links, never all pairs.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "lattice")
    good = F.expr("coalesce(size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0), false)")
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).withColumn("good", good)
    usable = slim.where("good").select("id", "v")
    classes = usable.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).withColumn("cls", F.monotonically_increasing_id())
    classes = scratch.write(classes, "classes")
    item = classes.schema["v"].dataType.simpleString()

    def deal(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                v = pa.concat_arrays([b.column("v")])
                for rows, unit in unit_rows(pa.ListArray.from_arrays(pa.array(v.offsets.to_numpy() - v.offsets[0].as_py(), pa.int32()), v.flatten())):
                    codes = cells(unit, grid)
                    t, p, k = (x.ravel() for x in np.indices(codes.shape))
                    take = pa.array(rows[k])
                    yield pa.record_batch([pa.array(codes.ravel()), pa.array(t.astype(np.int32)), pa.array(p > 0), *(b.column(c).take(take) for c in ("cls", "n", "v"))], names=["cell", "t", "looks", "cls", "n", "v"])

    dealt = classes.select("cls", "n", "v").mapInArrow(deal, f"cell long, t int, looks boolean, cls long, n long, v {item}")
    blocks = block_pairs(dealt, "cell", "cls", most).repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")

    def compare(batches):
        for chunk, at in whole_groups(batches, ["cell", "lo", "hi"]):
            ends = np.append(at[1:], len(chunk))
            cls, n, t, lo, hi, own = (chunk.column(c).to_numpy() for c in ("cls", "n", "t", "lo", "hi", "own"))
            looks = np.asarray(chunk.column("looks"), dtype=bool)
            several = [(s, e) for s, e in zip(at[ends - at > 1], ends[ends - at > 1], strict=True) if not looks[s:e].all()]
            if not several:
                continue
            left, right = [], []
            for rows, unit in unit_rows(chunk.column("v")):
                place = np.full(len(chunk), -1)
                place[rows] = np.arange(len(rows))
                pairs = []
                for s, e in several:
                    g = np.arange(s, e)[place[s:e] >= 0]
                    if len(g) < 2:
                        continue
                    a, b = (g, g) if lo[s] == hi[s] else (g[own[g] == lo[s]], g[own[g] == hi[s]])
                    x, y = np.nonzero(unit[place[a]] @ unit[place[b]].T >= least_cosine)
                    x, y = a[x], b[y]
                    ok = (~looks[x] | ~looks[y]) & (cls[x] != cls[y])
                    if lo[s] == hi[s]:
                        ok &= x < y
                    if ok.any():
                        pairs.append((x[ok], y[ok]))
                if pairs:
                    a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
                    rows_met = np.unique(np.concatenate([a, b]))
                    where = np.full(len(chunk), -1)
                    where[rows_met] = np.arange(len(rows_met))
                    first = _first_meetings(cells(unit[place[rows_met]], grid), t, looks, a, b, cls, where)
                    left.append(a[first])
                    right.append(b[first])
            if not left:
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            parent: dict[int, int] = {}
            links = []

            def top(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            ids, inverse = np.unique(cls[np.concatenate([a, b])], return_inverse=True)
            total = np.zeros(len(ids), dtype=np.int64)
            np.add.at(total, inverse, n[np.concatenate([b, a])])
            for x, y in zip(cls[a].tolist(), cls[b].tolist(), strict=True):
                if (p := top(x)) != (q := top(y)):
                    parent[q] = p
                    links.append((x, y))
            pa_links = np.array(links, dtype=np.int64).reshape(-1, 2)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.record_batch([pa.array(np.concatenate([ids, pa_links[:, 0]])), pa.concat_arrays([none, pa.array(pa_links[:, 1])]), pa.array(np.concatenate([total, np.zeros(len(links), dtype=np.int64)]))], names=["a", "b", "links"])

    found = scratch.write(blocks.select("cell", "lo", "hi", "own", "t", "looks", "cls", "n", "v").mapInArrow(compare, "a long, b long, links long"), "found")
    joined = components(found.where("b is not null").select("a", "b"), scratch)
    sums = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    named = classes.select("cls", "least", "n").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("top", F.coalesce("component", "cls"))
    named = scratch.write(named.select("cls", "least", "n", "top"), "tops")
    smallest = named.groupBy("top").agg(F.min("least").alias("component_id"))
    per_class = named.join(smallest, "top").join(sums, "cls", "left").select("cls", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per_class = scratch.write(classes.select("cls", "v").join(per_class, "cls").select("v", "component_id", "n_links"), "named")
    alone = slim.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = usable.join(per_class, "v").select("id", "n_links", "component_id").union(alone)
    return rows.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
