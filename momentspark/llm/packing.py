"""Packing of documents into sequences (dealt operator 4): length patterns fitted by non-negative least squares.

Only the histogram of lengths (at most `capacity` numbers, at any size of corpus) comes to the driver. There, patterns
of a few documents that fill a sequence exactly are fitted to it: a pattern enters when it would lower the squared
misfit most (the best pattern of each largest length is found by a recurrence over lengths), the repeat counts of the
patterns in use are solved by least squares and kept at zero or above. Counts are rounded down; what then remains
of the histogram is packed largest first, each time with the largest lengths that still fit. The plan is a list of runs
(pattern, repeats), and each document finds its place in it by its length and its rank among documents of that length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, slices


def _best_patterns(worth: np.ndarray, capacity: int, most_docs: int, wanted: int) -> list[tuple[int, ...]]:
    """Of the patterns with exactly `capacity` tokens in 2 to `most_docs` documents, for each first length the one of
    the largest summed `worth`; the best of these that share no length."""
    value = np.where(np.isfinite(worth), worth, -np.inf)  # [length], -inf where there is none
    rest = np.arange(capacity + 1)[:, None] - np.arange(capacity + 1)[None, :]  # total - length
    levels, choice = [value], []
    for _ in range(most_docs - 2):
        total = np.where(rest > 0, levels[-1][np.maximum(rest, 0)], -np.inf) + value[None, :]
        pick = total.argmax(axis=1)
        choice.append(pick)
        levels.append(total[np.arange(capacity + 1), pick])
    found = []
    lengths = np.flatnonzero(np.isfinite(value[:capacity]))
    for first in lengths:
        options = [lv[capacity - first] for lv in levels]
        k = int(np.argmax(options))
        if np.isfinite(options[k]) and value[first] + options[k] > 1e-6:
            pattern, left = [int(first)], capacity - int(first)
            for j in range(k, 0, -1):
                pattern.append(int(choice[j - 1][left]))
                left -= pattern[-1]
            found.append((float(value[first] + options[k]), tuple(sorted([*pattern, left]))))
    out, taken = [], set()
    for _, p in sorted(set(found), reverse=True):
        if not taken & set(p):
            out.append(p)
            taken |= set(p)
            if len(out) == wanted:
                break
    return out


def fit_patterns(histogram: dict[int, int], capacity: int, most_docs: int = 6, rounds: int = 40) -> dict[tuple[int, ...], float]:
    """Patterns and repeat counts (zero or above) whose summed lengths come near the histogram in squares."""
    have = np.zeros(capacity + 1)
    for length, n in histogram.items():
        have[length] = n
    there = have > 0
    weight = (np.arange(capacity + 1) / capacity)  # of a length's misfit: long documents are harder to place later
    patterns: list[tuple[int, ...]] = [(capacity,)] if there[capacity] else []
    columns = [np.bincount(p, minlength=capacity + 1).astype(float) for p in patterns]
    x = np.array([have[capacity]] * len(patterns))
    for _ in range(rounds):
        misfit = have - (np.array(columns).T @ x if patterns else 0)
        new = [p for p in _best_patterns(np.where(there, misfit * weight**2, -np.inf), capacity, most_docs, 48) if p not in set(patterns)]
        if not new or np.abs(misfit).max() < 0.5:
            break
        patterns += new
        columns += [np.bincount(p, minlength=capacity + 1).astype(float) for p in new]
        x = np.concatenate([x, np.zeros(len(new))])
        while True:  # solve; while a count would be negative, go towards the solution as far as none is, and drop those at zero
            a = np.array(columns) * weight
            solved = np.linalg.solve(a @ a.T + 1e-7 * np.eye(len(a)), a @ (have * weight))
            if (solved >= 0).all():
                x = solved
                break
            low = solved < 0
            step = min(1.0, float((x[low] / np.maximum(x[low] - solved[low], 1e-12)).min()))
            x = x + step * (solved - x)
            keep = ~(low & (x <= 1e-9))
            if keep.all():
                keep[np.flatnonzero(low)[np.argmin(x[low])]] = False
            patterns, columns, x = [p for p, k in zip(patterns, keep, strict=True) if k], [c for c, k in zip(columns, keep, strict=True) if k], np.maximum(x[keep], 0)
            if not patterns:
                break
    return dict(zip(patterns, x.tolist(), strict=True))


def best_fit(left: np.ndarray, runs: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs that hold `left` (counts by length) as well: longest first, each into the sequence with the least room that takes it, else a new one.
    Sequences of one content are one run, so the work follows the number of lengths, not of items."""
    room: list[list[list]] = [[] for _ in range(capacity + 1)]
    for pattern, n in runs:
        room[capacity - sum(pattern)].append([pattern, n])
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            free = next((f for f in range(length, capacity + 1) if room[f]), None)
            fits = (free or capacity) // length
            pattern, bins = room[free].pop() if free is not None else ((), -(-n // fits))
            full = min(bins, n // fits)
            if full:
                room[(free or capacity) - fits * length].append([pattern + (length,) * fits, full])
                n -= full * fits
            if full < bins and n:  # the last few: less than one sequence takes
                room[(free or capacity) - n * length].append([pattern + (length,) * n, 1])
                full, n = full + 1, 0
            if full < bins and pattern:
                room[free].append([pattern, bins - full])
    return [(pattern, n) for some in room for pattern, n in some]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence, repeats) that use up the histogram: the fitted patterns, what they leave packed into their room or into
    sequences of its own, or, where that takes fewer sequences, all of it by best fit."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left, runs = counts.copy(), []

    def take(pattern: tuple[int, ...], wanted: int | None) -> None:
        lengths, times = np.unique(pattern, return_counts=True)
        n = int((left[lengths] // times).min())
        n = n if wanted is None else min(n, wanted)
        if n > 0:
            left[lengths] -= n * times
            runs.append((pattern, n))

    for pattern, x in sorted(fit_patterns(histogram, capacity).items(), key=lambda i: (-i[1], i[0])):
        take(pattern, int(x + 1e-6))
    opened = best_fit(left, runs, capacity)
    while left.any():
        free, pattern, used = capacity, [], left.copy()
        while free > 0:
            fits = np.flatnonzero(used[: free + 1])
            if not len(fits):
                break
            pattern.append(int(fits[-1]))
            used[fits[-1]] -= 1
            free -= int(fits[-1])
        take(tuple(pattern), None)
    return min((runs, opened, best_fit(counts, [], capacity)), key=lambda r: sum(n for _, n in r))


def _places(runs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): by run and slot, sorted, for ranks from that first one on."""
    rows, rank, sequence = [], {}, 0
    for pattern, n in runs:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, definition: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes each text, appends `end_id` and cuts it: (id_col, piece int, start long, length long, ids_crc32 long[, ids array<int>]).

    A document of more than `capacity` ids is cut so that all its pieces but the first are full. Null texts count as
    empty: one piece that holds the end id. Each row is one document, whether or not its id is null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = np.array([end_id], dtype="<i4")

    def run(batches):
        enc = encoder(shared.value)
        for b in slices(batches, "t"):
            all_ids, at = enc.lists(b.column("t"))
            packed = memoryview(all_ids.tobytes())
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, (first, last) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                n = last - first + 1
                cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    checked = zlib.crc32(packed[4 * (first + a) : 4 * min(first + z, last)])
                    crc.append(zlib.crc32(end, checked) if z == n else checked)
                    if with_ids:
                        own = all_ids[first + a : min(first + z, last)]
                        ids.append(np.append(own, end) if z == n else own)
            cols = [b.column("i").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            yield pa.record_batch(cols + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=["i", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    more = ", ids array<int>" if with_ids else ""
    return slim.mapInArrow(run, f"i {slim.schema['i'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long{more}").withColumnRenamed("i", id_col)


def pack(items: DataFrame, capacity: int = 1024, length_col: str = "length") -> DataFrame:
    """Adds `sequence_id` (long, from 0) and `offset` (long, place in the sequence) to `items`, whose lengths lie in 1 to
    `capacity`. Other columns are kept as they are, whatever their names; ones named like the two are replaced. An empty table gives an empty one.

    Ranks among items of a length are taken in hash buckets of about 5,000 rows and shifted by the counts of the
    buckets before, so that no length, however common, meets in one task.
    """
    spark, scratch = items.sparkSession, Scratch(items.sparkSession, "packing")
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    rows = scratch.write(items.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("item"), F.col(length_col).cast("long").alias("length"), F.monotonically_increasing_id().alias("row")), "items")
    buckets = max(64, -(-rows.count() // 5000))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = scratch.write(rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    if None in histogram or (histogram and not 1 <= min(histogram) <= max(histogram) <= capacity):
        raise ValueError(f"lengths {sorted(histogram, key=lambda x: x or 0)[:1]} to {sorted(histogram, key=lambda x: x or 0)[-1:]} do not fit in 1 to {capacity}")
    table = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(shift, ["length", "bucket"]).select("item", "length", (F.col("rank") + F.col("shift")).cast("long").alias("rank"))

    def run(batches):
        places = table.value
        keys = places[:, 0] * (1 << 50) + places[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = places[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1] if len(rank) else places[:0]
            yield pa.record_batch([b.column("item"), pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], names=["item", "sequence_id", "offset"])

    schema = ranked.select("item").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema).select(*(F.col("item")[c].alias(c) for c in kept), "sequence_id", "offset")
