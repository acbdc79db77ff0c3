"""Shared helpers: tables, scratch tables in the cluster's shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentspark.sources.scratch import Scratch, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that a slice holds about `most_bytes` of text, or one longer text alone."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        part = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // most_bytes if len(sizes) else sizes
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
            yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()  # workers live on after a task


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by `keys`: tables that hold whole groups only, with the positions where groups start.

    What waits for the next batch is one group, so memory follows the largest group and the batch size.
    """
    rest: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), dtype=bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        at = starts(t)
        rest = t.slice(at[-1])
        if len(at) > 1:
            yield t.slice(0, at[-1]), at[:-1]
    if rest is not None:
        rest = rest.combine_chunks()
        yield rest, starts(rest)


def block_pairs(df: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """Adds `own`, `lo`, `hi` (int) so that any two rows of one `key` meet in exactly one block (key, lo, hi).

    A key of up to `most` rows is one block (0, 0). A larger one is dealt by a hash of `item` into
    n = ceil(rows / most) stripes; a row then goes to the n blocks which pair its stripe with each other one.
    Rows of unlike stripes meet in block (lo, hi), rows of one stripe in block (own, own), so that no task
    gets more than about 2 * `most` rows of a key, whatever share of all rows the key has.
    The table of keys that are dealt has at most rows / `most` rows and is joined without a hint.
    """
    hot = df.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("stripes"))
    dealt = df.join(hot, key, "left").withColumn("stripes", F.coalesce("stripes", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(item), "stripes").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("stripes", "other")


def join_dealt(rows: DataFrame, small: DataFrame, key: str, item: str, most: int = 2000) -> DataFrame:
    """`rows` joined with `small` (one row for each key). Rows of a key that has more than `most` are dealt by a hash of `item`, and the
    key's row of `small` is repeated for each part, so that no key meets in one task."""
    hot = rows.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("_parts"))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(item), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    repeated = small.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_part"]).drop("_part")
