"""Token ids in ORC files (dealt operator 6): integer run lengths, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of their ids and sorted before they are encoded, so the files hold them in ascending
order and a range of ids lies in few stripes. ORC's integer encoding stores ids below 65,536 in 16 bits. Each row also has
its part (file) and the number of ids before it in that part; both encode to almost nothing. Readers take stripes in
parallel and skip stripes and row groups by the minima, maxima and Bloom filters of doc_id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, slices


def write_tokens(docs: DataFrame, definition: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 64, row_group: int = 10_000) -> None:
    """Writes doc_id, part int, before long, ids array<int> in ascending doc_id (nulls first, rows of one id in any order).

    Null texts count as empty and have only the end id. Other columns are not written. An empty table gives files
    without rows. Rows of one id may be dealt over several parts, so a common id does not meet in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        from pyspark import TaskContext

        part, before, enc = TaskContext.get().partitionId(), 0, encoder(shared.value)
        for b in slices(batches, "t"):
            found, at = enc.lists(b.column("t"))
            n = np.diff(at) + 1
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.insert(found, at[1:], end_id), pa.int32()))
            yield pa.record_batch([b.column("doc_id"), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(before + ends - n), ids], names=["doc_id", "part", "before", "ids"])
            before += int(ends[-1]) if len(n) else 0

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("tie"))
    sorted_docs = slim.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "t")
    rows = sorted_docs.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, part int, before long, ids array<int>")
    options = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": str(row_group), "orc.stripe.size": str(stripe_mb << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, id_type: str = "bigint") -> DataFrame:
    """doc_id, part, before, ids from the files; with `doc_ids`, only those, and the reader skips by the indexes."""
    rows = spark.read.schema(f"doc_id {id_type}, part int, before bigint, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_index(rows: DataFrame) -> DataFrame:
    """Of `read_tokens` rows: doc_id, start long (ids of all documents before it), n_tokens long, ids_crc32 long.

    Both numbers come from the ids read. One pass over the ids; the sums by part (one row for each file) are then
    added up in order.
    """

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4"), ids.offsets.to_numpy() - (ids.offsets[0].as_py() if len(ids) else 0)
            data = memoryview(flat.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("part"), b.column("before"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part int, before long, n_tokens long, ids_crc32 long"
    slim = Scratch(rows.sparkSession, "tokens").write(rows.mapInArrow(run, schema), "index")
    parts = slim.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return slim.join(first, "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
