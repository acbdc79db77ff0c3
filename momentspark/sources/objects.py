"""One large JSON object, plain or gzip, as rows of its members, read in pieces: a Python data source.

    spark.dataSource.register(JsonObject)
    spark.read.format("json_object").schema("name string, text string").load("/data/asr_text.json.gz")

A file is one task, since neither JSON nor gzip can be entered in the middle; what the task holds is one piece and one batch of rows.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PIECE, BATCH = 1 << 20, 5000
_decode = json.JSONDecoder().raw_decode


def open_text(path: str):
    """Characters of a local path (with or without `file:`) or of any file system that Arrow knows by its URI."""
    import io

    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        raw = system.open_input_stream(name, compression=None)
    else:
        raw = open(path.removeprefix("file://").removeprefix("file:"), "rb")  # noqa: SIM115
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, encoding="utf-8-sig")


def members(source, piece: int = PIECE) -> Iterator[tuple[str, object]]:
    """(key, value) of a JSON object in order, from a readable of characters; holds one piece and the member it is in. Fails on anything else."""
    text, at, ended = "", 0, False

    def more() -> bool:
        nonlocal text, at, ended
        if not ended:
            new = source.read(max(piece, len(text) - at))  # a member longer than a piece: twice as much each time
            ended = not new
            text, at = text[at:] + new, 0
        return not ended

    def sign(wanted: str) -> str:
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            if at < len(text):
                if text[at] not in wanted:
                    raise ValueError(f"expected one of {wanted!r}, found {text[at]!r}")
                at += 1
                return text[at - 1]
            if not more():
                raise ValueError(f"the object ends where one of {wanted!r} should stand")

    def value():
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            try:
                found, end = _decode(text, at)
                if end < len(text) or ended:  # else a number or word could go on
                    at = end
                    return found
            except ValueError:
                if ended:
                    raise
            more()

    sign("{")
    while at >= len(text) or text[at] in " \t\r\n":
        if at < len(text):
            at += 1
        elif not more():
            raise ValueError("the object does not end")
    if text[at] == "}":
        return
    while True:
        key = value()
        if not isinstance(key, str):
            raise ValueError(f"a key that is no string: {key!r}")
        sign(":")
        yield key, value()
        if sign(",}") == "}":
            return


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        keys, values = [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(values, schema.field(1).type)], schema=schema)
            keys.clear()
            values.clear()
            return out

        text = pa.types.is_string(schema.field(1).type)
        with open_text(partition.value) as source:
            for key, value in members(source):
                keys.append(key)
                values.append(value if not text or value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False))
                if len(keys) == BATCH:
                    yield batch()
        if keys:
            yield batch()


class JsonObject(DataSource):
    """Two columns, key and value, named and typed by the schema given (default: key string, value string; other values as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "json_object"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)
