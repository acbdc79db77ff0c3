"""Sinks: submission files and result exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submissions(bodies: DataFrame, path: str, header: str | None = None, line_end: str = "\n") -> None:
    """Writes one text file for each task under `task_id=...` from (task_id, body); tasks with an empty body get an empty file.

    Bodies end each line with a line feed and are written as they are: no quoting."""
    body = F.regexp_replace("body", "\n$", "")
    body = F.when(body == "", body).otherwise(F.concat(F.lit(f"{header}\n" if header else ""), body))
    bodies.select("task_id", F.regexp_replace(body, "\n", line_end).alias("value")).write.option("lineSep", line_end).partitionBy("task_id").text(path)


def results(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Per-query results as CSV with a header (RFC 4180 quoting) or as JSON lines."""
    rows.write.option("header", True).option("escape", '"').csv(path) if kind == "csv" else rows.write.json(path)
