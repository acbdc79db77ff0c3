"""Sources of the retrieval corpus, with fixed schemas. Paths are whatever Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentspark.functions.media import basename, parse_name
from momentspark.functions.text import fold

KEYFRAME = "name string, video string, scene_id int, frame_idx int, fps double, width int, height int, timestamp_ms bigint, timestamp_str string"
WINDOW = "video_id string, sample_start bigint, sample_end bigint, sample_rate int, eligible boolean, retrieval_text string"
QUERY = "struct<query_key: string, task_type: string, query_text: string, reference_video: string, valid_intervals: array<struct<start: int, end: int>>>"
SEED = f"schema_version int, slug string, version string, query_count int, task_counts map<string, int>, queries array<{QUERY}>"


def keyframes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of frames. Frames with one (video, frame_idx) are kept once: alignment needs an order without ties."""
    rows = spark.read.schema(KEYFRAME).json(path, multiLine=True)
    first = F.row_number().over(Window.partitionBy("video", "frame_idx").orderBy("name"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k")


def json_map(spark: SparkSession, path: str, key: str, value: str, kind: str = "string") -> DataFrame:
    """A JSON object {key: value} (plain or gzip) as rows; a missing path gives no rows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], f"{key} string, {value} {kind}")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias(key, value))


def json_members(spark: SparkSession, path: str, key: str, value: str, kind: str = "string") -> DataFrame:
    """As `json_map` for one object of any size: its members are read in pieces (`sources.objects`), where `json_map` holds it as a whole."""
    from .objects import JsonObject

    spark.dataSource.register(JsonObject)
    return spark.read.format("json_object").schema(f"{key} string, {value} {kind}").load(path)


def mapped_vectors(vectors: DataFrame, mapping: DataFrame, model: str) -> DataFrame:
    """Vectors (id, vec) of one model with the names that its mapping (id, url) gives: model, name, vec."""
    return vectors.join(mapping.select(F.col("id").cast("long").alias("id"), basename(F.col("url")).alias("name")), "id").where("name is not null").select(F.lit(model).alias("model"), "name", "vec")


def onscreen_text(original: DataFrame, stripped: DataFrame) -> DataFrame:
    """name, text, text_lower, text_folded from two maps (name, text); fails if a name is in one only; blank texts go."""
    both = original.join(stripped.select("name", F.lit(True).alias("there")), "name", "full_outer")
    lone = F.col("text").isNull() | F.col("there").isNull()
    checked = both.withColumn("text", F.when(lone, F.raise_error(F.concat(F.lit("name in one map only: "), F.col("name")))).otherwise(F.col("text")))
    return checked.where(F.trim("text") != "").select("name", "text", F.lower("text").alias("text_lower"), F.lower(fold(F.col("text"))).alias("text_folded"))


def speech_windows(spark: SparkSession, path: str) -> DataFrame:
    """Eligible, non-blank windows: video, doc_id (numbered in a video by start), start_s, end_s, text."""
    rows = spark.read.schema(WINDOW).json(path).where("eligible and trim(retrieval_text) <> ''")
    doc = F.row_number().over(Window.partitionBy("video_id").orderBy("sample_start", "sample_end", "retrieval_text")) - 1
    rate = F.col("sample_rate")
    return rows.select(F.col("video_id").alias("video"), doc.cast("long").alias("doc_id"), (F.col("sample_start") / rate).alias("start_s"), (F.col("sample_end") / rate).alias("end_s"), F.col("retrieval_text").alias("text"))


def benchmark_seed(spark: SparkSession, path: str, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """(queries, issues) of a benchmark set. Issues: schema version, counts, repeated keys, trake with intervals, others without, start > end."""
    seed = spark.read.schema(SEED).json(path, multiLine=True)
    q = seed.select("slug", "version", F.posexplode("queries").alias("ordinal", "q")).select("slug", "version", "ordinal", "q.*")
    n = q.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.map_from_entries(F.collect_set(F.struct("task_type", F.lit(0)))).alias("types"))
    counts = q.groupBy("slug", "task_type").agg(F.count(F.lit(1)).alias("n"))
    told = seed.select("slug", F.explode("task_counts").alias("task_type", "told"))
    spans = F.coalesce(F.size("valid_intervals"), F.lit(0))
    issue = lambda rows, name, detail: rows.select("slug", F.lit(name).alias("issue"), detail.cast("string").alias("detail"))
    trake = F.lower("task_type") == "trake"
    issues = issue(seed.where(F.col("schema_version") != version), "schema_version", F.col("schema_version"))
    issues = issues.union(issue(seed.join(n, "slug").where("query_count <> n"), "query_count", F.col("n")))
    issues = issues.union(issue(counts.join(told, ["slug", "task_type"], "full_outer").where("not (n <=> told)"), "task_counts", F.col("task_type")))
    issues = issues.union(issue(q.groupBy("slug", "query_key").count().where("count > 1"), "repeated_key", F.col("query_key")))
    issues = issues.union(issue(q.where(trake & (spans > 0)), "trake_with_intervals", F.col("query_key")))
    issues = issues.union(issue(q.where(~trake & (spans == 0)), "no_intervals", F.col("query_key")))
    issues = issues.union(issue(q.where(F.exists("valid_intervals", lambda s: s["start"] > s["end"])), "start_after_end", F.col("query_key")))
    return q.withColumn("content_sha256", F.sha2(F.to_json(F.struct(*[c for c in q.columns if c != "ordinal"])), 256)), issues


def query_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, unmatched) from a folder of text files named like `query-p1-7-kis.txt`: phase, code, type, body (without byte-order
    mark, trimmed), ordered by the numeric code; files with other names come back with the reason."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("body"))
    rule = r"(?i)^query-(p[12])-(\d+)-(kis|qa|trake)\.txt$"
    part = lambda i: F.lower(F.regexp_extract("file", rule, i))
    good = F.col("file").rlike(rule)
    return rows.where(good).select(part(1).alias("phase"), part(2).alias("code"), part(3).alias("type"), "body").orderBy(F.col("code").cast("int")), rows.where(~good).select("file", F.lit("name does not match").alias("reason"))


def check_names(frames: DataFrame) -> DataFrame:
    """Frames whose name is not the one that video, scene and frame make: none, in a sound table."""
    p = parse_name(F.col("name"))
    return frames.where(p.isNull() | (p["video"] != F.col("video")) | (p["scene_id"] != F.col("scene_id")) | (p["frame_idx"] != F.col("frame_idx")))


def json_reply(text: str = "reply", schema: str = "keywords array<string>, confidence string"):
    """Of a reply column: what lies between the first { and the last }, parsed; null where it does not parse. An unknown confidence is
    'none'; list items are trimmed and empty ones dropped."""
    parsed = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
    words = F.filter(F.transform(F.coalesce(parsed["keywords"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    sure = F.lower(parsed["confidence"])
    return F.struct(words.alias("keywords"), F.when(sure.isin("high", "medium", "low"), sure).otherwise("none").alias("confidence"))
