"""Registered queries on sources and small column rules: maps of vectors and texts, windows read from JSON, names, replies, phases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentspark.functions import media
from momentspark.functions import text as tx
from momentspark.operators import pipelines
from momentspark.sources import readers

from . import fixtures as fx
from .fixtures import read
from .text import FOLD


def _staged(spark: SparkSession, name: str) -> str:
    """A fresh folder that all machines see: under `spark.checkpoint.dir`, or else the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/staged-{uuid.uuid4().hex[:12]}/{name}"


def speech_windows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as windows of their source at 16 kHz, written as JSON lines and read as the source does; blank and ineligible ones go."""
    doc = read(spark, d, "documents")
    text = F.when(F.col("doc_id") % 10 == 3, " ").otherwise(F.substring("text", 1, 40))
    rows = doc.select(F.col("source").alias("video_id"), (F.col("doc_id") * 16000).alias("sample_start"), (F.col("doc_id") * 16000 + 960000).alias("sample_end"), F.lit(16000).alias("sample_rate"), (F.col("doc_id") % 7 != 0).alias("eligible"), text.alias("retrieval_text"))
    path = _staged(spark, "windows")
    rows.write.json(path)
    return readers.speech_windows(spark, path)


def mapped_vectors(spark: SparkSession, d: str) -> DataFrame:
    k = fx.keyframes(spark, d)
    url = F.when(F.col("vec_id") % 6 == 0, "none").otherwise(F.concat(F.lit("http://x/static/"), "name"))
    mapping = k.where("vec_id % 5 <> 0").select(F.col("vec_id").cast("string").alias("id"), url.alias("url"))
    found = readers.mapped_vectors(k.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), mapping, "full")
    return found.select("model", "name", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def onscreen_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts and their stripped forms under equal names; every tenth is blank."""
    t = read(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.substring("text", 1, 60)).alias("text"))
    return readers.onscreen_text(t, t.select("name", tx.fold(F.col("text")).alias("text"))).select("name", "text_lower", "text_folded")


def misnamed_frames(spark: SparkSession, d: str) -> DataFrame:
    k = fx.keyframes(spark, d)
    name = F.when(F.col("vec_id") % 5 == 0, F.regexp_replace("name", "-0", "-1")).when(F.col("vec_id") % 7 == 0, F.regexp_replace("name", "-", "_")).otherwise(F.col("name"))
    return readers.check_names(k.withColumn("name", name)).select("vec_id", "name")


def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """Replies around a JSON object, some broken, some of unknown confidence."""
    e = read(spark, d, "events")
    sure = F.when(F.col("event_id") % 4 == 0, "HIGH").when(F.col("event_id") % 4 == 1, "low").otherwise("sure")
    body = F.concat(F.lit('Here: {"keywords": [" '), "event_type", F.lit(' ", "", "b"], "confidence": "'), sure, F.lit('"} done'))
    r = e.select("event_id", F.when(F.col("event_id") % 9 == 0, "no object").when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("reply")).withColumn("r", readers.json_reply())
    return r.select("event_id", F.array_join("r.keywords", "|").alias("keywords"), F.col("r.confidence").alias("confidence"))


def phases(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 < 6, F.get(F.array(*[F.lit(x) for x in ("2", "p2", " P2 ", "p1", "3", "")]), (F.col("event_id") % 7).cast("int")))
    return read(spark, d, "events").select("event_id", tx.normalize_phase(raw).alias("phase"))


def moments(spark: SparkSession, d: str) -> DataFrame:
    at = media.moment(F.col("event_id") % 130, F.when(F.col("event_id") % 10 != 0, F.lit(100)).otherwise(0), F.col("user_id").cast("double"), F.col("user_id") + 60.0)
    return read(spark, d, "events").select("event_id", F.round(at, 6).alias("at_s"))


def focused(spark: SparkSession, d: str) -> DataFrame:
    k = fx.keyframes(spark, d).select("video", "name")
    return pipelines.focus(k, ["L21_V001", "L21_V004"]).withColumn("kind", F.lit("two")).union(pipelines.focus(k, []).withColumn("kind", F.lit("all")))


QUERIES = {f.__name__: f for f in (speech_windows, mapped_vectors, onscreen_text, misnamed_frames, tolerant_json, phases, moments, focused)}
ORACLE_SQL = {
    "speech_windows": """SELECT source AS video, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_id, doc_id::DOUBLE AS start_s, (doc_id + 60)::DOUBLE AS end_s, text[1:40] AS text FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 10 <> 3 AND trim(text[1:40]) <> ''""",
    "mapped_vectors": f"WITH {fx.KEYFRAMES} SELECT 'full' AS model, name, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM keyframes WHERE vec_id % 5 <> 0 AND vec_id % 6 <> 0",
    "onscreen_text": f"SELECT 'doc-' || doc_id AS name, lower(text[1:60]) AS text_lower, {FOLD.format('text[1:60]')} AS text_folded FROM documents WHERE doc_id % 10 <> 0 AND trim(text[1:60]) <> ''",
    "misnamed_frames": f"""WITH {fx.KEYFRAMES}, d AS (SELECT vec_id, name AS own, CASE WHEN vec_id % 5 = 0 THEN replace(name, '-0', '-1') WHEN vec_id % 7 = 0 THEN replace(name, '-', '_') ELSE name END AS name FROM keyframes) SELECT vec_id, name FROM d WHERE name <> own""",
    "tolerant_json": """SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_id % 11 = 0 THEN '' ELSE event_type || '|b' END AS keywords, CASE WHEN event_id % 9 = 0 OR event_id % 11 = 0 THEN 'none' WHEN event_id % 4 = 0 THEN 'high' WHEN event_id % 4 = 1 THEN 'low' ELSE 'none' END AS confidence FROM events""",
    "phases": "SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 'p2' ELSE 'p1' END AS phase FROM events",
    "moments": "SELECT event_id, round(user_id + CASE WHEN event_id % 10 = 0 THEN 0.5 ELSE least(1.0, (event_id % 130) / 100.0::DOUBLE) END * 60.0::DOUBLE, 6) AS at_s FROM events",
    "focused": f"WITH {fx.KEYFRAMES} SELECT video, name, 'two' AS kind FROM keyframes WHERE video IN ('L21_V001', 'L21_V004') UNION ALL SELECT video, name, 'all' FROM keyframes",
}
