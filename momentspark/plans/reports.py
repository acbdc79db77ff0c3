"""Registered queries on reports: coverage, restored answers, runs with versions, candidates in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentspark.operators import reports

from . import fixtures as fx
from .fixtures import read
from .timeline import _spoken


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Mappings of the keyframes: of the first, those whose id is not divisible by 5, some with broken urls and keys; of the second, those not divisible by 3."""
    k = fx.keyframes(spark, d)
    name = F.when(F.col("vec_id") % 11 == 0, F.regexp_replace("name", "-", "_")).when(F.col("vec_id") % 13 == 0, F.regexp_replace("name", "jpg$", "PNG")).otherwise(F.col("name"))
    url = F.when(F.col("vec_id") % 17 == 0, F.lit("nothing")).when(F.col("vec_id") % 19 == 0, F.lit(None)).otherwise(F.concat(F.lit("http://x/static/images/"), name))
    key = F.when(F.col("vec_id") % 23 == 0, F.concat(F.lit("k"), F.col("vec_id").cast("string"))).otherwise(F.col("vec_id").cast("string"))
    entries = k.select("vec_id", key.alias("key"), url.alias("url"))
    first = entries.where("vec_id % 5 <> 0")
    first = first.union(entries.where("vec_id % 29 = 0"))
    fps = k.where("video not like '%3'").select("video", "fps").distinct()
    windows = _spoken(spark, d).withColumn("eligible", F.col("doc_id") % 4 != 0)
    return reports.coverage_report(first.drop("vec_id"), entries.where("vec_id % 3 <> 0").drop("vec_id"), fps, windows)


def restored_answers(spark: SparkSession, d: str) -> DataFrame:
    """Events as audit entries whose detail lists up to four answers of customers' tasks; every second one is wanted, tasks of odd nations are gone."""
    e = read(spark, d, "events")
    answer = lambda i: F.struct((F.col("user_id") * 4 + i).alias("task_id"), F.when(i % 2 == 0, F.col("user_id")).alias("author_id"), F.lit(7).alias("created_by"), (i * 1.5).alias("sort_key"), F.lit("v").alias("video"), F.lit("[1]").alias("frames"), F.lit("").alias("answer_text"), F.lit("hand").alias("origin"))
    listed = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), answer)
    detail = F.when(F.col("event_id") % 9 == 0, "broken {").otherwise(F.to_json(F.struct(listed.alias("answers"))))
    action = F.when(F.col("event_type") == "view", "answer.add").otherwise("answer.delete")
    audit = e.select(F.col("event_id").alias("entry_id"), action.alias("action"), detail.alias("detail"), (F.col("event_id") % 7 == 0).alias("restored"))
    tasks = read(spark, d, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("task_id"))
    none = "task_id bigint, author_id bigint, sort_key double, video string, frames string, answer_text string, origin string, created_by bigint, updated_by bigint, restored_from bigint"
    answers, marked = reports.restore(audit, audit.where("entry_id % 2 = 0").select("entry_id"), spark.createDataFrame([], none), tasks, 1)
    n = answers.groupBy(F.col("restored_from").alias("entry_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("author_id").alias("authors"), F.sum("sort_key").alias("keys"))
    return marked.select("entry_id", F.col("restored").cast("int").alias("restored")).join(n, "entry_id", "left")


def versioned_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset_id"), (F.col("o_orderkey") % 30).alias("reference_set_id"))
    data = read(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_mktsegment").alias("version"))
    refs = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("reference_set_id"), F.col("n_name").alias("version"))
    return reports.versioned_runs(runs, data, refs).select("run_id", "dataset_version", "reference_set_version")


def candidates_in_time_order(spark: SparkSession, d: str) -> DataFrame:
    best = fx.event_best(spark, d, 10)
    return reports.in_time_order(best, ["group_id", "event"]).select("group_id", "event", "name", "place")


QUERIES = {f.__name__: f for f in (coverage_report, restored_answers, versioned_runs, candidates_in_time_order)}
_SIDE = """SELECT '{0}_entries' AS counter, count(*) AS value FROM {0} UNION ALL SELECT '{0}_malformed_urls', count(*) FILTER (name IS NULL) FROM {0} UNION ALL SELECT '{0}_non_numeric_keys', count(*) FILTER (NOT regexp_matches(key, '^[0-9]+$')) FROM {0}
UNION ALL SELECT '{0}_unexpected_extensions', count(*) FILTER (name IS NOT NULL AND NOT ends_with(lower(name), '.jpg')) FROM {0} UNION ALL SELECT '{0}_duplicate_urls', count(url) - count(DISTINCT url) FROM {0}"""
_COUNTS = {
    "a_unique_frames": "count(*) FILTER (in_a)", "b_unique_frames": "count(*) FILTER (in_b)", "frames_in_both": "count(*) FILTER (in_a AND in_b)", "a_only_frames": "count(*) FILTER (NOT in_b)", "b_only_frames": "count(*) FILTER (NOT in_a)",
    "retrievable_frames": "count(*)", "frames_parsed": "count(video)", "frames_malformed_names": "count(*) FILTER (video IS NULL)", "frames_valid_fps": "count(fps)", "frames_skipped_missing_fps": "count(*) FILTER (video IS NOT NULL AND fps IS NULL)",
    "frames_matched": "count(*) FILTER (fps IS NOT NULL AND spoken)", "frames_no_asr": "count(*) FILTER (fps IS NOT NULL AND NOT spoken)", "videos_in_mappings": "count(DISTINCT video)", "videos_missing_fps": "count(DISTINCT video) FILTER (fps IS NULL)",
}
ORACLE_SQL = {
    "coverage_report": f"""WITH {fx.KEYFRAMES}, entries AS (SELECT vec_id, CASE WHEN vec_id % 23 = 0 THEN 'k' || vec_id ELSE vec_id::VARCHAR END AS key, CASE WHEN vec_id % 17 = 0 THEN 'nothing' WHEN vec_id % 19 = 0 THEN NULL
          ELSE 'http://x/static/images/' || CASE WHEN vec_id % 11 = 0 THEN replace(name, '-', '_') WHEN vec_id % 13 = 0 THEN regexp_replace(name, 'jpg$', 'PNG') ELSE name END END AS url FROM keyframes),
        named AS (SELECT *, CASE WHEN contains(url, '/') AND contains(url, '.') THEN list_extract(string_split(url, '/'), -1) END AS name FROM entries),
        a AS (SELECT * FROM named WHERE vec_id % 5 <> 0 UNION ALL SELECT * FROM named WHERE vec_id % 29 = 0), b AS (SELECT * FROM named WHERE vec_id % 3 <> 0),
        fps AS (SELECT DISTINCT video, fps FROM keyframes WHERE video NOT LIKE '%3'),
        w AS (SELECT doc_id, 'L21_V' || lpad((regexp_extract(source, '([0-9]+)$', 1)::INT % 10)::VARCHAR, 3, '0') AS video, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * 45.0::DOUBLE AS start_s FROM documents),
        frames AS (SELECT name, bool_or(s = 'a') AS in_a, bool_or(s = 'b') AS in_b FROM (SELECT name, 'a' AS s FROM a UNION ALL SELECT name, 'b' FROM b) WHERE name IS NOT NULL GROUP BY name),
        p AS (SELECT *, CASE WHEN regexp_matches(name, '^.+-[0-9]+-[0-9]+\\.[A-Za-z]+$') THEN regexp_extract(name, '^(.+)-([0-9]+)-([0-9]+)\\.[A-Za-z]+$', 1) END AS video, TRY_CAST(regexp_extract(name, '-([0-9]+)\\.[A-Za-z]+$', 1) AS INT) AS frame_idx FROM frames),
        f AS (SELECT p.*, fps.fps, EXISTS (SELECT 1 FROM w WHERE w.video = p.video AND w.doc_id % 4 <> 0 AND frame_idx / fps.fps BETWEEN start_s - 5 AND start_s + 65) AS spoken FROM p LEFT JOIN fps USING (video)),
        n AS (SELECT {", ".join(f"{sql} AS {c}" for c, sql in _COUNTS.items())} FROM f)
        {_SIDE.format("a")} UNION ALL {_SIDE.format("b")} UNION ALL SELECT counter, value FROM (UNPIVOT n ON {", ".join(_COUNTS)} INTO NAME counter VALUE value)
        UNION ALL SELECT 'videos_in_fps_map', count(*) FROM fps UNION ALL SELECT 'videos_in_asr', count(DISTINCT video) FROM w WHERE doc_id % 4 <> 0
        UNION ALL SELECT 'videos_in_asr_not_in_fps', count(DISTINCT video) FROM w WHERE doc_id % 4 <> 0 AND video NOT IN (SELECT video FROM fps) UNION ALL SELECT 'windows_loaded', count(*) FROM w UNION ALL SELECT 'windows_usable', count(*) FROM w WHERE doc_id % 4 <> 0""",
    "restored_answers": """WITH x AS (SELECT event_id, i, user_id * 4 + i AS task_id, CASE WHEN i % 2 = 0 THEN user_id ELSE 7 END AS author FROM events, (SELECT unnest([0, 1, 2, 3]) AS i)
          WHERE i <= event_id % 4 AND event_id % 2 = 0 AND event_id % 9 <> 0 AND event_id % 7 <> 0 AND event_type <> 'view' AND user_id * 4 + i IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)),
        g AS (SELECT event_id, count(*) AS n, sum(author) AS authors, sum(i * 1.5::DOUBLE) AS keys FROM x GROUP BY event_id)
        SELECT event_id AS entry_id, (event_id % 7 = 0 OR n IS NOT NULL)::INT AS restored, n, authors, keys FROM events LEFT JOIN g USING (event_id)""",
    "versioned_runs": "SELECT o_orderkey AS run_id, c_mktsegment AS dataset_version, n_name AS reference_set_version FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_orderkey % 30",
    "candidates_in_time_order": f"""WITH {fx.SCORES}, c AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY group_id, event ORDER BY score DESC, frame_idx) <= 10)
        SELECT group_id, event, name, row_number() OVER (PARTITION BY group_id, event ORDER BY frame_idx, name) AS place FROM c""",
}
