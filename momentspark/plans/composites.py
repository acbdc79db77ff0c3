"""Registered queries on compositions and small operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentspark.operators import expansion, pipelines, search, temporal, timeline

from . import fixtures as fx
from .fixtures import read
from .retrieval import RERANK, TOP, M, _fused
from .text import texts


def _grouped(rows: DataFrame, n: int) -> DataFrame:
    """Queries in groups of n by id: group_id and event."""
    return rows.withColumn("group_id", F.floor(F.col("query_id") / (20 * n))).withColumn("event", (F.floor(F.col("query_id") / 20) % n).cast("int"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return fx.keyframes(spark, d).select("video", "name", "frame_idx", "fps", "pos", F.col("embedding").alias("vec"))


def _events(spark: SparkSession, d: str, n: int) -> DataFrame:
    return _grouped(fx.queries(spark, d).where("model = 'full'"), n).select("group_id", "event", "qvec")


def trake_discovery(spark: SparkSession, d: str) -> DataFrame:
    found = search.ensemble_search(fx.vectors(spark, d), fx.queries(spark, d), fx.WEIGHTS, 50, M).withColumnRenamed("distance", "score")
    out = pipelines.discover_and_align(_grouped(found, 3), _events(spark, d, 3), _frames(spark, d), 3, 60)
    return out.select("group_id", "video", "frequency", "total", F.array_join("path", ",").alias("path"))


def trake_discovery_dp(spark: SparkSession, d: str) -> DataFrame:
    found = search.ensemble_search(fx.vectors(spark, d), fx.queries(spark, d), fx.WEIGHTS, 50, M).withColumnRenamed("distance", "score")
    out = pipelines.discover_and_align(_grouped(found, 2), _events(spark, d, 2), _frames(spark, d), 2, 60, exact=True)
    return out.select("group_id", "video", "frequency", "total", F.array_join("path", ",").alias("path"))


def trake_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Greedy alignment in the query's own video, where each ninth frame has no vector or one cut short."""
    k = fx.keyframes(spark, d)
    groups = k.where("vec_id % 20 = 0").select(F.col("vec_id").alias("group_id"), "video")
    events = groups.select("group_id", F.posexplode(F.sequence(F.col("group_id"), F.col("group_id") + 2)).alias("event", "vec_id")).join(k.select("vec_id", F.col("embedding").alias("qvec")), "vec_id").drop("vec_id")
    vec = F.when(F.col("vec_id") % 9 == 4, F.lit(None)).when(F.col("vec_id") % 9 == 7, F.slice("embedding", 1, 9)).otherwise(F.col("embedding"))
    scored = pipelines.score_after_first(groups, events, k.withColumn("vec", vec).select("video", "name", "frame_idx", "fps", "pos", "vec"), 3, 60)
    return temporal.align_greedy(scored, 3, 60).withColumn("path", F.array_join("path", ","))


def temporal_discovery(spark: SparkSession, d: str) -> DataFrame:
    hits = search.top_m(fx.vectors(spark, d).where("model = 'full'"), fx.queries(spark, d).where("model = 'full'"), M)
    return pipelines.discover_pairs(_grouped(hits, 2), _events(spark, d, 2), _frames(spark, d), threshold=0.05)


def text_entry(spark: SparkSession, d: str) -> DataFrame:
    parts, errors = pipelines.text_parts(read(spark, d, "benchmark").select(F.col("item_id").alias("group_id"), "text"), 3)
    return parts.select("group_id", "event", F.length("query").alias("n"), F.lit("").alias("error")).union(errors.select("group_id", F.lit(-1), F.lit(0), "error"))


def request_routing(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    f = lambda kind, c: F.when(F.col("event_type") == kind, F.lit(" ")).when(F.col(c) % 2 == 0, "x")
    r = pipelines.route(e.select("event_id", f("view", "event_id").alias("asr_filter"), f("click", "user_id").alias("ocr_filter"), f("error", "event_id").alias("text_filter")))
    return r.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def corpus_membership(spark: SparkSession, d: str) -> DataFrame:
    t = texts(spark, d).withColumn("video", F.concat(F.lit("L21_V"), F.lpad(F.regexp_extract("video", r"(\d+)$", 1), 3, "0")))
    return pipelines.in_corpus(t, fx.keyframes(spark, d)).groupBy("video").agg(F.count(F.lit(1)).alias("n"))


def reference_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.coverage(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n_missing"))


def restorable_rows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    detail = F.when(F.col("event_id") % 5 == 0, "broken {").otherwise(F.concat(F.lit('{"restored":'), F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), F.lit(',"answers":['), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("user_id") % 4).cast("int")), lambda i: F.concat(F.lit('{"id":'), i.cast("string"), F.lit("}"))), ","), F.lit("]}")))
    return pipelines.restorable(e.select("event_id", detail.alias("detail"))).select("event_id", "n_restorable")


def majority_phase(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.majority(read(spark, d, "events"), "user_id", "event_type")


def run_progress(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("queued")
    return pipelines.run_progress(read(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), status.alias("status")))


def spread_on_keyframes(spark: SparkSession, d: str) -> DataFrame:
    k = fx.keyframes(spark, d)
    spans = k.where("vec_id % 20 = 0").select("vec_id", "video", F.explode(expansion.even_positions(F.col("frame_idx"), F.col("frame_idx") + 530, F.lit(5))).alias("x"))
    return timeline.nearest(spans, k).select("vec_id", F.col("x").cast("long").alias("x"), F.col("nearest.name").alias("name"))


def frame_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")), read(spark, d, "part").select(F.col("p_size").cast("long").alias("k"))
    sets = {"union": a.union(b).distinct(), "difference": a.distinct().exceptAll(b.distinct()), "intersection": a.intersect(b)}
    out = None
    for name, rows in sets.items():
        one = rows.select(F.lit(name).alias("kind"), "k")
        out = one if out is None else out.union(one)
    return out


def _greedy(n: int) -> str:
    steps = "g0 AS (SELECT group_id, video, score AS total, frame_idx AS last, CAST(frame_idx AS VARCHAR) AS path FROM sc WHERE event = 0 QUALIFY row_number() OVER (PARTITION BY group_id, video ORDER BY score DESC, frame_idx) = 1)"
    for k in range(1, n):
        steps += f""", g{k} AS (SELECT g.group_id, g.video, round(g.total + s.score, 6) AS total, s.frame_idx AS last, g.path || ',' || s.frame_idx AS path FROM g{k - 1} g JOIN sc s ON s.group_id = g.group_id AND s.video = g.video AND s.event = {k}
          AND s.frame_idx > g.last AND s.frame_idx - g.last <= 60 * s.fps QUALIFY row_number() OVER (PARTITION BY g.group_id, g.video ORDER BY s.score DESC, s.frame_idx) = 1)"""
    return steps


def _discovered(source: str, score: str, n: int, least: float) -> str:
    return f"""hit AS (SELECT query_id // {20 * n} AS group_id, query_id // 20 % {n} AS event, video, name, {score} AS score FROM {source}),
b AS (SELECT * FROM hit WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY group_id, event, video ORDER BY score DESC, name) = 1),
v AS (SELECT group_id, video, first(name ORDER BY score DESC, name) AS anchor, count(*) AS frequency, round(sum(score), 4) AS score_sum FROM b GROUP BY ALL),
top AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY frequency DESC, score_sum DESC, video) <= 5),
sc AS (SELECT t.group_id, q.query_id // 20 % {n} AS event, t.video, t.anchor, t.frequency, k.name, k.pos, k.frame_idx, k.fps, round(list_dot_product(q.qvec, CAST(k.embedding AS DOUBLE[])), 6) AS score
  FROM top t JOIN queries q ON q.model = 'full' AND q.query_id // {20 * n} = t.group_id JOIN keyframes k ON k.video = t.video)"""


QUERIES = {f.__name__: f for f in (trake_discovery, trake_discovery_dp, trake_unreadable, temporal_discovery, text_entry, request_routing, corpus_membership, reference_coverage, restorable_rows, majority_phase, run_progress, spread_on_keyframes, frame_sets)}
ORACLE_SQL = {
    "trake_discovery": f"WITH {RERANK}, {_fused('reranked', 50)}, {_discovered('fused', 'distance', 3, 0)}, {_greedy(3)} SELECT g.group_id, g.video, t.frequency, g.total, g.path FROM g2 g JOIN top t USING (group_id, video)",
    "trake_discovery_dp": f"""WITH {RERANK}, {_fused('reranked', 50)}, {_discovered('fused', 'distance', 2, 0)},
        p AS (SELECT a.group_id, a.video, a.frequency, round(a.score + b.score, 6) AS total, a.frame_idx AS f1, b.frame_idx AS f2 FROM sc a JOIN sc b ON b.group_id = a.group_id AND b.video = a.video AND b.event = 1 AND b.frame_idx > a.frame_idx AND b.frame_idx - a.frame_idx <= 60 * a.fps WHERE a.event = 0)
        SELECT group_id, video, frequency, total, f1 || ',' || f2 AS path FROM p QUALIFY row_number() OVER (PARTITION BY group_id, video ORDER BY total DESC, f2, f1) = 1""",
    "trake_unreadable": f"""WITH {fx.SCORES}, sc AS (SELECT s.* EXCLUDE (score), CASE WHEN k.vec_id % 9 IN (4, 7) THEN -1.0::DOUBLE ELSE score END AS score FROM scored s JOIN keyframes k USING (name)), {_greedy(3)} SELECT group_id, video, total, path FROM g2""",
    "temporal_discovery": f"""WITH {TOP}, {_discovered("(SELECT * FROM hits WHERE model = 'full')", 'score', 2, 0.05)},
        anchors AS (SELECT t.group_id, t.video, k.name, k.pos AS anchor_pos, k.frame_idx, k.fps FROM top t JOIN keyframes k ON k.name = t.anchor),
        sides AS (SELECT s.group_id, s.video, CASE s.event WHEN 0 THEN 's' ELSE 'e' END AS side, abs(s.pos - a.anchor_pos) AS dist, s.name, s.frame_idx, s.score FROM sc s JOIN anchors a USING (group_id, video)
          WHERE abs(s.pos - a.anchor_pos) <= 20 AND ((s.event = 0 AND s.pos <= a.anchor_pos) OR (s.event = 1 AND s.pos >= a.anchor_pos))),
        open AS (SELECT * FROM sides s WHERE NOT EXISTS (SELECT 1 FROM sides t WHERE t.group_id = s.group_id AND t.video = s.video AND t.side = s.side AND t.dist <= s.dist AND t.score < 0.05)),
        pool AS (SELECT * FROM open UNION ALL SELECT a.group_id, a.video, x.side, 0, a.name, a.frame_idx, 0.0 FROM anchors a, (VALUES ('s'), ('e')) x(side) WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.group_id = a.group_id AND o.video = a.video AND o.side = x.side)),
        pairs AS (SELECT a.group_id, a.video, s.name AS start_name, e.name AS end_name, round(s.score + e.score, 6) AS total, s.dist AS d1, e.dist AS d2 FROM anchors a JOIN pool s ON s.group_id = a.group_id AND s.video = a.video AND s.side = 's' JOIN pool e ON e.group_id = a.group_id AND e.video = a.video AND e.side = 'e'
          WHERE e.frame_idx >= s.frame_idx AND e.frame_idx - s.frame_idx <= 20 * a.fps AND s.score + e.score > -1),
        best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY group_id, video ORDER BY total DESC, d1, d2) = 1), n AS (SELECT group_id, video, count(*) FILTER (side = 's') AS n_left, count(*) FILTER (side = 'e') AS n_right FROM open GROUP BY ALL)
        SELECT a.group_id, a.video, coalesce(start_name, a.name) AS start_name, coalesce(end_name, a.name) AS end_name, coalesce(total, 0.0) AS score, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM anchors a LEFT JOIN best USING (group_id, video) LEFT JOIN n USING (group_id, video)""",
    "text_entry": """WITH p AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(trim(text), '\\.\\s+'), lambda x: trim(regexp_replace(trim(x), '\\.+$', ''))), lambda x: x <> '') AS parts FROM benchmark)
        SELECT item_id AS group_id, i - 1 AS event, length(parts[i]) AS n, '' AS error FROM (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p WHERE len(parts) >= 3) UNION ALL SELECT item_id, -1, 0, 'needs 3 parts, has ' || len(parts) FROM p WHERE len(parts) < 3""",
    "request_routing": """WITH f AS (SELECT event_type <> 'view' AND event_id % 2 = 0 AS a, event_type <> 'click' AND user_id % 2 = 0 AS o, event_type <> 'error' AND event_id % 2 = 0 AS t FROM events)
        SELECT CASE WHEN a AND o THEN 'mixed' WHEN a THEN 'asr' WHEN o THEN 'ocr' WHEN t THEN 'text' ELSE 'none' END AS mode, count(*) AS n FROM f GROUP BY 1""",
    "corpus_membership": f"WITH {fx.KEYFRAMES} SELECT video, count(*) AS n FROM (SELECT 'L21_V' || lpad(regexp_extract(source, '(\\d+)$', 1), 3, '0') AS video FROM documents) WHERE video IN (SELECT video FROM keyframes) GROUP BY video",
    "reference_coverage": "SELECT lang, count(*) AS n_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "restorable_rows": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 0 ELSE user_id % 4 + 1 END AS n_restorable FROM events",
    "majority_phase": "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
    "run_progress": """WITH n AS (SELECT o_custkey AS run_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders GROUP BY 1)
        SELECT *, CASE WHEN total > completed + failed THEN 'running' WHEN failed = 0 THEN 'completed' WHEN completed = 0 THEN 'failed' ELSE 'completed_with_errors' END AS status FROM n""",
    "spread_on_keyframes": f"""WITH {fx.KEYFRAMES}, s AS (SELECT vec_id, video, frame_idx + CAST(round_even(i * 530 / 4.0::DOUBLE, 0) AS BIGINT) AS x FROM keyframes, (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE vec_id % 20 = 0)
        SELECT s.vec_id, s.x, k.name FROM s JOIN keyframes k USING (video) QUALIFY row_number() OVER (PARTITION BY s.vec_id, s.x ORDER BY abs(k.frame_idx - s.x), k.frame_idx) = 1""",
    "frame_sets": """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), b AS (SELECT DISTINCT p_size AS k FROM part) SELECT 'union' AS kind, k FROM (SELECT k FROM a UNION SELECT k FROM b)
        UNION ALL SELECT 'difference', k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'intersection', k FROM a WHERE k IN (SELECT k FROM b)""",
}
