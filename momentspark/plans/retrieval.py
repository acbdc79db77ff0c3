"""Registered queries on search and temporal alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from momentspark.operators import search, temporal

from . import fixtures as fx

M, K = 20, 10
TOP = fx.VECTORS + f""",
hits AS (SELECT * FROM (SELECT query_id, model, name, video, pos, score, row_number() OVER (PARTITION BY query_id, model ORDER BY score DESC, name) AS rank
  FROM (SELECT q.query_id, q.model, v.name, v.video, v.pos, round(list_dot_product(q.qvec, v.vec), 6) AS score FROM queries q JOIN vectors v USING (model))) WHERE rank <= {M})"""
RERANK = TOP + """,
resummed AS (SELECT h.query_id, h.model, h.name, h.video, h.pos, h.score AS raw_score,
  round(coalesce(sum(list_dot_product(q.qvec, v.vec)), 0), 6) AS score, count(v.vec) AS n_neighbors
  FROM hits h JOIN queries q USING (query_id, model) LEFT JOIN vectors v ON v.model = h.model AND v.video = h.video AND abs(v.pos - h.pos) BETWEEN 1 AND 3
  GROUP BY ALL),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY score DESC, raw_score DESC, name) AS rank FROM resummed)"""
WEIGHT = "CASE model WHEN 'full' THEN 0.5::DOUBLE WHEN 'low' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END"


def _fused(source: str, k: int = K) -> str:
    return f"""shares AS (SELECT *, {WEIGHT} * CASE WHEN max(score) OVER (PARTITION BY query_id, model) > 0 THEN score / max(score) OVER (PARTITION BY query_id, model) ELSE score END AS share FROM {source}),
totals AS (SELECT query_id, sum({WEIGHT}) AS total FROM (SELECT DISTINCT query_id, model FROM {source}) GROUP BY query_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, name) AS rank FROM
  (SELECT query_id, name, video, round(100 * sum(share) / any_value(total), 6) AS distance, count(*) AS n_routes,
    string_agg(model || ':' || CAST(shares.rank AS VARCHAR), ',' ORDER BY model) AS routes FROM shares JOIN totals USING (query_id) GROUP BY query_id, name, video)) WHERE rank <= {k})"""


ONE = TOP.replace("JOIN vectors v USING (model))", "JOIN vectors v USING (model) WHERE model = 'low')")


def knn_topm(spark: SparkSession, d: str) -> DataFrame:
    return search.top_m(fx.vectors(spark, d), fx.queries(spark, d), M).select("query_id", "model", "name", "score", "rank")


def neighbor_rerank(spark: SparkSession, d: str) -> DataFrame:
    return search.top_reranked(fx.vectors(spark, d), fx.queries(spark, d), M).select("query_id", "model", "name", "raw_score", "score", "n_neighbors", "rank")


def _plain(fused: DataFrame) -> DataFrame:
    return fused.withColumn("routes", F.array_join(F.transform("routes", lambda r: F.concat_ws(":", r["model"], r["rank"].cast("string"))), ","))


def ensemble_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _plain(search.ensemble_search(fx.vectors(spark, d), fx.queries(spark, d), fx.WEIGHTS, K, M))


def single_model(spark: SparkSession, d: str) -> DataFrame:
    return _plain(search.ensemble_search(fx.vectors(spark, d), fx.queries(spark, d), {"low": 0.3}, K, M, use_rerank=False))


def scoped_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Half of the videos are of group K; the scope is filled from 2,000 hits a model."""
    odd = F.when(F.substring("video", 8, 1).cast("int") % 2 == 1, F.regexp_replace("video", "^L", "K")).otherwise(F.col("video"))
    found = search.ensemble_search(fx.vectors(spark, d).withColumn("video", odd), fx.queries(spark, d), fx.WEIGHTS, 50, M, groups=[" k "])
    return found.select("query_id", "name", "video", "distance", "rank")


def one_per_video(spark: SparkSession, d: str) -> DataFrame:
    cards = search.one_per_video(search.ensemble_search(fx.vectors(spark, d), fx.queries(spark, d), fx.WEIGHTS, K, M))
    return cards.select("query_id", "card", "name", "distance", "n", "first_rank", F.array_join("members", ",").alias("members"))


def min_max_percent(spark: SparkSession, d: str) -> DataFrame:
    found = search.percent_of_set(search.ensemble_search(fx.vectors(spark, d), fx.queries(spark, d), fx.WEIGHTS, K, M))
    agree = F.when(F.col("n_routes") == len(fx.WEIGHTS), "all").when(F.col("n_routes") > 1, "some").otherwise("one")
    return found.select("query_id", "name", F.round("percent", 4).alias("percent"), agree.alias("agreement"))


def video_discovery(spark: SparkSession, d: str) -> DataFrame:
    hits = search.top_m(fx.vectors(spark, d).where("model = 'full'"), fx.queries(spark, d).where("model = 'full'"), M)
    grouped = hits.withColumn("group_id", F.floor(F.col("query_id") / 60))  # three queries make a group
    return search.discover_videos(grouped, 0.1).where("rank <= 5").select("group_id", "video", "anchor_name", "frequency", "score_sum", "rank")


def temporal_pair(spark: SparkSession, d: str) -> DataFrame:
    scored = fx.event_scores(spark, d, 2)
    start = scored.where("event = 0 and pos <= anchor_pos").select(F.col("group_id").alias("query_id"), F.lit("start").alias("side"), (F.col("anchor_pos") - F.col("pos")).alias("dist"), "name", "frame_idx", "score")
    end = scored.where("event = 1 and pos >= anchor_pos").select(F.col("group_id").alias("query_id"), F.lit("end").alias("side"), (F.col("pos") - F.col("anchor_pos")).alias("dist"), "name", "frame_idx", "score")
    anchors = fx.keyframes(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "name", "frame_idx", "fps")
    return temporal.best_pair(start.union(end), anchors, gap_s=20, max_frames=20, threshold=-0.15)


def trake_dp(spark: SparkSession, d: str) -> DataFrame:
    return temporal.align_frames(*fx.event_groups(spark, d), 3, 20, unread=None).withColumn("path", F.array_join("path", ","))


def trake_greedy(spark: SparkSession, d: str) -> DataFrame:
    return temporal.align_greedy(fx.scores_after_best(spark, d, 2 * 20 * 30), 3, 20).withColumn("path", F.array_join("path", ","))


def trake_candidates(spark: SparkSession, d: str) -> DataFrame:
    return fx.event_best(spark, d, 10).select("group_id", "event", "video", "name", "score", "rank")




QUERIES = {f.__name__: f for f in (knn_topm, neighbor_rerank, ensemble_fusion, single_model, scoped_ensemble, one_per_video, min_max_percent, video_discovery, temporal_pair, trake_dp, trake_greedy, trake_candidates)}
ORACLE_SQL = {
    "knn_topm": f"WITH {TOP} SELECT query_id, model, name, score, rank FROM hits",
    "neighbor_rerank": f"WITH {RERANK} SELECT query_id, model, name, raw_score, score, n_neighbors, rank FROM reranked",
    "ensemble_fusion": f"WITH {RERANK}, {_fused('reranked')} SELECT query_id, name, video, distance, routes, n_routes, rank FROM fused",
    "single_model": f"WITH {ONE}, {_fused('hits')} SELECT query_id, name, video, distance, routes, n_routes, rank FROM fused",
    "scoped_ensemble": f"WITH {RERANK.replace(f'rank <= {M}', 'rank <= 2000')}, {_fused('reranked', 1_000_000)} SELECT query_id, name, 'K' || substr(video, 2) AS video, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, name) AS rank FROM fused WHERE CAST(substr(video, 8, 1) AS INT) % 2 = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, name) <= 50",
    "one_per_video": f"""WITH {RERANK}, {_fused('reranked')} SELECT query_id, video AS card, arg_min(name, rank) AS name, max(distance) AS distance, count(*) AS n, min(rank) AS first_rank,
        string_agg(name, ',' ORDER BY rank) AS members FROM fused GROUP BY query_id, video""",
    "min_max_percent": f"""WITH {RERANK}, {_fused('reranked')}, b AS (SELECT *, min(distance) OVER (PARTITION BY query_id) AS lo, max(distance) OVER (PARTITION BY query_id) AS hi FROM fused)
        SELECT query_id, name, round(CASE WHEN hi > lo THEN 100 * (distance - lo) / (hi - lo) ELSE 100.0 END, 4) AS percent, CASE n_routes WHEN 3 THEN 'all' WHEN 2 THEN 'some' ELSE 'one' END AS agreement FROM b""",
    "video_discovery": f"""WITH {TOP}, f AS (SELECT query_id // 60 AS group_id, query_id, video, name, score FROM hits WHERE model = 'full' AND score >= 0.1
        QUALIFY row_number() OVER (PARTITION BY query_id, video ORDER BY score DESC, name) = 1),
        g AS (SELECT group_id, video, first(name ORDER BY score DESC, name) AS anchor_name, count(*) AS frequency, round(sum(score), 4) AS score_sum FROM f GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY frequency DESC, score_sum DESC, video) AS rank FROM g) WHERE rank <= 5""",
    "temporal_pair": f"""WITH {fx.SCORES},
        sides AS (SELECT group_id, 's' AS side, anchor_pos - pos AS dist, name, frame_idx, score FROM scored WHERE event = 0 AND pos <= anchor_pos AND anchor_pos - pos <= 20
          UNION ALL SELECT group_id, 'e', pos - anchor_pos, name, frame_idx, score FROM scored WHERE event = 1 AND pos >= anchor_pos AND pos - anchor_pos <= 20),
        open AS (SELECT * FROM sides s WHERE NOT EXISTS (SELECT 1 FROM sides t WHERE t.group_id = s.group_id AND t.side = s.side AND t.dist <= s.dist AND t.score < -0.15)),
        anchors AS (SELECT vec_id AS group_id, name, frame_idx, fps FROM keyframes WHERE vec_id % 20 = 0),
        pool AS (SELECT * FROM open UNION ALL SELECT a.group_id, x.side, 0, a.name, a.frame_idx, 0.0 FROM anchors a, (VALUES ('s'), ('e')) x(side) WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.group_id = a.group_id AND o.side = x.side)),
        pairs AS (SELECT a.group_id, s.name AS start_name, e.name AS end_name, round(s.score + e.score, 6) AS total, s.dist AS d1, e.dist AS d2 FROM anchors a JOIN pool s ON s.group_id = a.group_id AND s.side = 's' JOIN pool e ON e.group_id = a.group_id AND e.side = 'e'
          WHERE e.frame_idx >= s.frame_idx AND e.frame_idx - s.frame_idx <= 20 * a.fps AND s.score + e.score > -1),
        best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY total DESC, d1, d2) = 1),
        n AS (SELECT group_id, count(*) FILTER (side = 's') AS n_left, count(*) FILTER (side = 'e') AS n_right FROM open GROUP BY group_id)
        SELECT a.group_id AS query_id, coalesce(start_name, a.name) AS start_name, coalesce(end_name, a.name) AS end_name, coalesce(total, 0.0) AS score, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right
        FROM anchors a LEFT JOIN best b USING (group_id) LEFT JOIN n USING (group_id)""",
    "trake_dp": f"""WITH {fx.SCORES}, p AS (SELECT a.group_id, a.video, round(round(a.score + b.score, 6) + c.score, 6) AS total, a.frame_idx AS f1, b.frame_idx AS f2, c.frame_idx AS f3
        FROM scored a JOIN scored b ON a.group_id = b.group_id AND b.event = 1 AND b.frame_idx > a.frame_idx AND b.frame_idx - a.frame_idx <= 20 * a.fps
        JOIN scored c ON c.group_id = b.group_id AND c.event = 2 AND c.frame_idx > b.frame_idx AND c.frame_idx - b.frame_idx <= 20 * b.fps WHERE a.event = 0)
        SELECT group_id, video, total, f1 || ',' || f2 || ',' || f3 AS path FROM p QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY total DESC, f3, f2, f1) = 1""",
    "trake_greedy": f"""WITH {fx.SCORES}, a AS (SELECT * FROM scored WHERE event = 0 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, frame_idx) = 1),
        b AS (SELECT a.group_id, a.video, round(a.score + s.score, 6) AS total, a.frame_idx AS f1, s.frame_idx AS f2 FROM a JOIN scored s ON s.group_id = a.group_id AND s.event = 1 AND s.frame_idx > a.frame_idx AND s.frame_idx - a.frame_idx <= 20 * s.fps
          QUALIFY row_number() OVER (PARTITION BY a.group_id ORDER BY s.score DESC, s.frame_idx) = 1)
        SELECT b.group_id, b.video, round(b.total + s.score, 6) AS total, f1 || ',' || f2 || ',' || s.frame_idx AS path FROM b JOIN scored s ON s.group_id = b.group_id AND s.event = 2 AND s.frame_idx > b.f2 AND s.frame_idx - b.f2 <= 20 * s.fps
          QUALIFY row_number() OVER (PARTITION BY b.group_id ORDER BY s.score DESC, s.frame_idx) = 1""",
    "trake_candidates": f"WITH {fx.SCORES} SELECT group_id, event, video, name, score, row_number() OVER (PARTITION BY group_id, event ORDER BY score DESC, frame_idx) AS rank FROM scored QUALIFY rank <= 10",
}
