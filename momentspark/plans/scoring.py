"""Registered queries on evaluation and candidate expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentspark.operators import evaluation as ev
from momentspark.operators import expansion as ex
from momentspark.operators import search

from . import fixtures as fx
from .fixtures import read
from .retrieval import RERANK, TOP, M, _fused


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    found = search.ensemble_search(fx.vectors(spark, d), fx.queries(spark, d), fx.WEIGHTS, 50, M, use_rerank=False)
    return found.join(fx.keyframes(spark, d).select("name", "frame_idx"), "name")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """The queries with truth two frames after their own: intervals of 80 frames around it, and of 40 around the one ten frames on."""
    k = fx.keyframes(spark, d).where("vec_id % 20 = 0")
    mid = F.col("frame_idx") + 80
    spans = F.array(F.struct((mid - 80).alias("start"), (mid + 80).alias("end")), F.struct((mid + 360).alias("start"), (mid + 440).alias("end")))
    return k.select(F.col("vec_id").alias("query_id"), F.col("video").alias("truth_video"), spans.alias("intervals"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    truth, ranked = _truth(spark, d), _ranked(spark, d)
    scored = ev.score_videos(truth.drop("intervals"), ranked).join(ev.score_intervals(truth, ranked).drop("truth_video", "intervals"), "query_id")
    kind = F.when(F.col("query_id") % 3 == 0, "qa").when(F.col("query_id") % 8 == 0, "trake").otherwise("kis")
    status = F.when(F.col("query_id") % 7 == 0, "failed").otherwise("completed")
    return scored.select("*", (F.col("query_id") % 2).alias("run_id"), kind.alias("task_type"), status.alias("status"))


def first_rank_videos(spark: SparkSession, d: str) -> DataFrame:
    return ev.first_rank_videos(_ranked(spark, d)).withColumn("frames", F.array_join("frames", ","))


def interval_scoring(spark: SparkSession, d: str) -> DataFrame:
    return ev.score_intervals(_truth(spark, d), _ranked(spark, d)).drop("intervals")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.run_summary(_results(spark, d))


def benchmark_run(spark: SparkSession, d: str) -> DataFrame:
    """The queries as two runs; some have no reference, some a vector that is cut short or null."""
    kind = F.when(F.col("query_id") % 3 == 0, "qa").when(F.col("query_id") % 8 == 0, "trake").otherwise("kis")
    broken = F.when((F.col("query_id") % 70 == 0) & (F.col("model") == "low"), F.lit(None)).when((F.col("query_id") % 110 == 0) & (F.col("model") == "high"), F.slice("qvec", 1, 5)).otherwise(F.col("qvec"))
    q = fx.queries(spark, d).select((F.col("query_id") % 2).alias("run_id"), "query_id", kind.alias("task_type"), "model", broken.alias("qvec"))
    out = ev.benchmark_run(fx.vectors(spark, d), q, _truth(spark, d).where("query_id % 9 <> 0"), fx.keyframes(spark, d), fx.WEIGHTS, 50, M)
    return out.select("run_id", "query_id", "task_type", "truth_video", "status", "error", "video_rank", F.round("reciprocal_rank", 9).alias("reciprocal_rank"), "hit_rank", "final_score")


def result_slices(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy("run_id", ev.verdict().alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("run_id"), "event_id", (F.col("value") * 40).alias("latency_ms"), F.when(F.col("event_id") % 11 == 0, "failed").otherwise("completed").alias("status"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _timed(spark, d).groupBy("run_id").agg(*ev.latency_metrics())


def latency_outliers(spark: SparkSession, d: str) -> DataFrame:
    return ev.latency_outliers(_timed(spark, d)).groupBy("run_id").agg(F.count_if("outlier").alias("n_outliers"))


def pooled_score(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("final_score"), F.count(F.lit(1)).alias("total"))
    return ev.pooled(o.withColumn("config", F.concat(F.lit('{"p":"'), "o_orderpriority", F.lit('"}')))).withColumn("final_score", F.round("final_score", 3))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Line items as anchors of their order's task: of those with one line number, the least part."""
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    li = read(spark, d, "lineitem").withColumn("i", first).where("i = 1")
    direction = F.when(F.col("l_returnflag") == "A", "up").when(F.col("l_returnflag") == "R", "down").otherwise("both")
    return li.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("anchor"), (F.col("l_suppkey") % 3).cast("string").alias("video"), (F.col("l_partkey") % 200).alias("frame"), F.floor("l_quantity").cast("int").alias("step"), direction.alias("direction"), (F.col("l_partkey") % 400).alias("reach"), F.lit(20).alias("need"))


def anchor_spread(spark: SparkSession, d: str) -> DataFrame:
    a = _anchors(spark, d)
    return ex.anchor_spread(a, a.select("task_id", "video", "frame"))


def event_variants(spark: SparkSession, d: str) -> DataFrame:
    a = _anchors(spark, d)
    return ex.event_variants(a.select("task_id", F.col("anchor").alias("event"), F.col("frame").alias("anchor"), (F.col("frame") - F.col("reach")).alias("lo"), (F.col("frame") + F.col("reach")).alias("hi"), "direction", F.lit(7).alias("want")))


def uniform_step(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.floor(F.abs("c_acctbal") / 5).alias("half"), (F.col("c_nationkey") + 5).alias("need"))
    return ex.uniform_step(o)


def bisection_spread(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "part").select(F.col("p_partkey").alias("range_id"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size") * 10).alias("hi"), F.lit(9).alias("k"))
    return ex.bisection(o, 9)


def _plans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as anchors of tasks, about three each, and for each task windows of two or all three events as its first anchor has them."""
    frames = F.array(F.col("o_custkey"), F.col("o_custkey") + 100, F.col("o_custkey") + 300)
    a = read(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 12).alias("task_id"), F.col("o_orderkey").alias("anchor"), (F.col("o_orderkey") % 2).cast("string").alias("video"), frames.alias("frames"))
    first = a.groupBy("task_id").agg(F.min_by("frames", "anchor").alias("f"))
    window = lambda i, lo, hi, mode: F.struct((F.col("f")[i] - lo).alias("lo"), (F.col("f")[i] + hi).alias("hi"), F.lit(mode).alias("mode"))
    windows = F.array(window(0, 60, F.col("task_id") % 5, "both"), window(1, 3, 1, "up"), window(2, 7, 140, "down"))
    return a, first.select("task_id", (F.col("task_id") % 4 * 15).alias("need"), F.when(F.col("task_id") % 3 == 0, F.slice(windows, 1, 2)).otherwise(windows).alias("windows"))


def event_plan(spark: SparkSession, d: str) -> DataFrame:
    a, ranges = _plans(spark, d)
    return ex.event_plan(a, ranges, a).withColumn("frames", F.array_join("frames", ","))


RANKED = TOP + ", " + _fused("hits", 50) + ", ranked AS (SELECT f.query_id, f.name, f.video, f.rank, k.frame_idx FROM fused f JOIN keyframes k USING (name)), truth AS (SELECT vec_id AS query_id, video AS truth_video, frame_idx + 80 AS mid FROM keyframes WHERE vec_id % 20 = 0)"
RESULTS = RANKED + """, fv AS (SELECT query_id, video, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS video_rank, string_agg(name, ',' ORDER BY rank) AS all_names FROM ranked GROUP BY query_id, video),
hit AS (SELECT r.query_id, min(r.rank) AS hit_rank FROM ranked r JOIN truth t ON t.query_id = r.query_id AND t.truth_video = r.video WHERE r.frame_idx BETWEEN t.mid - 80 AND t.mid + 80 OR r.frame_idx BETWEEN t.mid + 360 AND t.mid + 440 GROUP BY r.query_id),
res AS (SELECT t.query_id, t.truth_video, t.query_id % 2 AS run_id, CASE WHEN t.query_id % 3 = 0 THEN 'qa' WHEN t.query_id % 8 = 0 THEN 'trake' ELSE 'kis' END AS task_type, CASE WHEN t.query_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
  fv.video_rank, h.hit_rank, (CAST(coalesce(hit_rank <= 1, false) AS INT) + CAST(coalesce(hit_rank <= 5, false) AS INT) + CAST(coalesce(hit_rank <= 20, false) AS INT) + CAST(coalesce(hit_rank <= 50, false) AS INT) + CAST(coalesce(hit_rank <= 100, false) AS INT)) / 5.0::DOUBLE AS final_score
  FROM truth t LEFT JOIN fv ON fv.query_id = t.query_id AND fv.video = t.truth_video LEFT JOIN hit h ON h.query_id = t.query_id)"""
_ok, _scored = "status = 'completed'", "task_type <> 'trake'"
SUMMARY = f"""count(*) AS total, count(*) FILTER ({_ok}) AS completed, count(*) FILTER (NOT {_ok}) AS failed,
{', '.join(f"round(avg(CASE WHEN {_ok} AND video_rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS {n}" for k, n in ((1, 'hit_1'), (3, 'recall_3'), (5, 'recall_5'), (10, 'recall_10')))},
round(avg(CASE WHEN {_ok} THEN coalesce(1.0::DOUBLE / video_rank, 0) ELSE 0 END), 6) AS mrr, quantile_cont(video_rank, 0.5) FILTER ({_ok}) AS median_rank, count(*) FILTER ({_ok} AND video_rank IS NULL) AS not_retrieved,
round(avg(CASE WHEN {_ok} THEN final_score ELSE 0 END) FILTER ({_scored}), 6) AS final_score,
{', '.join(f"round(avg(CASE WHEN {_ok} AND hit_rank <= {c} THEN 1.0::DOUBLE ELSE 0 END) FILTER ({_scored}), 6) AS r_{c}" for c in ev.CUTOFFS)},
round(avg(CASE WHEN {_ok} AND hit_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER ({_scored}), 6) AS hit_rate,
CASE WHEN count(*) FILTER ({_scored}) > 0 THEN count(*) FILTER ({_scored} AND {_ok} AND video_rank IS NOT NULL AND hit_rank IS NULL) END AS video_hit_interval_miss"""
TIMED = "t AS (SELECT event_type AS run_id, value * 40 AS latency_ms, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events)"
ANCHORS = """a AS (SELECT l_orderkey AS task_id, l_linenumber AS anchor, CAST(l_suppkey % 3 AS VARCHAR) AS video, l_partkey % 200 AS frame, CAST(floor(l_quantity) AS INT) AS step,
  CASE l_returnflag WHEN 'A' THEN 'up' WHEN 'R' THEN 'down' ELSE 'both' END AS direction, l_partkey % 400 AS reach FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"""
QUERIES = {f.__name__: f for f in (first_rank_videos, interval_scoring, benchmark_run, run_summary, result_slices, latency_percentiles, latency_outliers, pooled_score, anchor_spread, event_variants, uniform_step, bisection_spread, event_plan)}
ORACLE_SQL = {
    "first_rank_videos": f"WITH {RESULTS} SELECT query_id, video, video_rank, array_to_string(list_slice(string_split(all_names, ','), 1, 3), ',') AS frames FROM fv",
    "interval_scoring": f"""WITH {RESULTS} SELECT r.query_id, r.truth_video, r.hit_rank, CASE WHEN x.frame_idx BETWEEN t.mid - 80 AND t.mid + 80 THEN 0 WHEN x.frame_idx IS NOT NULL THEN 1 END AS hit_interval, r.final_score
        FROM res r JOIN truth t USING (query_id) LEFT JOIN ranked x ON x.query_id = r.query_id AND x.rank = r.hit_rank""",
    "benchmark_run": f"""WITH {RERANK}, {_fused('reranked', 50)}, ranked AS (SELECT f.query_id, f.name, f.video, f.rank, k.frame_idx FROM fused f JOIN keyframes k USING (name)), truth AS (SELECT vec_id AS query_id, video AS truth_video, frame_idx + 80 AS mid FROM keyframes WHERE vec_id % 20 = 0),
        fv AS (SELECT query_id, video, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS video_rank FROM ranked GROUP BY query_id, video),
        hit AS (SELECT r.query_id, min(r.rank) AS hit_rank FROM ranked r JOIN truth t ON t.query_id = r.query_id AND t.truth_video = r.video WHERE r.frame_idx BETWEEN t.mid - 80 AND t.mid + 80 OR r.frame_idx BETWEEN t.mid + 360 AND t.mid + 440 GROUP BY r.query_id),
        j AS (SELECT t.query_id, CASE WHEN t.query_id % 9 <> 0 THEN truth_video END AS truth_video, CASE WHEN t.query_id % 9 = 0 THEN 'no reference' WHEN t.query_id % 70 = 0 AND t.query_id % 110 = 0 THEN 'unreadable vector: high,low'
            WHEN t.query_id % 70 = 0 THEN 'unreadable vector: low' WHEN t.query_id % 110 = 0 THEN 'unreadable vector: high' END AS error, CASE WHEN t.query_id % 3 = 0 THEN 'qa' WHEN t.query_id % 8 = 0 THEN 'trake' ELSE 'kis' END AS task_type FROM truth t)
        SELECT j.query_id % 2 AS run_id, j.query_id, task_type, j.truth_video, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error, CASE WHEN error IS NULL THEN video_rank END AS video_rank,
          CASE WHEN error IS NULL THEN round(coalesce(1.0::DOUBLE / video_rank, 0), 9) END AS reciprocal_rank, CASE WHEN error IS NULL AND task_type <> 'trake' THEN hit_rank END AS hit_rank,
          CASE WHEN error IS NULL AND task_type <> 'trake' THEN (CAST(coalesce(hit_rank <= 1, false) AS INT) + CAST(coalesce(hit_rank <= 5, false) AS INT) + CAST(coalesce(hit_rank <= 20, false) AS INT) + CAST(coalesce(hit_rank <= 50, false) AS INT) + CAST(coalesce(hit_rank <= 100, false) AS INT)) / 5.0::DOUBLE END AS final_score
        FROM j LEFT JOIN fv ON fv.query_id = j.query_id AND fv.video = j.truth_video LEFT JOIN hit ON hit.query_id = j.query_id""",
    "run_summary": f"WITH {RESULTS} SELECT run_id, task_type, {SUMMARY} FROM res GROUP BY run_id, task_type UNION ALL SELECT run_id, 'all', {SUMMARY} FROM res GROUP BY run_id UNION ALL SELECT run_id, 'kis+qa', {SUMMARY} FROM res WHERE task_type <> 'trake' GROUP BY run_id",
    "result_slices": f"WITH {RESULTS} SELECT run_id, CASE WHEN status <> 'completed' THEN 'failed' WHEN video_rank IS NULL THEN 'video-miss' WHEN hit_rank IS NULL THEN 'video-hit-interval-miss' ELSE 'hit' END AS verdict, count(*) AS n FROM res GROUP BY ALL",
    "latency_percentiles": f"""WITH {TIMED} SELECT run_id, round(quantile_cont(latency_ms, 0.5) FILTER ({_ok}), 6) AS p50, round(quantile_cont(latency_ms, 0.95) FILTER ({_ok}), 6) AS p95, max(latency_ms) FILTER ({_ok}) AS max_ms,
        round(avg(CASE WHEN {_ok} AND latency_ms <= 10000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_limit FROM t GROUP BY run_id""",
    "latency_outliers": f"WITH {TIMED}, m AS (SELECT run_id, quantile_cont(latency_ms, 0.5) AS median FROM t WHERE {_ok} GROUP BY run_id) SELECT run_id, count(*) FILTER (latency_ms > 3 * median AND latency_ms > 3000) AS n_outliers FROM t JOIN m USING (run_id) GROUP BY run_id",
    "pooled_score": """WITH o AS (SELECT o_orderpriority, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus)
        SELECT sha256('{"p":"' || o_orderpriority || '"}') AS fingerprint, count(*) AS runs, round(round(sum(v * n) / sum(n), 6), 3) AS final_score FROM o GROUP BY o_orderpriority""",
    "bisection_spread": """WITH f AS (SELECT 0 AS i, 0.0::DOUBLE AS f UNION ALL SELECT 1, 1.0 UNION ALL SELECT 1 + (1 << (lv - 1)) + k, (2 * k + 1) / (1 << lv)::DOUBLE FROM (SELECT unnest(range(1, 6)) AS lv) l, (SELECT unnest(range(0, 16)) AS k) k WHERE k < 1 << (lv - 1)),
        p AS (SELECT p_partkey AS range_id, CAST(floor(p_partkey + f * p_size * 10) AS BIGINT) AS frame, min(i) AS i FROM part, f GROUP BY ALL)
        SELECT range_id, row_number() OVER (PARTITION BY range_id ORDER BY i) AS "order", frame FROM p QUALIFY "order" <= 9""",
    "uniform_step": """WITH o AS (SELECT c_custkey AS task_id, floor(abs(c_acctbal) / 5) AS half, c_nationkey + 5 AS need FROM customer)
        SELECT task_id, coalesce(max(step) FILTER (2 * floor(half / step) >= need), 1) AS step FROM o, (SELECT unnest(range(1, 2001)) AS step) GROUP BY task_id""",
    "anchor_spread": f"""WITH {ANCHORS}, steps AS (SELECT unnest(range(1, 21 + (SELECT max(n) FROM (SELECT count(*) AS n FROM a GROUP BY task_id)))) AS k),
        k AS (SELECT a.*, k.k, s.sign, frame + s.sign * k.k * step AS spot FROM a, steps k, (VALUES (1), (-1)) s(sign)
          WHERE step > 0 AND (reach = 0 OR k.k * step <= reach) AND (direction = 'both' OR (direction = 'up') = (s.sign = 1)) AND frame + s.sign * k.k * step >= 0),
        n AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM a e WHERE e.task_id = k.task_id AND e.video = k.video AND e.frame = k.spot)),
        f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY task_id, video, spot ORDER BY k, sign DESC, anchor) = 1)
        SELECT task_id, anchor, video, spot AS frame, row_number() OVER (PARTITION BY task_id ORDER BY k, sign DESC, anchor) AS rank FROM f QUALIFY rank <= 20""",
    "event_plan": """WITH a AS (SELECT o_orderkey // 12 AS task_id, o_orderkey AS anchor, CAST(o_orderkey % 2 AS VARCHAR) AS video, [o_custkey, o_custkey + 100, o_custkey + 300] AS frames FROM orders),
        t AS (SELECT task_id, arg_min(frames, anchor) AS f, count(*) AS n_anchors, task_id % 4 * 15 AS need, CASE WHEN task_id % 3 = 0 THEN 2 ELSE 3 END AS n_windows FROM a GROUP BY task_id),
        w AS (SELECT *, [f[1] - 60, f[2] - 3, f[3] - 7] AS los, [f[1] + task_id % 5, f[2] + 1, f[3] + 140] AS his FROM t),
        e AS (SELECT a.task_id, a.anchor, a.video, a.frames, w.need, e.event, p.dense, a.frames[e.event + 1] AS base, los[e.event + 1] + a.frames[e.event + 1] - f[e.event + 1] AS lo, his[e.event + 1] + a.frames[e.event + 1] - f[e.event + 1] AS hi,
            CASE WHEN p.dense = 1 THEN need * 8 + 64 ELSE CAST(ceil(need / (n_anchors * n_windows)::DOUBLE) AS BIGINT) END AS want
          FROM a JOIN w USING (task_id), (VALUES (0), (1), (2)) e(event), (VALUES (0), (1)) p(dense) WHERE e.event < n_windows AND need > 0),
        c AS (SELECT *, CASE WHEN event = 1 THEN greatest(0, lo, base) ELSE greatest(0, lo) END AS x, CASE WHEN event = 2 THEN least(hi, base) ELSE hi END AS z FROM e),
        n AS (SELECT *, least(want, z - x + 1) AS n FROM c WHERE z >= x),
        v AS (SELECT DISTINCT task_id, anchor, video, frames, need, event, dense, base, CASE WHEN n = 1 OR x = z THEN x ELSE CAST(round_even(x + i * (z - x) / (n - 1)::DOUBLE, 0) AS BIGINT) END AS new FROM n, (SELECT unnest(range(0, 1000)) AS i) WHERE i < n),
        k AS (SELECT *, row_number() OVER (PARTITION BY task_id, anchor, dense, event ORDER BY abs(new - base), new) AS k FROM v WHERE new <> base),
        i AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY task_id, dense ORDER BY k, event, anchor) <= need * 8 + 64),
        r AS (SELECT task_id, anchor, video, need, dense, k, event, list_concat(frames[1:event], [new], frames[event + 2:]) AS frames FROM i),
        u AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.task_id = r.task_id AND a.video = r.video AND a.frames = r.frames) QUALIFY row_number() OVER (PARTITION BY task_id, video, frames ORDER BY dense, k, event, anchor) = 1)
        SELECT task_id, anchor, video, array_to_string(frames, ',') AS frames, row_number() OVER (PARTITION BY task_id ORDER BY dense, k, event, anchor) AS rank FROM u QUALIFY rank <= need""",
    "event_variants": f"""WITH {ANCHORS}, b AS (SELECT task_id, anchor AS event, frame AS anchor, CASE WHEN direction = 'up' THEN frame ELSE greatest(0, frame - reach) END AS lo, CASE WHEN direction = 'down' THEN frame ELSE frame + reach END AS hi FROM a),
        c AS (SELECT *, least(7, hi - lo + 1) AS n FROM b), p AS (SELECT DISTINCT task_id, event, anchor, CASE WHEN n = 1 OR lo = hi THEN lo ELSE CAST(round_even(lo + i * (hi - lo) / (n - 1)::DOUBLE, 0) AS BIGINT) END AS frame FROM c, (SELECT unnest(range(0, 7)) AS i) WHERE i < n)
        SELECT *, row_number() OVER (PARTITION BY task_id, event ORDER BY abs(frame - anchor), frame) AS "order" FROM p WHERE frame <> anchor""",
}
