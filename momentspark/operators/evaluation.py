"""Scoring of ranked retrieval: hits, reciprocal ranks, interval scores, latencies, summaries, pooled runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentspark.functions.vectors import readable

from . import search

CUTOFFS = (1, 5, 20, 50, 100)


def first_rank_videos(ranked: DataFrame, frames: int = 3) -> DataFrame:
    """Videos by the rank of their first frame: query_id, video, video_rank, frames (their first names)."""
    first = ranked.groupBy("query_id", "video").agg(F.min("rank").alias("first"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), 1, frames).alias("frames"))
    return first.withColumn("video_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def score_videos(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds to each query (query_id, truth_video) video_rank (null if not found) and reciprocal_rank (then 0)."""
    found = first_rank_videos(ranked).select("query_id", F.col("video").alias("truth_video"), "video_rank")
    return queries.join(found, ["query_id", "truth_video"], "left").withColumn("reciprocal_rank", F.coalesce(1 / F.col("video_rank"), F.lit(0.0)))


def score_intervals(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds hit_rank and hit_interval: the first ranked frame of the right video inside a valid interval (ends included).

    queries: query_id, truth_video, intervals array<struct<start,end>>; ranked: query_id, video, rank, frame_idx. Frames
    without an index are skipped; of several intervals the first counts. final_score is the mean over CUTOFFS of rank <= cutoff.
    """
    spans = queries.select("query_id", "truth_video", F.posexplode("intervals").alias("i", "span"))
    r = ranked.where("frame_idx is not null").select("query_id", F.col("video").alias("truth_video"), "rank", "frame_idx")
    hits = r.join(spans, ["query_id", "truth_video"]).where(F.col("frame_idx").between(F.col("span.start"), F.col("span.end")))
    first = hits.groupBy("query_id").agg(F.min(F.struct("rank", "i")).alias("h")).select("query_id", F.col("h.rank").alias("hit_rank"), F.col("h.i").alias("hit_interval"))
    share = sum((F.coalesce(F.col("hit_rank") <= c, F.lit(False)).cast("double") for c in CUTOFFS), F.lit(0.0)) / len(CUTOFFS)
    return queries.join(first, "query_id", "left").withColumn("final_score", share)


def _share(condition: Column) -> Column:
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), 6)


def video_metrics() -> list[Column]:
    """Aggregates over results (status, video_rank, reciprocal_rank); failed queries stay in the denominators."""
    done = F.col("status") == "completed"
    rank = F.when(done, F.col("video_rank"))
    return [
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), _share(rank <= 1).alias("hit_1"),
        *(_share(rank <= k).alias(f"recall_{k}") for k in (3, 5, 10)), F.round(F.avg(F.when(done, F.col("reciprocal_rank")).otherwise(0.0)), 6).alias("mrr"),
        F.percentile(rank, F.lit(0.5)).alias("median_rank"), F.count_if(done & F.col("video_rank").isNull()).alias("not_retrieved"),
    ]


def interval_metrics() -> list[Column]:
    """Aggregates over the queries that have intervals (all but trake); null where a set holds none. Failed queries count as misses."""
    done, scored = F.col("status") == "completed", F.lower("task_type") != "trake"
    hit = F.when(done, F.col("hit_rank"))
    share = lambda c: F.round(F.avg(F.when(scored, F.coalesce(c, F.lit(False)).cast("double"))), 6)
    miss = F.count_if(scored & done & F.col("video_rank").isNotNull() & F.col("hit_rank").isNull())
    return [
        F.round(F.avg(F.when(scored, F.when(done, F.col("final_score")).otherwise(0.0))), 6).alias("final_score"), *(share(hit <= c).alias(f"r_{c}") for c in CUTOFFS),
        share(hit.isNotNull()).alias("hit_rate"), F.when(F.count_if(scored) > 0, miss).alias("video_hit_interval_miss"),
    ]


def latency_metrics(limit_ms: float = 10_000) -> list[Column]:
    """Median, 95th percentile and greatest latency of completed queries (linear interpolation), and the share of all within the limit."""
    ms = F.when(F.col("status") == "completed", F.col("latency_ms"))
    return [*(F.round(F.percentile(ms, F.lit(p)), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.95)), F.max(ms).alias("max_ms"), _share(ms <= limit_ms).alias("within_limit")]


def run_summary(results: DataFrame) -> DataFrame:
    """The metrics of each run by set: each task type, 'kis+qa' (the headline) and 'all'; from one pass, each result counting in its sets."""
    sets = F.array_compact(F.array(F.col("task_type"), F.lit("all"), F.when(F.lower("task_type").isin("kis", "qa"), "kis+qa")))
    out = results.withColumn("set", F.explode(sets)).groupBy("run_id", "set").agg(*video_metrics(), *interval_metrics())
    return out.withColumnRenamed("set", "task_type")


def latency_outliers(results: DataFrame, times: float = 3, least_ms: float = 3000) -> DataFrame:
    """Adds outlier: more than `times` the run's median and more than `least_ms`."""
    median = results.where("status = 'completed'").groupBy("run_id").agg(F.percentile("latency_ms", F.lit(0.5)).alias("median"))
    return results.join(median, "run_id", "left").withColumn("outlier", F.coalesce((F.col("latency_ms") > times * F.col("median")) & (F.col("latency_ms") > least_ms), F.lit(False)))


def verdict() -> Column:
    """The slice that a result belongs to."""
    return F.when(F.col("status") != "completed", "failed").when(F.col("video_rank").isNull(), "video-miss").when(F.col("hit_rank").isNull(), "video-hit-interval-miss").otherwise("hit")


def pooled(summaries: DataFrame, value: str = "final_score", weight: str = "total") -> DataFrame:
    """Runs with one configuration (sha-256 of its JSON) pooled: fingerprint, runs, value weighted by scored queries."""
    f = F.sha2("config", 256)
    return summaries.groupBy(f.alias("fingerprint")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias(value))


def benchmark_run(vectors: DataFrame, queries: DataFrame, references: DataFrame, frames: DataFrame, weights: dict[str, float], k: int = 100, m: int = 50) -> DataFrame:
    """All queries of runs as one job: run_id, query_id, task_type, truth_video, intervals, status, error, video_rank, reciprocal_rank, hit_rank, hit_interval, final_score.

    queries: run_id, query_id, task_type, model, qvec. references: query_id, truth_video, intervals; they are frozen into the results, and a query without one fails. So
    does one whose vector cannot be read for a model, or is not as long as most of the model's. What fails is a row with the reason and does not touch the others. The rest is searched by every
    model, reranked and fused. frames: name, frame_idx. trake queries have no interval scores.
    """
    dims = vectors.where(readable(F.col("vec"))).groupBy("model").agg(F.mode(F.size("vec"), True).alias("dim"))
    bad = ~readable(F.col("qvec")) | F.coalesce(F.size("qvec") != F.col("dim"), F.lit(False))
    q = queries.join(dims, "model", "left").groupBy("run_id", "query_id", "task_type").agg(F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("model")))), ",").alias("bad"))
    q = q.join(references.select("query_id", "truth_video", "intervals"), "query_id", "left")
    error = F.when(F.col("truth_video").isNull(), "no reference").when(F.col("bad") != "", F.concat(F.lit("unreadable vector: "), "bad"))
    judged = q.withColumn("error", error).drop("bad")
    good = judged.where("error is null")
    asked = queries.join(good.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "model", "qvec").dropDuplicates(["query_id", "model"])
    ranked = search.ensemble_search(vectors, asked, weights, k, m).join(frames.select("name", "frame_idx"), "name", "left")
    truth = good.select("query_id", "truth_video", "intervals").dropDuplicates(["query_id"])
    scored = score_videos(truth.drop("intervals"), ranked).join(score_intervals(truth, ranked).select("query_id", "hit_rank", "hit_interval", "final_score"), "query_id").drop("truth_video")
    out = judged.join(scored, "query_id", "left").withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed"))
    timed = F.lower("task_type") != "trake"
    return out.withColumns({c: F.when(timed, F.col(c)) for c in ("hit_rank", "hit_interval", "final_score")})
