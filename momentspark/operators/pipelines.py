"""Compositions: discovery followed by alignment, text entry forms, routing, small set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentspark.functions.text import split_query_text
from momentspark.functions.vectors import dot, readable

from . import search, temporal


def score_of(qvec: Column, vec: Column) -> Column:
    """The score of a frame for an event; -1 if its vector cannot be read or is not as long."""
    return F.when(readable(vec, qvec), F.round(dot(qvec, vec), 6)).otherwise(-1.0)


def score_in_videos(videos: DataFrame, events: DataFrame, frames: DataFrame) -> DataFrame:
    """Scores of the events of a group on the frames of its candidate videos only: the input of the alignments.

    videos: group_id, video. events: group_id, event, qvec. frames: video, name, frame_idx, fps, pos, vec. A frame whose vector cannot be read, or is
    not as long as the event's, scores -1: it stays in the video but is chosen last.
    """
    scored = videos.join(events, "group_id").join(frames, "video")
    return scored.select("group_id", "event", "video", "name", "frame_idx", "fps", "pos", score_of(F.col("qvec"), F.col("vec")).alias("score"))


def _first_in_videos(videos: DataFrame, events: DataFrame, frames: DataFrame) -> DataFrame:
    """The best frame of event 0 in each candidate video (of equal ones the earliest): group_id, video, frame_idx, score. By a streamed top-M whose models
    are the videos; a frame that scores -1 because it cannot be read, or is of another length, competes with what is found."""
    asked = videos.join(events.where("event = 0"), "group_id").select(F.col("group_id").alias("query_id"), F.col("video").alias("model"), "qvec")
    found = search.top_m(frames.select(F.col("video").alias("model"), "name", "video", F.col("frame_idx").alias("pos"), "vec"), asked, 1, tie="pos").select("query_id", "model", "score", F.col("pos").alias("frame_idx"))
    length = F.when(readable(F.col("vec")), F.size("vec")).otherwise(-1)
    earliest = frames.groupBy(F.col("video").alias("model"), length.alias("length")).agg(F.min("frame_idx").alias("frame_idx"))
    unlike = asked.join(earliest, "model").where(~readable(F.col("qvec")) | (F.col("length") != F.size("qvec"))).select("query_id", "model", F.lit(-1.0).alias("score"), F.col("frame_idx").cast("long").alias("frame_idx"))
    best = found.unionByName(unlike).groupBy("query_id", "model").agg(F.max(F.struct("score", (-F.col("frame_idx")).alias("early"))).alias("b"))
    return best.select(F.col("query_id").alias("group_id"), F.col("model").alias("video"), (-F.col("b.early")).alias("frame_idx"), F.col("b.score").alias("score"))


def score_after_first(videos: DataFrame, events: DataFrame, frames: DataFrame, n_events: int, gap_s: float) -> DataFrame:
    """Of `score_in_videos`, what a greedy alignment can look at: the best frame of event 0, and frames of later events as far behind it as all gaps reach."""
    first = _first_in_videos(videos, events, frames)
    width = frames.groupBy("video").agg(F.greatest(gap_s * (n_events - 1) * F.max("fps"), F.lit(1.0)).alias("width"))
    bucket = lambda c: F.floor(F.col(c) / F.col("width"))
    starts = first.join(width, "video").select("group_id", "video", F.col("frame_idx").alias("start"), "width", F.explode(F.array(bucket("frame_idx"), bucket("frame_idx") + 1)).alias("bucket"))
    near = starts.join(frames.join(width, "video").withColumn("bucket", bucket("frame_idx")).drop("width"), ["video", "bucket"]).where("frame_idx > start and frame_idx <= start + width")
    later = near.join(events.where(f"event between 1 and {n_events - 1}"), "group_id").select("group_id", "event", "video", "frame_idx", "fps", score_of(F.col("qvec"), F.col("vec")).alias("score"))
    return later.unionByName(first.select("group_id", F.lit(0).alias("event"), "video", "frame_idx", F.lit(None).cast("double").alias("fps"), "score"))


def discover_and_align(results: DataFrame, events: DataFrame, frames: DataFrame, n_events: int, gap_s: float = 60, top_videos: int = 5, min_score: float = 0.0, exact: bool = False, rates: tuple[float, ...] = (25.0, 30.0)) -> DataFrame:
    """Ordered events without a given video: group_id, video, frequency, total, path.

    results: group_id, event, video, name, score of each event's search. Videos hit by most events are aligned, greedily or
    (`exact`) by dynamic programming; those where an event has no frame drop out.
    """
    top = search.discover_videos(results, min_score, part="event").where(F.col("rank") <= top_videos)
    videos = top.select("group_id", "video")
    if exact and gap_s:
        paths = temporal.align_frames(videos, events, frames, n_events, gap_s)
    elif exact:
        paths = temporal.align_dp(score_in_videos(videos, events, frames), n_events, gap_s, list(rates))
    else:
        scored = score_after_first(videos, events, frames, n_events, gap_s) if gap_s else score_in_videos(videos, events, frames)
        paths = temporal.align_greedy(scored, n_events, gap_s)
    return paths.join(top.select("group_id", "video", "frequency"), ["group_id", "video"])


def discover_pairs(results: DataFrame, events: DataFrame, frames: DataFrame, gap_s: float = 20, max_frames: int = 20, threshold: float = 0.1, top_videos: int = 5) -> DataFrame:
    """Start and end of a moment in the videos that both parts hit most: group_id, video, start_name, end_name, score, n_left, n_right."""
    top = search.discover_videos(results, threshold, part="event").where(F.col("rank") <= top_videos)
    key = F.concat_ws("/", F.col("group_id").cast("string"), "video").alias("query_id")
    anchors = top.select("group_id", "video", F.col("anchor_name").alias("name")).join(frames.select("name", "frame_idx", "fps", "pos"), "name")
    # a pair lies within `max_frames` places of its anchor: only these frames are joined, by places, and scored
    places = anchors.select("group_id", "video", F.col("pos").alias("anchor_pos"), F.explode(F.sequence(F.col("pos") - max_frames, F.col("pos") + max_frames)).alias("pos"))
    side = F.when(F.col("event") == 0, F.col("pos") <= F.col("anchor_pos")).otherwise(F.col("pos") >= F.col("anchor_pos"))
    near = places.join(frames, ["video", "pos"]).join(events.where("event in (0, 1)"), "group_id").where(side)
    scored = near.select("group_id", "event", "video", "name", "frame_idx", "fps", "pos", "anchor_pos", score_of(F.col("qvec"), F.col("vec")).alias("score"))
    dist = F.abs(F.col("pos") - F.col("anchor_pos")).cast("int").alias("dist")
    start = scored.where("event = 0 and pos <= anchor_pos").select(key, F.lit("start").alias("side"), dist, "name", "frame_idx", "score")
    end = scored.where("event = 1 and pos >= anchor_pos").select(key, F.lit("end").alias("side"), dist, "name", "frame_idx", "score")
    pairs = temporal.best_pair(start.union(end), anchors.select(key, "name", "frame_idx", "fps"), gap_s, max_frames, threshold)
    parts = F.split("query_id", "/", 2)
    return pairs.select(parts[0].cast("long").alias("group_id"), parts[1].alias("video"), "start_name", "end_name", "score", "n_left", "n_right")


def text_parts(requests: DataFrame, least: int = 2, exactly: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(parts: group_id, event, query; errors: group_id, error) of one-line requests (group_id, text)."""
    p = requests.select("group_id", split_query_text(F.col("text")).alias("parts"))
    good = F.size("parts") == exactly if exactly else F.size("parts") >= least
    error = F.concat(F.lit(f"needs {'exactly ' if exactly else ''}{exactly or least} parts, has "), F.size("parts").cast("string"))
    return p.where(good).select("group_id", F.posexplode("parts").alias("event", "query")), p.where(~good).select("group_id", error.alias("error"))


def route(requests: DataFrame) -> DataFrame:
    """Adds mode: split filters (asr_filter, ocr_filter) win over the older text_filter; both split ones make 'mixed'."""
    on = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return requests.withColumn("mode", F.when(on("asr_filter") & on("ocr_filter"), "mixed").when(on("asr_filter"), "asr").when(on("ocr_filter"), "ocr").when(on("text_filter"), "text").otherwise("none"))


def in_corpus(hits: DataFrame, frames: DataFrame) -> DataFrame:
    """Hits whose video has frames."""
    return hits.join(frames.select("video").distinct(), "video", "left_semi")


def focus(results: DataFrame, videos: list[str]) -> DataFrame:
    """Results of these videos; all of them for an empty list."""
    return results.where(F.col("video").isin(videos)) if videos else results


def coverage(queries: DataFrame, references: DataFrame, key: str = "query_id") -> DataFrame:
    """Queries without a reference: a run may start when there are none."""
    return queries.join(references.select(key), key, "left_anti")


def restorable(audit: DataFrame) -> DataFrame:
    """Adds n_restorable: answers listed in the JSON `detail`, 0 once restored or where none can be read."""
    answers = F.from_json("detail", "answers array<struct<id: bigint>>, restored boolean")
    return audit.withColumn("n_restorable", F.when(F.coalesce(answers["restored"], F.lit(False)), 0).otherwise(F.greatest(F.lit(0), F.coalesce(F.size(answers["answers"]), F.lit(0)))))


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of a key; of equally frequent ones the least."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).alias("top")).select(key, F.col(f"top.{value}").alias(value), (-F.col("top.n")).alias("n"))


def run_progress(results: DataFrame) -> DataFrame:
    """Completed and failed per run and the run's status."""
    n = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    left = F.col("total") - F.col("completed") - F.col("failed")
    return n.withColumn("status", F.when(left > 0, "running").when(F.col("failed") == 0, "completed").when(F.col("completed") == 0, "failed").otherwise("completed_with_errors"))
