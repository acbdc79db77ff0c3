"""Operators along a video's time line: interval and nearest-time joins, neighbours, cuts, scenes, samples, merged intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(frames: DataFrame, windows: DataFrame, pad_s: float = 5.0, bucket_s: int = 60) -> DataFrame:
    """Frames with the padded windows that hold them: video, name, n_windows, text (distinct texts in order of start, joined by spaces).

    frames: video, name, t (seconds). windows: video, doc_id, start_s, end_s, text. Both sides meet by (video, time bucket), so
    a long video is dealt over tasks; a window goes to each bucket that it reaches.
    """
    bucket = lambda c: F.floor(c / bucket_s).cast("long")
    w = windows.withColumn("a", F.col("start_s") - pad_s).withColumn("z", F.col("end_s") + pad_s)
    w = w.withColumn("bucket", F.explode(F.sequence(bucket(F.col("a")), bucket(F.col("z")))))
    f = frames.select("video", "name", "t").withColumn("bucket", bucket(F.col("t")))
    met = f.join(w, ["video", "bucket"]).where((F.col("a") <= F.col("t")) & (F.col("t") <= F.col("z")))
    parts = F.array_sort(F.collect_list(F.struct("start_s", "doc_id", "text")))
    out = met.groupBy("video", "name").agg(parts.alias("parts"))
    return out.select("video", "name", F.size("parts").alias("n_windows"), F.array_join(F.array_distinct(F.transform("parts", lambda x: x["text"])), " ").alias("text"))


def around(probes: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds to each probe (video, x) the frame at or before x (before) and at or after x (after), as frame_idx and name.

    Both tables are sorted together by (video, x) once; no pair of rows is made. Probes of a video without frames get nulls.
    """
    cols = [c for c in probes.columns if c not in ("video", "x")]
    f = frames.select("video", F.col("frame_idx").cast("double").alias("x"), F.struct("frame_idx", "name").alias("frame"), F.lit(None).cast(probes.select(F.struct(*cols)).schema[0].dataType).alias("probe"))
    p = probes.select("video", F.col("x").cast("double").alias("x"), F.lit(None).cast(f.schema["frame"].dataType).alias("frame"), F.struct(*cols).alias("probe"))
    w = Window.partitionBy("video")
    back = w.orderBy("x", F.col("probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.desc("x"), F.col("probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = f.unionByName(p).withColumn("before", F.last("frame", True).over(back)).withColumn("after", F.last("frame", True).over(ahead))
    return both.where("probe is not null").select("video", "x", "probe.*", "before", "after")


def nearest(probes: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds the nearest frame of the video to each probe (video, x); of two at one distance, the earlier."""
    a = around(probes, frames)
    later = F.col("before").isNull() | (F.col("after").isNotNull() & (F.col("after.frame_idx") - F.col("x") < F.col("x") - F.col("before.frame_idx")))
    return a.withColumn("nearest", F.when(later, F.col("after")).otherwise(F.col("before"))).drop("before", "after")


def neighbor_list(frames: DataFrame, reach: int = 3) -> DataFrame:
    """video, name, neighbors: names of up to `reach` frames on each side, in order, without the frame itself."""
    w = Window.partitionBy("video").orderBy("frame_idx")
    return frames.select("video", "name", F.concat(F.collect_list("name").over(w.rowsBetween(-reach, -1)), F.collect_list("name").over(w.rowsBetween(1, reach))).alias("neighbors"))


def average_chunks(chunks: DataFrame) -> DataFrame:
    """Per frame the mean over overlapping chunks: chunks (video, start, p array) to video, frame_idx, p."""
    return chunks.select("video", "start", F.posexplode("p").alias("i", "v")).groupBy("video", (F.col("start") + F.col("i")).alias("frame_idx")).agg(F.avg("v").alias("p"))


def cut_runs(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Runs of frames with p at the threshold or above: video, run, pos (first frame of the greatest p), p, n."""
    w = Window.partitionBy("video").orderBy("frame_idx")
    on = (F.col("p") >= threshold).cast("int")
    runs = scores.withColumn("on", on).withColumn("island", F.row_number().over(w) - F.sum("on").over(w)).where("on = 1")
    top = runs.groupBy("video", "island").agg(F.max(F.struct("p", (-F.col("frame_idx")).alias("early"))).alias("top"), F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first"))
    return top.select("video", F.row_number().over(Window.partitionBy("video").orderBy("first")).alias("run"), (-F.col("top.early")).alias("pos"), F.col("top.p").alias("p"), "n")


def prune_cuts(cuts: DataFrame, least_gap: int = 12) -> DataFrame:
    """In order of pos: a cut stays if it lies `least_gap` frames from the last that stayed, else it replaces that one if stronger."""
    listed = cuts.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("cuts"))
    kind = listed.schema["cuts"].dataType.simpleString()
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, x: F.when((F.size(acc) == 0) | (x["pos"] - F.when(F.size(acc) > 0, last(acc)["pos"]) >= least_gap), F.concat(acc, F.array(x))).when(x["p"] > last(acc)["p"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)
    return listed.select("video", F.inline(F.aggregate("cuts", F.array().cast(kind), step)))


def scenes(cuts: DataFrame, lengths: DataFrame, least: int = 8) -> DataFrame:
    """Cuts to scenes [start, end] of `least` frames or more: after each cut up to the next; lengths: video, n_frames."""
    ends = cuts.select("video", F.col("pos").cast("long").alias("end")).union(lengths.select("video", F.col("n_frames").cast("long") - 1)).distinct()
    start = F.coalesce(F.lag("end").over(Window.partitionBy("video").orderBy("end")) + 1, F.lit(0))
    return ends.withColumn("start", start).where(F.col("end") - F.col("start") + 1 >= least).select("video", "start", "end")


def sample_scenes(scenes: DataFrame) -> DataFrame:
    """Frames sampled from scenes (video, start, end, fps): two up to 5/3 s, one more for each 2 s begun, 2 to 40; set in by up to three
    frames at each side and evenly spaced (whole frames, rounded down); scenes with no more frames than that give them all."""
    length = F.col("end") - F.col("start") + 1
    base, more = F.greatest(F.lit(1), F.bround(F.col("fps") * 50 / 30).cast("int")), F.greatest(F.lit(1), F.bround(F.col("fps") * 2).cast("int"))
    s = scenes.withColumn("len", length).withColumn("n", F.greatest(F.lit(2), F.least(F.lit(40), F.when(length <= base, 2).otherwise(2 + F.ceil((length - base) / more)))).cast("int"))
    s = s.withColumn("m", F.least(F.lit(3), F.floor((F.col("len") - F.col("n")) / 2))).withColumn("a", F.col("start") + F.col("m")).withColumn("z", F.col("end") - F.col("m"))
    even = F.expr("transform(sequence(0, n - 1), i -> cast(floor(a + i * (z - a) / (n - 1)) as bigint))")
    return s.withColumn("frame_idx", F.explode(F.when(F.col("len") <= F.col("n"), F.sequence("start", "end")).otherwise(even))).select("video", "start", "end", "n", "frame_idx")


def merge_intervals(points: DataFrame, half: float, key: str = "video", end: Column | None = None) -> DataFrame:
    """Intervals [t - half, t + half] (cut at 0 and at `end`) merged where they touch: key, start, end, n, best_name.

    points: key, name, t, score. The best member has the greatest score, then the least t, then name.
    """
    w = Window.partitionBy(key).orderBy("a", "z", "name")
    p = points.withColumn("a", F.greatest(F.lit(0.0), F.col("t") - half)).withColumn("z", F.col("t") + half if end is None else F.least(end, F.col("t") + half))
    p = p.withColumn("reach", F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    p = p.withColumn("island", F.sum((F.col("reach").isNull() | (F.col("a") > F.col("reach") + 1e-6)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min(F.struct((-F.col("score")).alias("s"), "t", "name"))
    return p.groupBy(key, "island").agg(F.min("a").alias("start"), F.max("z").alias("end"), F.count(F.lit(1)).alias("n"), best.alias("best")).select(key, "start", "end", "n", F.col("best.name").alias("best_name"))


def drop_near_frames(frames: DataFrame, most_cosine: float = 0.9, floor: int = 2) -> DataFrame:
    """In each (video, scene_id), in order: a frame goes if its cosine to a kept one reaches `most_cosine`; at least `floor` stay
    (those least like the kept ones come back). frames: video, scene_id, frame_idx, name, vec. Scenes are short: a task holds one."""
    import numpy as np

    def fold(pdf):
        pdf = pdf.sort_values("frame_idx").reset_index(drop=True)
        v = np.array([np.asarray(x, dtype=float) for x in pdf["vec"]])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        for i in range(len(v)):
            if not kept or (v[kept] @ v[i]).max() < most_cosine:
                kept.append(i)
        while len(kept) < min(floor, len(v)):
            rest = [i for i in range(len(v)) if i not in kept]
            kept.append(min(rest, key=lambda i: (v[kept] @ v[i]).max()))
        return pdf.loc[sorted(kept), ["video", "scene_id", "frame_idx", "name"]]

    return frames.groupBy("video", "scene_id").applyInPandas(fold, "video string, scene_id long, frame_idx long, name string")
