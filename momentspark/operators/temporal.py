"""Ordered events inside a video: anchored pairs, alignment by dynamic programming, greedy alignment.

Scores come as a table `scored`: key columns, event (from 0), video, name, frame_idx, fps, pos, score.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentspark.functions.vectors import readable


def take_while(scored: DataFrame, keys: list[str], threshold: float, order: str = "dist") -> DataFrame:
    """Rows of each key up to the first score below the threshold."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("_on", F.min((F.col("score") >= threshold).cast("int")).over(w)).where("_on = 1").drop("_on")


def best_pair(sides: DataFrame, anchors: DataFrame, gap_s: float = 20, max_frames: int = 20, threshold: float = 0.1) -> DataFrame:
    """The start and end frame around an anchor with the greatest summed score.

    sides: query_id, side ('start' at or before the anchor, 'end' at or after), dist (places from the anchor), name, frame_idx,
    score. anchors: query_id, name, frame_idx, fps. A side is followed outwards while scores reach the threshold. Ends no
    earlier than starts and at most gap_s * fps frames later; ties go to the nearest start, then end. An empty side is
    the anchor with score 0; no pair gives the anchor twice with score 0.
    """
    open_sides = take_while(sides.where(F.col("dist") <= max_frames), ["query_id", "side"], threshold)
    bare = anchors.select("query_id", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("side"), "name", "frame_idx")
    empty = bare.join(open_sides.select("query_id", "side").distinct(), ["query_id", "side"], "left_anti").select("query_id", "side", F.lit(0).alias("dist"), "name", "frame_idx", F.lit(0.0).alias("score"))
    pool = open_sides.select("query_id", "side", "dist", "name", "frame_idx", "score").unionByName(empty)
    counts = open_sides.groupBy("query_id").agg(F.count_if(F.col("side") == "start").alias("n_left"), F.count_if(F.col("side") == "end").alias("n_right"))
    s = pool.where("side = 'start'").select("query_id", F.col("name").alias("start_name"), F.col("frame_idx").alias("start_frame"), F.col("score").alias("s1"), F.col("dist").alias("d1"))
    e = pool.where("side = 'end'").select("query_id", F.col("name").alias("end_name"), F.col("frame_idx").alias("end_frame"), F.col("score").alias("s2"), F.col("dist").alias("d2"))
    pairs = s.join(e, "query_id").join(anchors.select("query_id", "fps"), "query_id")
    pairs = pairs.where((F.col("end_frame") >= F.col("start_frame")) & (F.col("end_frame") - F.col("start_frame") <= gap_s * F.col("fps")) & (F.col("s1") + F.col("s2") > -1))
    best = pairs.groupBy("query_id").agg(F.max(F.struct(F.round(F.col("s1") + F.col("s2"), 6).alias("total"), (-F.col("d1")).alias("d1"), (-F.col("d2")).alias("d2"), "start_name", "end_name")).alias("b"))
    out = anchors.join(best, "query_id", "left").join(counts, "query_id", "left")
    return out.select("query_id", F.coalesce("b.start_name", "name").alias("start_name"), F.coalesce("b.end_name", "name").alias("end_name"), F.coalesce("b.total", F.lit(0.0)).alias("score"), F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def align_dp(scored: DataFrame, n_events: int, gap_s: float | None, rates: list[float], key: str = "group_id") -> DataFrame:
    """One frame for each event, in order, with the greatest summed score: key, video, total, path (frame_idx array).

    A frame lies after the frame of the event before it, at most gap_s * fps frames (None: any). Ties go to the earliest
    frames. A window over a range of frames needs a constant bound, so videos are taken by frame rate (`rates`).
    Videos without a feasible path have no row; frame_idx is unique in a video.
    """
    w_all = Window.partitionBy(key, "video")
    total = scored.where("event = 0").select(key, "video", "fps", "frame_idx", F.struct(F.col("score").alias("total"), (-F.col("frame_idx")).alias("early"), F.array("frame_idx").alias("path")).alias("best"))
    for event in range(1, n_events):
        now = scored.where(F.col("event") == event).select(key, "video", "frame_idx", "score")
        joined = now.join(total, [key, "video", "frame_idx"], "left")
        fps = F.coalesce("fps", F.max("fps").over(w_all))
        joined = joined.withColumn("fps", fps)
        parts = []
        for rate in rates if gap_s else [None]:
            back = -int(gap_s * rate) if gap_s else Window.unboundedPreceding
            w = w_all.orderBy("frame_idx").rangeBetween(back, -1)
            part = joined if rate is None else joined.where(F.col("fps") == rate)
            parts.append(part.withColumn("prev", F.max("best").over(w)))
        stepped = reduce(DataFrame.unionByName, parts).where("prev is not null")
        best = F.struct(F.round(F.col("prev.total") + F.col("score"), 6).alias("total"), (-F.col("frame_idx")).alias("early"), F.concat("prev.path", F.array("frame_idx")).alias("path"))
        total = stepped.select(key, "video", "fps", "frame_idx", best.alias("best"))
    return total.groupBy(key, "video").agg(F.max("best").alias("b")).select(key, "video", F.col("b.total").alias("total"), F.col("b.path").alias("path"))


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """From a length to the rows of that length and their matrix; null rows are in none."""
    n = pc.list_value_length(column).fill_null(0).to_numpy()
    of = {int(size): np.flatnonzero(n == size) for size in np.unique(n[n > 0])}
    return {size: (rows, column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), size)) for size, rows in of.items()}


def _best_before(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest of rows lo to hi - 1 in each column and its row, the first of equal ones; -inf where there is none. By maxima of 1, 2, 4, ... rows, two to a range."""
    out, row = np.full((len(lo), v.shape[1]), -np.inf), np.zeros((len(lo), v.shape[1]), dtype=np.int64)
    at, width, size = np.repeat(np.arange(len(v))[:, None], v.shape[1], axis=1), 1, hi - lo
    while (size >= width).any():
        on = np.flatnonzero((size >= width) & (size < 2 * width))
        left, right = lo[on], hi[on] - width
        later = v[right] > v[left]
        out[on], row[on] = np.where(later, v[right], v[left]), np.where(later, at[right], at[left])
        later = v[width:] > v[:-width]
        v, at = np.where(later, v[width:], v[:-width]), np.where(later, at[width:], at[:-width])
        width *= 2
    return out, row


class _Paths:
    """The best path of each group of a block while the frames of a video go by in order."""

    def __init__(self, asked: pa.Table, n_events: int, gap_s: float, unread: float | None):
        self.ids = np.unique(asked["group_id"].to_numpy())
        place, event, self.gap_s, self.unread = np.searchsorted(self.ids, asked["group_id"].to_numpy()), asked["event"].to_numpy(), gap_s, -np.inf if unread is None else unread
        vectors = [asked["vec"].combine_chunks().filter(pa.array(event == e)) for e in range(n_events)]
        self.events = [[(size, place[event == e][rows], x) for size, (rows, x) in _matrices(v).items()] for e, v in enumerate(vectors)]
        self.there = [np.isin(np.arange(len(self.ids)), place[event == e]) for e in range(n_events)]
        shape = len(self.ids)
        self.tails = [(np.zeros(0), np.zeros((0, shape)), np.zeros((0, shape, e + 1), dtype=np.int64)) for e in range(n_events - 1)]
        self.total, self.path = np.full(shape, -np.inf), np.zeros((shape, n_events), dtype=np.int64)

    def meet(self, frame: np.ndarray, reach: np.ndarray, vectors: pa.Array) -> None:
        """Frames in order, how far a frame may lie behind the one before it, and their vectors."""
        frames, best, path = _matrices(vectors), None, None
        own = np.broadcast_to(frame[:, None, None], (len(frame), len(self.ids), 1))
        for e, of_event in enumerate(self.events):
            score = np.where(self.there[e], self.unread, -np.inf) * np.ones((len(frame), 1))
            for size, groups, q in of_event:
                if size in frames:
                    score[np.ix_(frames[size][0], groups)] = np.round(frames[size][1] @ q.T, 6)
            if e == 0:
                best, path = score, own
                continue
            f, before, paths = (np.concatenate(x) for x in zip(self.tails[e - 1], (frame, best, path), strict=True))
            keep = f >= frame[-1] - np.nanmax(reach, initial=0)
            self.tails[e - 1] = f[keep], before[keep], paths[keep]
            lo, hi = np.searchsorted(f, frame - reach), len(f) - len(frame) + np.arange(len(frame))
            prev, row = _best_before(before, lo, hi)
            best = np.round(prev + score, 6)
            path = np.concatenate([paths[row, np.arange(len(self.ids))], own], axis=2)
        last, column = best.argmax(axis=0), np.arange(len(self.ids))
        new = best[last, column] > self.total
        self.total[new], self.path[new] = best[last, column][new], path[last, column][new]


def align_frames(videos: DataFrame, events: DataFrame, frames: DataFrame, n_events: int, gap_s: float, unread: float | None = -1.0, size: int = 500) -> DataFrame:
    """`align_dp` from vectors, without a table of scores: group_id, video, total, path.

    videos: group_id, video. events: group_id, event, qvec. frames: video, frame_idx, fps, vec (a video has one rate). The groups of a video are dealt into blocks
    of about `size`; the video's frames go past each block once, in order (sorted by Spark), scores are matrix products, and of what went by only the frames
    that a gap reaches are held. So what is shuffled is the frames once for each block, and what a task holds is bounded whatever the length
    of a video. A frame that cannot be read or is not as long as the event's vector scores `unread` (None: it is left out).
    """
    schema = "group_id long, video string, total double, path array<bigint>"
    sound = lambda c: F.when(readable(F.col(c)), F.transform(c, lambda x: x.cast("double"))).alias("vec")
    blocks = videos.groupBy("video").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asked = videos.join(blocks, "video").join(events.where(F.col("event").between(0, n_events - 1)), "group_id")
    asked = asked.select("video", F.pmod(F.xxhash64("group_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), F.col("group_id").cast("long").alias("group_id"), F.col("event").cast("int").alias("event"), none("long", "frame_idx"), none("double", "fps"), sound("qvec"))
    shown = frames.join(blocks, "video").select("video", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), none("long", "group_id"), none("int", "event"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("fps").cast("double").alias("fps"), sound("vec"))

    def run(batches):
        now, asked, paths = None, [], None

        def done():
            if paths is not None:
                on = np.flatnonzero(np.isfinite(paths.total))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * n_events, pa.int32()), pa.array(paths.path[on].reshape(-1)))
                yield pa.record_batch([pa.array(paths.ids[on]), pa.array([now[0]] * len(on), pa.string()), pa.array(paths.total[on]), flat], names=["group_id", "video", "total", "path"])

        for whole in batches:
            keys = list(zip(whole.column("video").to_pylist(), whole.column("block").to_pylist(), whole.column("kind").to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
            for lo, hi in zip(edges, edges[1:]):
                if keys[lo][:2] != now:
                    yield from done()
                    now, asked, paths = keys[lo][:2], [], None
                part = whole.slice(lo, hi - lo)
                if keys[lo][2] == 0:
                    asked.append(part)
                    continue
                if paths is None and asked:
                    paths = _Paths(pa.Table.from_batches(asked), n_events, gap_s, unread)
                for at in range(0, part.num_rows if paths is not None else 0, 256):
                    b = part.slice(at, 256)
                    paths.meet(b.column("frame_idx").to_numpy(), gap_s * b.column("fps").to_numpy(zero_copy_only=False), b.column("vec"))
        yield from done()

    key = ["video", "block"]
    tasks = 4 * frames.sparkSession.sparkContext.defaultParallelism
    return asked.unionByName(shown.where("frame_idx is not null")).repartition(tasks, *key).sortWithinPartitions(*key, "kind", "frame_idx").mapInArrow(run, schema)


def align_greedy(scored: DataFrame, n_events: int, gap_s: float | None, key: str = "group_id") -> DataFrame:
    """Event by event, the best frame after the one picked before, within the gap; ties go to the earliest. Videos where
    an event has no frame drop out: key, video, total, path."""
    pick = F.max(F.struct("score", (-F.col("frame_idx")).alias("early"))).alias("p")
    state = scored.where("event = 0").groupBy(key, "video").agg(pick).select(key, "video", F.col("p.score").alias("total"), (-F.col("p.early")).alias("last"), F.array(-F.col("p.early")).alias("path"))
    for event in range(1, n_events):
        near = (F.col("frame_idx") > F.col("last")) & (F.lit(True) if not gap_s else F.col("frame_idx") - F.col("last") <= gap_s * F.col("fps"))
        step = scored.where(F.col("event") == event).join(state, [key, "video"]).where(near).groupBy(key, "video", "total", "last", "path").agg(pick)
        state = step.select(key, "video", F.round(F.col("total") + F.col("p.score"), 6).alias("total"), (-F.col("p.early")).alias("last"), F.concat("path", F.array(-F.col("p.early"))).alias("path"))
    return state.select(key, "video", "total", "path")


def event_candidates(scored: DataFrame, n: int = 10, key: str = "group_id") -> DataFrame:
    """The n best frames of each event in each video, with rank."""
    w = Window.partitionBy(key, "video", "event").orderBy(F.desc("score"), "frame_idx")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
