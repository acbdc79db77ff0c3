"""Candidate rows around anchors: spreads, even positions, variants, steps."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_tasks(tasks: DataFrame, answer, schema: str) -> DataFrame:
    """answer(row), a generator of tuples, for each row of `tasks` (one a task): task_id and the tuples, with their numbers from 1 as rank."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = tasks.schema["task_id"].dataType.simpleString()

    def run(batches):
        types = _arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                rows = b.drop_columns(["task_id"]).to_pylist()
                found, of, rank = [], [], []
                for k, row in enumerate(rows):
                    n = len(found)
                    found += answer(row)
                    of += [k] * (len(found) - n)
                    rank += range(1, len(found) - n + 1)
                columns = zip(*found, strict=True) if found else [[]] * len(names)
                yield pa.record_batch([b.column("task_id").take(pa.array(of, pa.int64())), *(pa.array(list(c), types.field(n).type) for n, c in zip(names, columns, strict=True)), pa.array(rank, pa.int32())], names=["task_id", *names, "rank"])

    return tasks.mapInArrow(run, f"task_id {kind}, {schema}, rank int")


def _arrow_schema(schema: str) -> pa.Schema:
    """Of columns of longs, strings and arrays of longs."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _by_anchor(a: dict) -> tuple:
    return a["anchor"] is not None, a["anchor"]


def _spread(task: dict):
    """(anchor, video, frame) of one task, level by level, until it has its rows."""
    there = {(e["video"], e["frame"]) for e in task["there"] or ()}
    beside, left = Counter(v for v, _ in there), max(a["need"] for a in task["anchors"])
    moves = []  # in the order of a level
    for sign in (1, -1):
        for a in sorted(task["anchors"], key=_by_anchor):
            if a["direction"] not in (("down",) if sign > 0 else ("up",)):
                last = a["need"] + beside[a["video"]]
                last = min(last, a["reach"] // a["step"]) if (a["reach"] or 0) > 0 else last
                moves.append((a["anchor"], a["video"], a["frame"], sign * a["step"], min(last, a["frame"] // a["step"]) if sign < 0 else last))
    k = 1
    while left and (moves := [m for m in moves if m[4] >= k]):
        for anchor, video, frame, step, _ in moves:
            spot = frame + k * step
            if spot >= 0 and (video, spot) not in there:
                there.add((video, spot))
                yield anchor, video, spot
                left -= 1
                if not left:
                    return
        k += 1


def anchor_spread(anchors: DataFrame, existing: DataFrame) -> DataFrame:
    """task_id, anchor, video, frame, rank: frames at k steps from each anchor, for k = 1, 2, ..., then up before down, then anchor.

    anchors: task_id, anchor, video, frame, step, direction ('both', 'up', 'down'), reach (0: none), need. An anchor stops beyond
    its reach, downwards at frame 0; negative frames, existing ones (task_id, video, frame) and repeats are skipped; a task gets `need` rows,
    or all there are. After need + n steps, n of the task's existing frames being in its video, an anchor alone has given `need` frames
    in a direction that has no end; so no k beyond that is tried and no anchor needs a bound of its own. Anchors and existing frames of a task are gathered in one
    row, and levels are tried there until the task is full: only what is given is shuffled, and what is found only made.
    """
    of_task = F.collect_list(F.struct("anchor", "video", "frame", "step", "direction", "reach", "need")).alias("anchors")
    tasks = anchors.where("step > 0 and need > 0 and frame is not null").groupBy("task_id").agg(of_task)
    there = existing.where("video is not null and frame is not null").groupBy("task_id").agg(F.collect_set(F.struct("video", "frame")).alias("there"))
    kinds = dict(anchors.dtypes)
    found = _in_tasks(tasks.join(there, "task_id", "left"), _spread, "anchor long, video string, frame long")
    return found.withColumn("anchor", F.col("anchor").cast(kinds["anchor"]))


def even_positions(lo: Column, hi: Column, n: Column) -> Column:
    """n whole numbers evenly from lo to hi, both included (halves to even); lo alone for one, or where they are equal."""
    n, a, z = n.cast("int"), F.least(lo, hi), F.greatest(lo, hi)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(1))), lambda i: F.bround(a + i * (z - a) / (n - 1)).cast("long"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when((n == 1) | (a == z), F.array(a.cast("long"))).otherwise(many)


def event_variants(anchors: DataFrame) -> DataFrame:
    """Other frames for one event: key columns, frame, order. anchors: task_id, event, anchor, lo, hi, direction, want.

    They cover [lo, hi] evenly (only from the anchor on for 'up', up to it for 'down'), without the anchor, nearest first.
    """
    a = anchors.withColumn("a", F.greatest(F.lit(0), F.least("lo", "hi"), F.when(F.col("direction") == "up", F.col("anchor")))).withColumn("z", F.least(F.greatest("lo", "hi"), F.when(F.col("direction") == "down", F.col("anchor"))))
    a = a.where((F.col("z") >= F.col("a")) & (F.col("want") > 0))
    picks = F.array_distinct(even_positions(F.col("a"), F.col("z"), F.least(F.col("want"), F.col("z") - F.col("a") + 1)))
    rows = a.select("task_id", "event", "anchor", F.explode(picks).alias("frame")).where("frame >= 0 and frame <> anchor")
    order = F.row_number().over(Window.partitionBy("task_id", "event").orderBy(F.abs(F.col("frame") - F.col("anchor")), "frame"))
    return rows.withColumn("order", order)


def uniform_step(ranges: DataFrame, most: int = 2000) -> DataFrame:
    """The greatest step in 1 to `most` that still gives a task its rows: ranges (task_id, half, need) to task_id, step (1 if none does).

    Steps are tried within a task's row, so that only its ranges are shuffled: by halving, as longer steps give no more rows, and one by one for
    a task with a negative half.
    """
    tasks = ranges.groupBy("task_id").agg(F.collect_list("half").alias("halves"), F.max("need").alias("need"))
    rows = lambda step: F.aggregate("halves", F.lit(0).cast("bigint"), lambda n, half: n + 2 * F.floor(half / step))
    enough = lambda step: F.coalesce(rows(step) >= F.col("need"), F.lit(False))
    bits = F.array(*[F.lit(2**i) for i in reversed(range(most.bit_length()))])
    halved = F.aggregate(bits, F.lit(0), lambda step, bit: step + F.when((step + bit <= most) & enough(step + bit), bit).otherwise(0))
    tried = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(most)), enough))
    best = F.when(F.exists("halves", lambda half: half < 0), tried).when(F.size("halves") > 0, F.nullif(halved, F.lit(0)))
    return tasks.select("task_id", F.coalesce(best, F.lit(1)).alias("step"))


def bisection(ranges: DataFrame, most: int = 64) -> DataFrame:
    """Both ends, then the middles of what lies between, level by level: ranges (range_id, lo, hi, k <= most) to range_id, order, frame.

    The positions of a level are its odd binary fractions, so no recursion is needed; repeats drop, the first k stay. All of it
    happens within a range's row.
    """
    levels = max(1, (most - 1).bit_length() + 1)
    fractions = [0.0, 1.0] + [(2 * i + 1) / 2**lv for lv in range(1, levels + 1) for i in range(2 ** (lv - 1))]
    ends = ranges.groupBy("range_id", "k").agg(F.collect_set(F.struct("lo", "hi")).alias("ends"))
    level = lambda f: F.transform(F.array_sort("ends"), lambda e: F.floor(e["lo"] + f * (e["hi"] - e["lo"])))
    frames = F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(f) for f in fractions]), level)))
    return ends.select("range_id", F.posexplode(F.slice(frames, 1, F.greatest(F.col("k"), F.lit(0)))).alias("order", "frame")).withColumn("order", F.col("order") + 1).select("range_id", "order", "frame")


def _nearest_first(lo: int, hi: int, n: int, base: int):
    """Of n whole numbers evenly from lo to hi (`even_positions`) those that are not base, nearest first, the lesser of two first."""
    if n == hi - lo + 1 and n > 1:  # all of them, one by one
        down, up = min(base - 1, hi), max(base + 1, lo)
        while down >= lo or up <= hi:
            if down >= lo and (up > hi or base - down <= up - base):
                yield down
                down -= 1
            else:
                yield up
                up += 1
        return
    picks = {lo} if n == 1 or lo == hi else {round(lo + i * (hi - lo) / (n - 1)) for i in range(n)}
    yield from sorted(picks - {base}, key=lambda x: (abs(x - base), x))


def _plan(task: dict):
    """(anchor, video, frames) of one task, pass by pass."""
    anchors, windows, need = sorted(task["anchors"], key=_by_anchor), task["windows"] or [], task["need"]
    reference, budget = anchors[0]["frames"], need * 8 + 64
    there, left = {(e["video"], tuple(e["frames"])) for e in task["there"] or ()}, need
    for want in (-(-need // (len(anchors) * max(1, len(windows)))), budget):
        moves = []  # in the order of a level: by event, then by anchor
        for event, w in enumerate(windows):
            for a in anchors:
                if w and event < len(a["frames"]) and a["frames"][event] is not None and w["lo"] is not None and w["hi"] is not None:
                    base = a["frames"][event]
                    shift = base - reference[event] if event < len(reference) and reference[event] is not None else 0
                    lo, hi = sorted((w["lo"] + shift, w["hi"] + shift))
                    lo, hi = max(0, lo, base if w["mode"] == "up" else 0), min(hi, base) if w["mode"] == "down" else hi
                    if hi >= lo:
                        moves.append((event, a, _nearest_first(lo, hi, min(want, hi - lo + 1), base)))
        tried = 0
        while moves and tried < budget:
            going = []
            for event, a, picks in moves:
                new = next(picks, None)
                if new is None:
                    continue
                going.append((event, a, picks))
                tried += 1
                if tried > budget:
                    break
                frames = (*a["frames"][:event], new, *a["frames"][event + 1 :])
                if all(x is not None and x >= 0 for x in frames) and (a["video"], frames) not in there:
                    there.add((a["video"], frames))
                    yield a["anchor"], a["video"], frames
                    left -= 1
                    if not left:
                        return
            moves = going


def event_plan(anchors: DataFrame, ranges: DataFrame, existing: DataFrame) -> DataFrame:
    """Answers that change one event of an anchor and keep the others: task_id, anchor, video, frames, rank.

    anchors: task_id, anchor (order of the anchors), video, frames (array). ranges: task_id, need, windows (array of lo, hi, mode, one for
    each event; 'both', 'up' or 'down' of the anchor's frame). existing: task_id, video, frames. A window is in frames of the task's first
    anchor and moves along with the frame of another one; events without a window stay. Each event first gets its share of `need`,
    evenly over its window, then, if that is not enough, a dense pass of 8 * need + 64. In both passes rows go by how near the change is
    among its event's, then event, then anchor; a pass gives no more than 8 * need + 64. What exists or came before is skipped.
    Anchors and existing answers of a task are gathered in one row and changed there until the task has its rows, so that candidates are not shuffled.
    """
    tasks = anchors.groupBy("task_id").agg(F.collect_list(F.struct("anchor", "video", F.coalesce("frames", F.array().cast("array<bigint>")).alias("frames"))).alias("anchors"))
    there = existing.where("video is not null and frames is not null").groupBy("task_id").agg(F.collect_set(F.struct("video", "frames")).alias("there"))
    tasks = tasks.join(ranges.where("need > 0"), "task_id").join(there, "task_id", "left")
    found = _in_tasks(tasks, _plan, "anchor long, video string, frames array<long>")
    return found.withColumn("anchor", F.col("anchor").cast(dict(anchors.dtypes)["anchor"]))
