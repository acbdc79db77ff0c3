"""Search activity: attempts, latest states, first-seen rows, presence. Each as a batch job, and as a stream over a file source.

Event columns: ts, event_id, user_id, task_id, query, type, params (both may be absent), kind ('search', 'pick', 'basket_empty'), picked (video and
frame as one value).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_PICKS = 100


def _with_keys(events: DataFrame) -> DataFrame:
    """Search type and parameters, null where the log has none."""
    return events.withColumns({c: F.lit(None).cast("string") for c in ("type", "params") if c not in events.columns})


def fold_attempts(events: DataFrame) -> DataFrame:
    """Consecutive events of one query, type and parameters, for a (user, task), are one attempt: user_id, task_id, attempt, query, type,
    params, started, ended, picks (distinct, in order, at most MOST_PICKS), closed.

    Blank queries are ignored. An empty basket closes the newest open attempt that has picks, which need not be the last one; after the
    last one has been closed, an event like it starts another. Events go by (ts, event_id). Attempts that get their first pick and baskets
    that run empty open and close like brackets, so the one that a basket closes is found by its depth.
    """
    key, order = ["user_id", "task_id"], ["ts", "event_id"]
    w = Window.partitionBy(*key).orderBy(*order)
    e = _with_keys(events).withColumn("mark", F.col("kind") == "basket_empty").where(F.col("mark") | (F.trim(F.coalesce("query", F.lit(""))) != ""))
    # runs of equal searches; an empty basket belongs to the run before it
    shown = F.when(~F.col("mark"), F.struct("query", "type", "params"))
    e = e.withColumn("shown", shown).withColumn("last", F.last("shown", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("run", F.sum((~F.col("mark") & ~F.col("shown").eqNullSafe(F.col("last"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # in a run each mark after a pick ends an attempt: picks since the last mark that did so are counted by (parts that hold a pick)
    r = Window.partitionBy(*key, "run").orderBy(*order)
    e = e.withColumn("part", F.coalesce(F.sum(F.col("mark").cast("int")).over(r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    picked = (F.col("kind") == "pick") & F.col("picked").isNotNull()
    parts = e.groupBy(*key, "run", "part").agg(F.bool_or(F.col("mark")).alias("marked"), F.bool_or(picked).alias("some"))
    p = Window.partitionBy(*key, "run").orderBy("part")
    parts = parts.withColumn("piece", F.coalesce(F.sum((F.col("marked") & F.col("some")).cast("int")).over(p.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("marked", "some")
    e = e.join(parts, [*key, "run", "part"])
    # first picks open, marks close
    first = F.row_number().over(Window.partitionBy(*key, "run", "piece", picked).orderBy(*order)) == 1
    steps = e.withColumn("step", F.when(F.col("mark"), -1).when(picked & first, 1)).where("step is not null")
    steps = steps.withColumn("sum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    steps = steps.withColumn("before", F.coalesce(F.lag("depth").over(w), F.lit(0))).where("depth <> before").withColumn("level", F.greatest("depth", "before"))
    closed = steps.withColumn("next", F.lead("step").over(Window.partitionBy(*key, "level").orderBy(*order))).where("step = 1").select(*key, "run", "piece", (F.coalesce("next", F.lit(1)) == -1).alias("closed"))
    g = e.where("not mark").groupBy(*key, "run", "piece").agg(
        F.first("shown").alias("s"), F.min(F.struct(*order)).alias("begun"), F.max("ts").alias("ended"),
        F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(picked, F.struct(*order, "picked")))), lambda x: x["picked"])), 1, MOST_PICKS).alias("picks"),
    )
    out = g.join(closed, [*key, "run", "piece"], "left")
    attempt = F.row_number().over(Window.partitionBy(*key).orderBy("run", "piece"))
    return out.select(*key, attempt.alias("attempt"), "s.query", "s.type", "s.params", F.col("begun.ts").alias("started"), "ended", "picks", F.coalesce("closed", F.lit(False)).alias("closed"))


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each (user, task)."""
    last = F.max(F.struct("ts", "event_id", "query", "kind")).alias("s")
    return events.groupBy("user_id", "task_id").agg(last).select("user_id", "task_id", F.col("s.query").alias("query"), F.col("s.kind").alias("kind"), F.col("s.ts").alias("ts"))


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key."""
    return events.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))).where("_k = 1").drop("_k")


def presence(events: DataFrame, now, ttl_s: int = 30) -> DataFrame:
    """user_id, seen, online: last heartbeat, and whether it lies within ttl_s seconds before `now`."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("seen"))
    return last.withColumn("online", F.col("seen") >= F.lit(now) - F.expr(f"interval {ttl_s} seconds"))


ATTEMPT = "attempt long, query string, type string, params string, started timestamp, ended timestamp, picks array<string>, closed boolean"
EVENT = "ts timestamp, event_id long, query string, type string, params string, kind string, picked string"


class AttemptFolder(StatefulProcessor):
    """State of a (user, task): events that may still be overtaken, the last attempt, and earlier ones that are open and have picks.

    An event is folded once the watermark has passed it, so the order in which events come within it makes no difference. After `idle`
    of event time without an event all state goes; what comes later starts anew.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.last = handle.getValueState("last", ATTEMPT)
        self.open = handle.getMapState("open", "attempt long", ATTEMPT)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            events = list(frame[[c.split()[0] for c in EVENT.split(", ")]].astype(object).where(frame.notna(), None).itertuples(index=False, name=None))
            self.waiting.appendList(events)
            self.handle.registerTimer(max(_ms(e[0]) for e in events))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: (e[0], e[1])) if self.waiting.exists() else []
        due = [e for e in waiting if _ms(e[0]) <= now]
        last = list(self.last.get()) if self.last.exists() else None
        if not due and len(waiting) == 0 and last is not None and _ms(last[5]) + self.idle_ms <= now:
            for state in (self.waiting, self.last, self.open):
                state.clear()
            return
        changed: dict[int, list] = {}
        for e in due:
            last = self._fold(e, last, changed)
        if due:
            self.waiting.put([e for e in waiting if _ms(e[0]) > now]) if len(due) < len(waiting) else self.waiting.clear()
        if last is not None and due:
            self.last.update(tuple(last))
            self.handle.registerTimer(max(_ms(last[5]), now) + self.idle_ms)
        if changed:
            yield pd.DataFrame([(*key, *row) for row in changed.values()], columns=["user_id", "task_id", *(c.split()[0] for c in ATTEMPT.split(", "))])

    def _fold(self, event: tuple, last: list | None, changed: dict[int, list]) -> list | None:
        ts, event_id, query, kind_, params, kind, picked = event
        if kind == "basket_empty":
            newest = last if last and last[6] and not last[7] else None
            if newest is None:
                keys = [k[0] for k in self.open.keys()]
                newest = list(self.open.getValue((max(keys),))) if keys else None
                if newest:
                    self.open.removeKey((newest[0],))
            if newest:
                newest[7] = True
                changed[newest[0]] = newest
            return last
        if not (query or "").strip():
            return last
        if last is None or last[7] or last[1:4] != [query, kind_, params]:
            if last and last[6] and not last[7]:
                self.open.updateValue((last[0],), tuple(last))
            last = [event_id, query, kind_, params, ts, ts, [], False]
        last[5], last[6] = ts, list(last[6])
        if kind == "pick" and picked is not None and picked not in last[6] and len(last[6]) < MOST_PICKS:
            last[6].append(picked)
        changed[last[0]] = last
        return last

    def close(self) -> None:
        pass


def _ms(ts) -> int:
    """Milliseconds since 1970, rounded up, of a time as pandas or Python gives it (without a zone: UTC)."""
    return -(-pd.Timestamp(ts).value // 1_000_000)


def stream_attempts(events: DataFrame, delay: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """`fold_attempts` as a stream: each change of an attempt is a row with all of it; `attempt` is the id of its first event. The last row of an
    attempt holds. Rows older than the watermark are dropped by Spark and counted in the query's progress (numRowsDroppedByWatermark).

    Needs RocksDB as the state store (`use_rocksdb`) and the output mode update. The session's time zone must be UTC.
    """
    marked = _with_keys(events).withWatermark("ts", delay)
    return marked.groupBy("user_id", "task_id").transformWithStateInPandas(AttemptFolder(idle_ms), f"user_id long, task_id long, {ATTEMPT}", "Update", "EventTime")


class PresenceKeeper(StatefulProcessor):
    """State of a user: the last heartbeat, with a timer that takes the user offline `ttl` after it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "seen timestamp")

    def handleInputRows(self, key, rows, timerValues):
        latest = max(frame["ts"].max() for frame in rows)
        known = pd.Timestamp(self.seen.get()[0]) if self.seen.exists() else None
        if known is not None and latest <= known:
            return
        self.seen.update((latest.to_pydatetime(),))
        if known is not None:
            self.handle.deleteTimer(_ms(known) + self.ttl_ms)
        self.handle.registerTimer(_ms(latest) + self.ttl_ms)
        yield pd.DataFrame([(*key, latest, True)], columns=["user_id", "seen", "online"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.seen.exists():
            seen = pd.Timestamp(self.seen.get()[0])
            if _ms(seen) + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.seen.clear()
                yield pd.DataFrame([(*key, seen, False)], columns=["user_id", "seen", "online"])

    def close(self) -> None:
        pass


def stream_presence(events: DataFrame, ttl_s: int = 30, delay: str = "10 seconds") -> DataFrame:
    """user_id, seen, online: a row for each batch in which a user's last heartbeat moves on, and one (online false) once the watermark is
    `ttl_s` seconds past it; the user's state is gone then. The last row of a user holds. State store and mode as in `stream_attempts`."""
    return events.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(PresenceKeeper(ttl_s * 1000), "user_id long, seen timestamp, online boolean", "Update", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that processors with several states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_first_seen(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Presence as sessions: a user's heartbeats with no gap of `gap` between them."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "session.start", "session.end", "n")


def append_new(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows of a batch whose key the table at `path` does not hold; a batch run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write


def ingest(source: DataFrame, path: str, key: str, checkpoint: str):
    """Resumable ingest of a file stream: batches are appended once, and a restart goes on after the last."""
    return source.writeStream.foreachBatch(append_new(path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
