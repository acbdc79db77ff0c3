"""Reports over a corpus and its runs: coverage counters, restored answers, runs with their versions, candidates in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentspark.functions.media import basename, parse_name

from .timeline import interval_join

ANSWER = "struct<task_id: bigint, author_id: bigint, created_by: bigint, sort_key: double, video: string, frames: string, answer_text: string, origin: string>"
RESTORABLE = ("answer.delete", "answers.clear", "answers.autofill_clear")


def coverage_report(first: DataFrame, second: DataFrame, fps: DataFrame, windows: DataFrame, pad_s: float = 5.0, extension: str = ".jpg") -> DataFrame:
    """counter, value: how two mappings (key, url), frame rates (video, fps) and speech (video, doc_id, start_s, end_s, text, eligible) fit together.

    Of each mapping: entries, malformed urls (null, or without a file name), repeated urls, keys that are no number, names without the usual extension. Of
    the distinct names: in both, in one only, in all, parsed or malformed, with a frame rate or without, with text of eligible windows within
    `pad_s` or without. Of videos: in mappings, rates and speech, without a rate, spoken in but without a rate; of windows: loaded, usable.
    Each table is read once for its counters; names and videos are put together by one aggregation each.
    """
    entries = first.select(F.lit("a").alias("of"), F.col("key").cast("string").alias("key"), "url").unionByName(second.select(F.lit("b").alias("of"), F.col("key").cast("string").alias("key"), "url"))
    named = entries.withColumn("name", basename(F.col("url")))
    side = named.groupBy("of").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("name").isNull()).alias("malformed_urls"), F.count_if(~F.coalesce(F.col("key").rlike("^[0-9]+$"), F.lit(False))).alias("non_numeric_keys"),
        F.count_if(F.col("name").isNotNull() & ~F.endswith(F.lower("name"), F.lit(extension))).alias("unexpected_extensions"),
    )
    urls = named.where("url is not null").groupBy("of", "url").agg(F.count(F.lit(1)).alias("n")).groupBy("of").agg(F.sum(F.col("n") - 1).alias("duplicate_urls"))
    frames = named.where("name is not null").groupBy("name").agg(F.bool_or(F.col("of") == "a").alias("in_a"), F.bool_or(F.col("of") == "b").alias("in_b"))
    parsed = frames.withColumn("p", parse_name(F.col("name"))).select("name", "in_a", "in_b", F.col("p.video").alias("video"), F.col("p.frame_idx").alias("frame_idx")).join(fps, "video", "left")
    usable = windows.where("eligible and trim(text) <> ''")
    spoken = interval_join(parsed.where("fps is not null").select("video", "name", (F.col("frame_idx") / F.col("fps")).alias("t")), usable, pad_s).where("text <> ''").select("name", F.lit(True).alias("spoken"))
    rated = F.col("fps").isNotNull()
    by_frame = parsed.join(spoken, "name", "left").agg(
        F.count_if(F.col("in_a")).alias("a_unique_frames"), F.count_if(F.col("in_b")).alias("b_unique_frames"), F.count_if(F.col("in_a") & F.col("in_b")).alias("frames_in_both"), F.count_if(~F.col("in_b")).alias("a_only_frames"),
        F.count_if(~F.col("in_a")).alias("b_only_frames"), F.count(F.lit(1)).alias("retrievable_frames"), F.count_if(F.col("video").isNotNull()).alias("frames_parsed"), F.count_if(F.col("video").isNull()).alias("frames_malformed_names"),
        F.count_if(rated).alias("frames_valid_fps"), F.count_if(F.col("video").isNotNull() & ~rated).alias("frames_skipped_missing_fps"), F.count_if(rated & F.col("spoken").isNotNull()).alias("frames_matched"), F.count_if(rated & F.col("spoken").isNull()).alias("frames_no_asr"),
    )
    has = lambda df, c: df.select("video", F.lit(c).alias("c"))
    videos = has(parsed.where("video is not null"), "m").union(has(fps, "f")).union(has(usable, "s")).groupBy("video").agg(*(F.bool_or(F.col("c") == c).alias(c) for c in "mfs"))
    by_video = videos.agg(F.count_if("m").alias("videos_in_mappings"), F.count_if("f").alias("videos_in_fps_map"), F.count_if("s").alias("videos_in_asr"), F.count_if(F.col("m") & ~F.col("f")).alias("videos_missing_fps"), F.count_if(F.col("s") & ~F.col("f")).alias("videos_in_asr_not_in_fps"))
    by_window = windows.agg(F.count(F.lit(1)).alias("windows_loaded"), F.count_if(F.col("eligible") & (F.trim("text") != "")).alias("windows_usable"))

    def long(one: DataFrame, prefix=None) -> DataFrame:
        names = [c for c in one.columns if c != "of"]
        pairs = F.array(*[F.struct((F.concat(F.col("of"), F.lit(f"_{c}")) if prefix else F.lit(c)).alias("counter"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("value")) for c in names])
        return one.select(F.inline(pairs))

    return long(side, True).union(long(urls, True)).union(long(by_frame)).union(long(by_video)).union(long(by_window))


def restore(audit: DataFrame, wanted: DataFrame, answers: DataFrame, tasks: DataFrame, user_id: int, actions: tuple[str, ...] = RESTORABLE) -> tuple[DataFrame, DataFrame]:
    """(answers with the rows of wanted audit entries put back, audit with `restored` set where any came back).

    audit: entry_id, action, detail (JSON with `answers`), restored. wanted: entry_id. answers: task_id, author_id, sort_key, video, frames, answer_text, origin,
    created_by, updated_by, and restored_from (the entry, null for others). Rows keep their sort key; those whose task is gone are skipped; an entry
    that is restored already, of another action or unreadable gives nothing. Run again on its own results it adds nothing.
    """
    open_ = audit.join(wanted.select("entry_id").distinct(), "entry_id", "left_semi").where(F.col("action").isin(*actions) & ~F.coalesce("restored", F.lit(False)))
    rows = open_.select("entry_id", F.explode(F.from_json("detail", f"answers array<{ANSWER}>")["answers"]).alias("x")).select("entry_id", "x.*").join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    back = rows.select("task_id", F.coalesce("author_id", "created_by").alias("author_id"), "sort_key", "video", "frames", "answer_text", "origin", "created_by", F.lit(user_id).cast("bigint").alias("updated_by"), F.col("entry_id").alias("restored_from"))
    done = back.select(F.col("restored_from").alias("entry_id"), F.lit(True).alias("_now")).distinct()
    marked = audit.join(done, "entry_id", "left").withColumn("restored", F.coalesce("restored", F.lit(False)) | F.coalesce("_now", F.lit(False))).drop("_now")
    return answers.unionByName(back.select(answers.columns)), marked


def versioned_runs(runs: DataFrame, datasets: DataFrame, references: DataFrame) -> DataFrame:
    """Runs (run_id, dataset_id, reference_set_id and more) that have both, with dataset_version and reference_set_version, and place (latest first)."""
    d = datasets.select("dataset_id", F.col("version").alias("dataset_version"))
    r = references.select("reference_set_id", F.col("version").alias("reference_set_version"))
    return runs.join(d, "dataset_id").join(r, "reference_set_id")


def in_time_order(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Adds place: candidates of a key by frame, then name, for review."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("frame_idx", "name")))
