"""Answers, tasks and corpora of a team: ranks, contributors, rollups, validation, reconciliation, submission lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentspark.functions.text import clean_answer


def answer_rank(answers: DataFrame) -> DataFrame:
    """Adds rank: place in an author's list for a task, by sort_key, then id."""
    return answers.withColumn("rank", F.row_number().over(Window.partitionBy("task_id", "author_id").orderBy("sort_key", "id")))


def contributors(answers: DataFrame) -> DataFrame:
    """task_id, author_id, n, place: authors by number of answers."""
    n = answers.groupBy("task_id", "author_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("n"), "author_id")))


def task_slices(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """task_id, n_authors, slice: 'open' without answers, 'done' if one author alone reaches the target, else 'started'."""
    n = contributors(answers).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_authors"), F.max("n").alias("most"))
    out = tasks.join(n, "task_id", "left")
    part = F.when(F.col("most").isNull(), "open").when(F.col("most") >= F.col("target"), "done").otherwise("started")
    return out.select("task_id", F.coalesce("n_authors", F.lit(0)).alias("n_authors"), part.alias("slice"))


def rollup(tasks: DataFrame, answers: DataFrame, by: str = "round_id") -> DataFrame:
    """Per round: tasks, answers, those made by hand, authors, last update."""
    per_task = answers.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") == "manual").alias("by_hand"), F.max("updated_at").alias("last"))
    return tasks.join(per_task, "task_id", "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"), F.coalesce(F.sum("by_hand"), F.lit(0)).alias("n_manual"), F.max("last").alias("last_update"))


def verdict_tally(submissions: DataFrame, by: list[str]) -> DataFrame:
    """Among sent submissions: wrong, undecided, and whether any was right."""
    sent = submissions.where("status = 'sent'")
    return sent.groupBy(*by).agg(F.count_if(F.col("verdict") == "WRONG").alias("wrong"), F.count_if(F.col("verdict") == "INDETERMINATE").alias("undecided"), F.bool_or(F.col("verdict") == "CORRECT").alias("solved"))


def latest_version(rows: DataFrame, slug: str, version: str) -> DataFrame:
    """The row with the highest version string of each slug."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(slug).orderBy(F.desc(version)))).where("_k = 1").drop("_k")


def decayed_score(seconds: Column, limit: Column, wrong: Column) -> Column:
    """max(0, 50 + 50 (1 - t / T) - 10 per wrong answer), t within 0 to T; null for a limit of 0 or less."""
    t = F.least(F.greatest(seconds, F.lit(0.0)), limit)
    return F.when(limit > 0, F.greatest(F.lit(0.0), 50 + 50 * (1 - t / limit) - 10 * wrong))


def validate(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each issue: task_id, issue, n. tasks: task_id, type, n_events, target, chosen_author_id; answers: task_id, author_id,
    video, frames (array), answer_text.

    Issues: no chosen author though there are answers, rows missing to the target, empty or comma answers (qa), short rows
    (trake), duplicate rows. Only the chosen author's rows are judged.
    """
    there = answers.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_any"))
    chosen = tasks.join(answers.withColumnRenamed("author_id", "chosen_author_id"), ["task_id", "chosen_author_id"])
    qa, trake = F.col("type") == "qa", F.col("type") == "trake"
    text = F.trim(F.coalesce("answer_text", F.lit("")))
    n = chosen.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(qa & (text == "")).alias("empty_answer"), F.count_if(qa & F.contains(text, F.lit(","))).alias("comma_in_answer"),
        F.count_if(trake & (F.size("frames") < F.col("n_events"))).alias("short_row"), (F.count(F.lit(1)) - F.countDistinct(F.struct("video", "frames", F.coalesce("answer_text", F.lit(""))))).alias("duplicate"),
    )
    j = tasks.join(there, "task_id", "left").join(n, "task_id", "left")
    kinds = {
        "not_chosen": F.when(F.col("chosen_author_id").isNull() & (F.col("n_any") > 0), F.col("n_any")),
        "missing_rows": F.when(F.col("chosen_author_id").isNotNull(), F.greatest(F.lit(0), F.col("target") - F.coalesce("rows", F.lit(0)))),
        **{k: F.col(k) for k in ("empty_answer", "comma_in_answer", "short_row", "duplicate")},
    }
    issues = F.array(*[F.struct(F.lit(k).alias("issue"), F.coalesce(v, F.lit(0)).cast("long").alias("n")) for k, v in kinds.items()])
    return j.select("task_id", F.inline(issues)).where("n > 0")


def submission_lines(answers: DataFrame, delimiter: str = ",") -> DataFrame:
    """task_id, body: one line a row in order of rank, without quoting, each ended by a line feed: video and frames, and for qa the answer."""
    line = F.concat_ws(delimiter, "video", F.array_join("frames", delimiter), F.when(F.col("type") == "qa", clean_answer(F.coalesce("answer_text", F.lit("")))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: F.concat(x["line"], F.lit("\n")))
    return answers.groupBy("task_id").agg(F.array_join(lines, "").alias("body"))


def payload(kind: Column, video: Column, frames: Column, fps: Column, answer: Column) -> Column:
    """What a submission sends: kis start and end in ms as JSON, qa `QA-answer-video-ms`, trake `TR-video-f1,f2`; without the file extension."""
    media = F.regexp_replace(video, r"\.[A-Za-z0-9]+$", "")
    ms = F.bround(F.element_at(frames, 1) / fps * 1000).cast("long")
    kis = F.to_json(F.struct(media.alias("mediaItemName"), ms.alias("start"), ms.alias("end")))
    return F.when(kind == "kis", kis).when(kind == "qa", F.concat(F.lit("QA-"), clean_answer(answer), F.lit("-"), media, F.lit("-"), ms.cast("string"))).otherwise(F.concat(F.lit("TR-"), media, F.lit("-"), F.array_join(frames, ",")))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: 'both', 'a_only' or 'b_only' for each distinct key, and how often it stands in each."""
    x, y = (t.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for t, n in ((a, "n_a"), (b, "n_b")))
    out = x.join(y, key, "full_outer")
    side = F.when(F.col("n_b").isNull(), "a_only").when(F.col("n_a").isNull(), "b_only").otherwise("both")
    return out.select(key, side.alias("side"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def drift(old: DataFrame, new: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """key, class ('added', 'kept', 'changed', 'old_only'), value merged: the new one wins, old ones stay."""
    j = old.select(key, F.col(value).alias("o")).join(new.select(key, F.col(value).alias("n")), key, "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "old_only").when(F.abs(F.col("o") - F.col("n")) > tolerance, "changed").otherwise("kept")
    return j.select(key, kind.alias("class"), F.coalesce("n", "o").alias(value))


def worklist(expected: DataFrame, done: DataFrame, found: DataFrame, key: str, size: str) -> DataFrame:
    """What is left to ingest: expected without those done, with `ready` where the data has been found, and its size."""
    todo = expected.join(done.select(key), key, "left_anti")
    return todo.join(found.select(key, size).withColumn("ready", F.lit(True)), key, "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
