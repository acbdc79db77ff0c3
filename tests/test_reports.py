"""Runs with failing queries, unreadable vectors, restored answers."""

from momentspark.operators import evaluation as ev
from momentspark.operators import pipelines, reports, search

VEC = "model string, name string, video string, pos long, vec array<float>"


def vectors(spark):
    rows = [("m", f"v{k % 2}-0-{k}.jpg", f"v{k % 2}", k // 2, [float(k), 1.0]) for k in range(6)]
    odd = [("m", "x1", "v0", 90, None), ("m", "x2", "v0", 91, []), ("m", "x3", "v0", 92, [float("nan"), 1.0]), ("m", "x4", "v1", 93, [1.0, 2.0, 3.0]), ("m", "x5", "v1", 94, [1.0, None])]
    return spark.createDataFrame(rows + odd, VEC)


def test_unreadable_vectors_are_found_by_no_query(spark):
    q = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", None), (3, "m", [0.0, 1.0, 0.0]), (4, "none", [1.0, 0.0])], "query_id long, model string, qvec array<float>")
    hits = search.top_m(vectors(spark), q, 10)
    got = {}
    for r in search.rerank(hits, vectors(spark), q).collect():
        got.setdefault(r["query_id"], set()).add(r["name"])
    assert got == {1: {f"v{k % 2}-0-{k}.jpg" for k in range(6)}, 3: {"x4"}}


def test_unreadable_frames_score_below_all(spark):
    frames = vectors(spark).selectExpr("video", "name", "pos as frame_idx", "25.0D as fps", "pos", "vec")
    events = spark.createDataFrame([(1, 0, [1.0, 0.0])], "group_id long, event int, qvec array<float>")
    got = {r["name"]: r["score"] for r in pipelines.score_in_videos(spark.createDataFrame([(1, "v0"), (1, "v1")], "group_id long, video string"), events, frames).collect()}
    assert len(got) == 11 and all((got[n] == -1.0) == n.startswith("x") for n in got)


def test_a_failing_query_does_not_touch_the_others(spark):
    frames = vectors(spark).where("name like 'v%'").selectExpr("name", "cast(pos as int) as frame_idx")
    q = spark.createDataFrame([(1, 1, "KIS", "m", [1.0, 0.0]), (1, 2, "QA", "m", None), (1, 3, "KIS", "m", [1.0, 0.0]), (2, 4, "TRAKE", "m", [1.0, 0.0]), (2, 5, "KIS", "m", [1.0])], "run_id int, query_id long, task_type string, model string, qvec array<float>")
    refs = spark.createDataFrame([(1, "v1", [(2, 2)]), (2, "v1", [(0, 0)]), (4, "v0", None), (5, "v0", [(0, 0)])], "query_id long, truth_video string, intervals array<struct<start:int,end:int>>")
    got = {r["query_id"]: r for r in ev.benchmark_run(vectors(spark), q, refs, frames, {"m": 1.0}).collect()}
    assert {k: (r["status"], r["error"]) for k, r in got.items()} == {1: ("completed", None), 2: ("failed", "unreadable vector: m"), 3: ("failed", "no reference"), 4: ("completed", None), 5: ("failed", "unreadable vector: m")}
    assert got[1]["video_rank"] is not None and got[1]["hit_rank"] is not None and got[4]["video_rank"] is not None and got[4]["final_score"] is None and got[2]["video_rank"] is None
    s = {(r["run_id"], r["task_type"]): r for r in ev.run_summary(spark.createDataFrame([r for r in got.values()], ev.benchmark_run(vectors(spark), q, refs, frames, {"m": 1.0}).schema)).collect()}
    assert s[2, "TRAKE"]["final_score"] is None and s[2, "TRAKE"]["video_hit_interval_miss"] is None and s[1, "kis+qa"]["total"] == 3 and s[2, "all"]["total"] == 2


def test_answers_are_restored_once(spark):
    detail = '{"answers":[{"task_id":1,"author_id":5,"created_by":6,"sort_key":2.5,"video":"v","frames":"[1]","answer_text":"","origin":"hand"},{"task_id":2,"created_by":6},{"task_id":9,"created_by":6}]}'
    audit = spark.createDataFrame([(1, "answer.delete", detail, False), (2, "answer.add", detail, None), (3, "answers.clear", "broken", None), (4, "answers.clear", detail, True)], "entry_id long, action string, detail string, restored boolean")
    answers = spark.createDataFrame([], "task_id bigint, author_id bigint, sort_key double, video string, frames string, answer_text string, origin string, created_by bigint, updated_by bigint, restored_from bigint")
    tasks, wanted = spark.createDataFrame([(1,), (2,)], "task_id bigint"), audit.select("entry_id")
    once, marked = reports.restore(audit, wanted, answers, tasks, 8)
    assert sorted((r["task_id"], r["author_id"], r["sort_key"], r["updated_by"], r["restored_from"]) for r in once.collect()) == [(1, 5, 2.5, 8, 1), (2, 6, None, 8, 1)]
    assert {r["entry_id"]: r["restored"] for r in marked.collect()} == {1: True, 2: False, 3: False, 4: True}
    twice, again = reports.restore(marked, wanted, once, tasks, 8)
    assert twice.count() == 2 and again.where("restored").count() == 2
