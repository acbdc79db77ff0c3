"""Operators that SQL does not express, against plain loops; golden cases; sources and streams."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from momentspark.functions import media, text
from momentspark.operators import evaluation, expansion, lexical, search, temporal, timeline
from momentspark.sources import readers, writers
from momentspark.streaming import activity


# fixed values: what a rule of separators must give, whatever implements it
@pytest.mark.parametrize(
    ("given", "want"),
    [("a, b", ["a", "b"]), ("1,5 kg; x", ["1,5 kg", "x"]), ("nuoc, nước", ["nuoc"]), ("，a；b、c", ["a", "b", "c"]), (",,", []), ("", []), ("2018,2019", ["2018,2019"]), ("a,b,c,d,e,f", ["a", "b", "c", "d", "e"]), (" x ", ["x"]), ("A; a", ["A"])],
)
def test_split_terms(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.split_terms(F.col("t"))).first()[0] == want


def test_fold_and_parts(spark):
    row = spark.createDataFrame([("Đường đi Đà Nẵng Nước ố", "A. B.  C. ")], "t string, q string").select(text.fold(F.col("t")), text.split_query_text(F.col("q"))).first()
    assert row[0] == "Duong di Da Nang Nuoc o" and row[1] == ["A", "B", "C"]


def test_phase(spark):
    rows = spark.createDataFrame([("2",), ("P2",), ("p2",), ("p1",), ("x",), (None,)], "p string").select(text.normalize_phase(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["p2", "p2", "p2", "p1", "p1", "p1"]


def test_names_and_clock(spark):
    df = spark.createDataFrame([("N001-V001-0000-24.jpg", 25.0, 100), ("L24_V010-0031-abc.jpg", 0.0, 5), ("noimagehere", 30.0, -1)], "name string, fps double, f int")
    rows = df.select(media.parse_name(F.col("name")), media.clock(F.col("f"), F.col("fps"))).collect()
    assert tuple(rows[0][0]) == ("N001-V001", 0, 24) and rows[0][1] == "00:00:04.000" and rows[1][0] is None and rows[1][1] == "" and rows[2][1] == ""
    assert readers.check_names(spark.createDataFrame([("V-0001-8.jpg", "V", 1, 8), ("V-0001-9.jpg", "V", 1, 8)], "name string, video string, scene_id int, frame_idx int")).count() == 1


def test_cut_prune(spark):
    r = random.Random(1)
    rows = [(str(v), pos, round(r.random(), 3)) for v in range(8) for pos in sorted(r.sample(range(400), 30))]
    got = {}
    for x in timeline.prune_cuts(spark.createDataFrame(rows, "video string, pos int, p double")).collect():
        got.setdefault(x["video"], []).append(x["pos"])
    for v in range(8):
        kept = []
        for _, pos, p in (x for x in rows if x[0] == str(v)):
            if not kept or pos - kept[-1][0] >= 12:
                kept.append((pos, p))
            elif p > kept[-1][1]:
                kept[-1] = (pos, p)
        assert sorted(got[str(v)]) == [k for k, _ in kept]


def test_scene_samples(spark):
    rows = [("a", 0, 3, 25.0), ("b", 10, 51, 25.0), ("c", 0, 1999, 30.0), ("d", 0, 1, 25.0)]
    got = {}
    for x in timeline.sample_scenes(spark.createDataFrame(rows, "video string, start long, end long, fps double")).collect():
        got.setdefault(x["video"], []).append(x["frame_idx"])
    assert sorted(got["a"]) == [1, 2] and sorted(got["b"]) == [13, 48] and len(got["c"]) == 35 and sorted(got["d"]) == [0, 1]


def log(r, n):
    kinds = ["search", "pick", "pick", "basket_empty"]
    return [(f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", k, r.randint(0, 2), 0, r.choice(["q1", "q1", "q1", "q2", " ", None]), r.choice(kinds), r.choice("abc"), r.choice(["s", "s", "s", None])) for k in range(n)]


def fold(rows):
    """Attempts (user, task, first event, query, type, picks, closed) by a loop."""
    every = []
    for _, i, u, t, q, kind, picked, how in rows:
        mine = [x for x in every if x[:2] == [u, t]]
        if kind == "basket_empty":
            if with_picks := [x for x in mine if x[5] and not x[6]]:
                with_picks[-1][6] = True
            continue
        if not (q or "").strip():
            continue
        if not mine or mine[-1][6] or mine[-1][3:5] != [q, how]:
            mine.append([u, t, i, q, how, [], False])
            every.append(mine[-1])
        if kind == "pick" and picked not in mine[-1][5]:
            mine[-1][5].append(picked)
    return sorted((*x[:5], tuple(x[5]), x[6]) for x in every)


LOG = "ts string, event_id long, user_id long, task_id long, query string, kind string, picked string, type string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_attempt_folding(spark, seed):
    rows = log(random.Random(seed), 300)
    got = activity.fold_attempts(spark.createDataFrame(rows, LOG).withColumn("ts", F.to_timestamp("ts"))).collect()
    first = {f"{x[0]}": x[1] for x in rows}
    assert sorted((r["user_id"], r["task_id"], first[f"{r['started']}"], r["query"], r["type"], tuple(r["picks"]), r["closed"]) for r in got) == fold(rows)


def test_streams(spark, tmp_path):
    """Attempts and presence from input that comes out of order within the watermark, over several batches, equal those of the batch form."""
    activity.use_rocksdb(spark)
    rows = log(random.Random(9), 200)
    end = [("2024-01-02 00:00:00", 10_000, 99, 0, "end", "search", "a", None)]
    df = spark.createDataFrame(rows + end, LOG).withColumn("ts", F.to_timestamp("ts"))
    r = random.Random(4)
    mixed = sorted(rows, key=lambda x: x[1] + r.randint(0, 60))
    for part in range(5):
        some = mixed[50 * part : 50 * part + 50] if part < 4 else end
        spark.createDataFrame(some, LOG).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")

    def run(stream, name, mode="append"):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    last = {}
    for x in run(activity.stream_attempts(source(), "5 minutes"), "attempts", "update"):
        last[x["attempt"]] = max(last.get(x["attempt"], ()), (x["ended"], len(x["picks"]), x["closed"], x), key=lambda v: v[:3])
    got = sorted((x["user_id"], x["task_id"], x["attempt"], x["query"], x["type"], tuple(x["picks"]), x["closed"]) for *_, x in last.values() if x["user_id"] != 99)
    assert got == fold(rows)
    seen = {}
    for x in run(activity.stream_presence(source(), 30, "5 minutes"), "presence", "update"):
        seen.setdefault(x["user_id"], []).append((x["seen"], x["online"]))
    want = {u: max(x[0] for x in rows if x[2] == u) for u in range(3)}
    assert {u: f"{v[-1][0]}" for u, v in seen.items() if u != 99} == want and all(not v[-1][1] for u, v in seen.items() if u != 99) and seen[99][-1][1]
    first = run(activity.stream_first_seen(source(), ["user_id", "query", "kind"], "1 hour"), "firsts")
    assert len(first) == len({(x[2], x[4], x[5]) for x in rows + end})
    assert run(activity.stream_sessions(source(), "1 second", "1 second"), "sessions")
    for _ in range(2):
        activity.ingest(source(), f"{tmp_path}/out", "event_id", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 201
    activity.append_new(f"{tmp_path}/out", "event_id")(df, 7)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 201
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bisection(spark):
    got = expansion.bisection(spark.createDataFrame([(1, 0, 16, 7), (2, 5, 5, 4)], "range_id int, lo int, hi int, k int"), 16).orderBy("range_id", "order").collect()
    assert [r["frame"] for r in got if r["range_id"] == 1] == [0, 16, 8, 4, 12, 2, 6] and [r["frame"] for r in got if r["range_id"] == 2] == [5]


def test_interval_scoring_golden(spark):
    q = spark.createDataFrame([(1, "V", [(10, 20), (15, 30)]), (2, "V", [(1, 2)])], "query_id int, truth_video string, intervals array<struct<start:int,end:int>>")
    ranked = spark.createDataFrame([(1, "W", 1, 15), (1, "V", 2, 9), (1, "V", 3, None), (1, "V", 4, 20), (2, "V", 1, 3)], "query_id int, video string, rank int, frame_idx int")
    rows = {r["query_id"]: r for r in evaluation.score_intervals(q, ranked).collect()}
    assert (rows[1]["hit_rank"], rows[1]["hit_interval"], rows[1]["final_score"]) == (4, 0, 0.8) and rows[2]["hit_rank"] is None and rows[2]["final_score"] == 0


def test_rerank_keeps_lone_frames_and_fusion_handles_low_scores(spark):
    v = spark.createDataFrame([("m", "a", "A", 0, [1.0, 0.0]), ("m", "b", "B", 0, [-1.0, 0.0]), ("m", "c", "B", 1, [-0.5, 0.0])], "model string, name string, video string, pos long, vec array<float>")
    q = spark.createDataFrame([(1, "m", [1.0, 0.0])], "query_id long, model string, qvec array<float>")
    hits = search.rerank(search.top_m(v, q, 5), v, q)
    assert {r["name"]: (r["score"], r["n_neighbors"]) for r in hits.collect()} == {"a": (0.0, 0), "b": (-0.5, 1), "c": (-1.0, 1)}
    fused = {r["name"]: r["distance"] for r in search.fuse(hits, {"m": 1.0}).collect()}
    assert fused == {"a": 0.0, "b": -50.0, "c": -100.0}
    with pytest.raises(ValueError):
        search.in_groups(fused and search.fuse(hits, {"m": 1.0}), ["Z"])


@pytest.mark.parametrize("gap", [None, 2.0, 0.5])
def test_alignments_equal_loops(spark, gap):
    r = random.Random(3)
    rows = [(g, e, "V", f"f{i}", i * 10, 25.0 if g % 2 else 30.0, i, round(r.random(), 1)) for g in range(12) for e in range(3) for i in range(12)]
    scored = spark.createDataFrame(rows, "group_id int, event int, video string, name string, frame_idx long, fps double, pos long, score double")
    dp = {x["group_id"]: (x["total"], x["path"]) for x in temporal.align_dp(scored, 3, gap, [25.0, 30.0]).collect()}
    greedy = {x["group_id"]: x["path"] for x in temporal.align_greedy(scored, 3, gap).collect()}
    for g in range(12):
        s = {(e, f): sc for gg, e, _, _, f, _, _, sc in rows if gg == g}
        fps = 25.0 if g % 2 else 30.0
        ok = lambda a, b: a < b and (gap is None or b - a <= gap * fps)  # noqa: B023, E731
        frames = range(0, 120, 10)
        paths = [(-(round(s[0, a] + s[1, b] + s[2, c], 6)), c, b, a) for a in frames for b in frames if ok(a, b) for c in frames if ok(b, c)]
        if paths:
            t, c, b, a = min(paths)
            assert dp[g] == (-t, [a, b, c])
        else:
            assert g not in dp
        path = [max(frames, key=lambda f: (s[0, f], -f))]  # noqa: B023
        for e in (1, 2):
            near = [f for f in frames if ok(path[-1], f)]
            if not near:
                path = None
                break
            path.append(max(near, key=lambda f: (s[e, f], -f)))  # noqa: B023
        assert greedy.get(g) == path


def test_near_frames(spark):
    rows = [("V", 0, i, f"n{i}", v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [0.01, 1.0]])] + [("V", 1, 9, "x", [1.0, 0.0]), ("V", 1, 10, "y", [1.0, 0.0])]
    got = timeline.drop_near_frames(spark.createDataFrame(rows, "video string, scene_id long, frame_idx long, name string, vec array<float>"))
    assert {r["name"] for r in got.collect()} == {"n0", "n2", "x", "y"}


def test_blank_queries_find_nothing(spark):
    t = spark.createDataFrame([("a", "Chợ Lớn"), ("b", "cho lon (")], "name string, text string")
    q = spark.createDataFrame([(1, " "), (2, "cho lon"), (3, "("), (4, "Chợ")], "query_id int, query string")
    hits = lambda f: sorted((r["query_id"], r["name"]) for r in lexical.phrase_search(t, q, 10, f)[0].collect())
    assert hits(False) == [(2, "b"), (3, "a"), (3, "b"), (4, "a")]  # a query without a word finds every text
    assert hits(True) == [(2, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "a"), (4, "b")]


def test_sources(spark, tmp_path):
    frames = [{"name": f"V-0000-{i}.jpg", "video": "V", "scene_id": 0, "frame_idx": i, "fps": 25.0} for i in (0, 8)]
    (tmp_path / "k.json").write_text(json.dumps([*frames, {**frames[0], "name": "V-0000-0.png"}], indent=1))
    assert readers.keyframes(spark, str(tmp_path / "k.json")).count() == 2
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        json.dump({"a": "Chợ", "b": " "}, f)
    names = readers.json_map(spark, str(tmp_path / "t.json.gz"), "name", "text")
    assert names.count() == 2 and readers.json_map(spark, str(tmp_path / "none"), "name", "text").count() == 0
    assert [r["text_folded"] for r in readers.onscreen_text(names, names).collect()] == ["cho"]
    with pytest.raises(Exception, match="one map only"):
        readers.onscreen_text(names, names.where("name = 'a'")).collect()
    windows = [{"video_id": "V", "sample_start": 16000 * s, "sample_end": 16000 * (s + 60), "sample_rate": 16000, "eligible": s != 45, "retrieval_text": f"w{s}"} for s in (90, 0, 45)]
    (tmp_path / "w.jsonl").write_text("\n".join(map(json.dumps, windows)))
    assert [tuple(r) for r in readers.speech_windows(spark, str(tmp_path / "w.jsonl")).orderBy("doc_id").collect()] == [("V", 0, 0.0, 60.0, "w0"), ("V", 1, 90.0, 150.0, "w90")]
    seed = {"schema_version": 2, "slug": "s", "version": "1", "query_count": 3, "task_counts": {"kis": 2}, "queries": [{"query_key": "a", "task_type": "kis", "valid_intervals": [{"start": 5, "end": 1}]}, {"query_key": "a", "task_type": "trake", "valid_intervals": [{"start": 1, "end": 2}]}]}
    (tmp_path / "s.json").write_text(json.dumps(seed))
    assert {r["issue"] for r in readers.benchmark_seed(spark, str(tmp_path / "s.json"))[1].collect()} == {"query_count", "task_counts", "repeated_key", "trake_with_intervals", "start_after_end"}
    (tmp_path / "pack").mkdir()
    for name in ("query-p1-10-kis.txt", "query-p1-9-trake.txt", "readme.txt"):
        (tmp_path / "pack" / name).write_text("﻿body \n")
    tasks, odd = readers.query_pack(spark, str(tmp_path / "pack"))
    assert [(r["code"], r["type"], r["body"]) for r in tasks.collect()] == [("9", "trake", "body"), ("10", "kis", "body")] or [r["code"] for r in tasks.collect()] == ["9", "10"]
    assert odd.count() == 1
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, vec array<float>")
    mapping = spark.createDataFrame([("0", "/static/images/a.jpg"), ("1", "broken")], "id string, url string")
    assert [tuple(r) for r in readers.mapped_vectors(vectors, mapping, "m").collect()] == [("m", "a.jpg", [1.0])]
    reply = spark.createDataFrame([('ok {"keywords": [" a ", ""], "confidence": "HIGH"} x',), ("no",)], "reply string").select(readers.json_reply().alias("r")).collect()
    assert (reply[0]["r"]["keywords"], reply[0]["r"]["confidence"]) == (["a"], "high") and (reply[1]["r"]["keywords"], reply[1]["r"]["confidence"]) == ([], "none")


def test_sinks(spark, tmp_path):
    writers.submissions(spark.createDataFrame([(1, 'V,1,"q"\nV,2,x\n'), (2, "")], "task_id int, body string"), str(tmp_path / "sub"))
    read = lambda t: "".join(p.read_text() for p in (tmp_path / "sub" / f"task_id={t}").glob("part-*"))
    assert read(1) == 'V,1,"q"\nV,2,x\n' and read(2).strip() == ""
    writers.results(spark.createDataFrame([(1, 'a "b", c')], "q int, t string"), str(tmp_path / "csv"))
    assert 'a ""b"", c' in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
