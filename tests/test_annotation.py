"""Where terms stand in a text, against plain versions, and candidate rows against loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from momentspark.operators import annotation as an
from momentspark.operators import expansion as ex


def plain_densest(text, spans, width=90, slack=10):
    if not spans:
        return 0, min(len(text), width)
    best = None
    for i, (start, _) in enumerate(spans):
        inside = [spans[i]]
        for b in spans[i + 1 :]:
            if b[1] > start + width:
                break
            inside.append(b)
        key = (len({text[a:b].lower() for a, b in inside}), len(inside), -start)
        if best is None or key > best[0]:
            best = key, start, max(b for _, b in inside)
    _, start, end = best
    lo = max(0, start - (width - min(end - start, width)) // 2)
    hi = min(len(text), lo + width)
    lo = max(0, hi - width)
    left = [p for p in range(lo, max(lo - slack, 0) - 1, -1) if p == 0 or text[p - 1].isspace()]
    right = [p for p in range(hi, min(hi + slack, len(text)) + 1) if p == len(text) or text[p].isspace()]
    return (left or [lo])[0], (right or [hi])[0]


def test_the_densest_stretch_is_that_of_a_plain_search():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("ab é\n") for _ in range(r.randint(0, 400)))
        spans = sorted((a, min(len(text), a + r.randint(1, 30))) for a in (r.randrange(max(1, len(text))) for _ in range(r.randint(0, 40))) if a < len(text))
        lo, hi = an.densest(text, spans, 40, 5)
        want = plain_densest(text, spans, 40, 5)
        assert (lo, hi) == want
        parts = an.segments(text, spans, lo, hi)
        assert " ".join("".join(s for s, _ in parts).replace("…", "").split()) == " ".join(text[lo:hi].split())


def test_places_are_those_of_the_text_itself():
    text = "Nước SÔI, nưóc đá İi nước"
    for needle, plain, want in (("nuoc", True, ["Nước", "nưóc", "nước"]), ("nước", False, ["Nước", "nước"]), ("da", True, ["đá"]), ("soi,", True, ["SÔI,"])):
        assert [text[a:b] for a, b in an.occurrences(an.mapped(text, plain), needle, 200)] == want
    assert an.spans_of("fire water", [{"text": "fire near", "words": ["fire", "near"], "plain": False}], None) == [(0, 4)]
    assert an.spans_of("aXbX", [], "x") == [(1, 2), (3, 4)] and an.spans_of("abc", [], "x*") == []


def test_a_hundred_thousand_hits_take_no_time():
    text = "ab " * 100_000
    start = time.time()
    spans = an.spans_of(text, [{"text": "ab", "words": [], "plain": True}], None)
    assert len(spans) == an.MOST_SPANS and an.densest(text, spans)[0] == 0
    assert an.densest(text, [(3 * k, 3 * k + 2) for k in range(100_000)])[0] == 0
    assert time.time() - start < 1.5


def test_segments_of_odd_texts():
    assert an.segments("", [], 0, 0) == [] and an.segments(" \n ", [], 0, 3) == []
    assert an.segments("a  b\n\nc", [(0, 1), (1, 3)], 0, 7) == [("a ", True), ("b c", False)]
    assert an.segments("x" * 200, [(50, 150)], 40, 130) == [("…" + "x" * 10, False), ("x" * 80, True), ("…", False)]


def test_plan_of_requests(spark):
    cols = "query_id int, asr_filter string, asr_mode string, ocr_filter string, ocr_mode string, text_filter string, text_mode string"
    rows = [(1, "a", "bm25", "b", "regex", "c", "substring"), (2, None, "bm25", " b ", "bm25", None, None), (3, " ", "regex", None, None, "c,d", "bm25"), (4, None, None, None, None, "c,d", "regex"), (5, None, None, None, None, " ", "regex"), (6, "a", None, "b", "regex", None, None)]
    got = {r[0]: tuple(r)[1:] for r in an.plan(spark.createDataFrame(rows, cols)).collect()}
    assert got == {
        1: ("a", "bm25", "b", "regex", True, "mixed"), 2: (None, None, None, None, True, ""), 3: ("c,d", "bm25", None, None, False, "bm25"),
        4: ("c,d", "regex", "c,d", "regex", False, "regex"), 5: (None, None, None, None, False, ""), 6: (None, None, "b", "regex", True, "regex"),
    }


def plain_spread(anchors, existing, need):
    """One task: anchors (anchor, video, frame, step, direction, reach)."""
    taken, out, k = set(existing), [], 1
    while len(out) < need and k < 5000:
        live = [a for a in anchors if a[3] > 0 and (a[5] <= 0 or k * a[3] <= a[5])]
        if not live:
            break
        for sign in (1, -1):
            for a in live:
                at = a[2] + sign * k * a[3]
                if (a[4] == "up" and sign < 0) or (a[4] == "down" and sign > 0) or at < 0 or (a[1], at) in taken or len(out) == need:
                    continue
                taken.add((a[1], at))
                out.append((a[0], a[1], at, len(out) + 1))
        k += 1
    return out


ANCHORS = "task_id int, anchor int, video string, frame long, step int, direction string, reach int, need int"


def test_spread_without_a_reach_has_no_bound(spark):
    far = spark.createDataFrame([(1, 0, "a", 100, 3, "up", 0, 500), (2, 0, "a", 0, 10, "up", 0, 5), (3, 0, "a", 35, 10, "down", 0, 9), (4, 0, "a", 5, 1, "both", 0, 0)], ANCHORS)
    there = spark.createDataFrame([(2, "a", 10 * k) for k in range(201)] + [(1, "b", 103)], "task_id int, video string, frame long")
    got = {}
    for r in ex.anchor_spread(far, there).orderBy("task_id", "rank").collect():
        got.setdefault(r["task_id"], []).append(r["frame"])
    assert got == {1: [100 + 3 * k for k in range(1, 501)], 2: [2010, 2020, 2030, 2040, 2050], 3: [25, 15, 5]}


@pytest.mark.parametrize("seed", [1, 2])
def test_spread_is_that_of_a_loop(spark, seed):
    r = random.Random(seed)
    tasks, anchors, there, want = {}, [], [], []
    for t in range(40):
        tasks[t] = [(a, r.choice("ab"), r.randint(0, 60), r.choice([0, 1, 2, 5, 9]), r.choice(["both", "up", "down"]), r.choice([0, 0, 3, 20, 50])) for a in range(r.randint(1, 5))]
        need, exist = r.randint(0, 40), {(r.choice("ab"), r.randint(0, 90)) for _ in range(r.randint(0, 60))}
        anchors += [(t, *a, need) for a in tasks[t]]
        there += [(t, *e) for e in exist]
        want += [(t, *x) for x in plain_spread(tasks[t], exist, need)]
    got = ex.anchor_spread(spark.createDataFrame(anchors, ANCHORS), spark.createDataFrame(there, "task_id int, video string, frame long"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def plan_rows(spark, anchors, windows, need, existing=()):
    a = spark.createDataFrame([(1, k, v, f) for k, (v, f) in enumerate(anchors)], "task_id int, anchor int, video string, frames array<long>")
    w = spark.createDataFrame([(1, need, windows)], "task_id int, need int, windows array<struct<lo:long,hi:long,mode:string>>")
    e = spark.createDataFrame([(1, v, f) for v, f in existing], "task_id int, video string, frames array<long>")
    return [(r["video"], r["frames"]) for r in ex.event_plan(a, w, a.select("task_id", "video", "frames").union(e)).orderBy("rank").collect()]


def test_event_plan_takes_turns_and_moves_windows_along(spark):
    got = plan_rows(spark, [("v", [100, 250]), ("w", [700, 800])], [(90, 120, "both"), (230, 275, "both")], 6)
    assert len(got) == 6 and [v for v, _ in got[:4]] == ["v", "w", "v", "w"]
    for video, frames in got:
        base, low, high = ([100, 250], [90, 230], [120, 275]) if video == "v" else ([700, 800], [690, 780], [720, 825])
        changed = [k for k in (0, 1) if frames[k] != base[k]]
        assert len(changed) == 1 and low[changed[0]] <= frames[changed[0]] <= high[changed[0]]


def test_event_plan_makes_a_dense_pass_where_windows_are_narrow(spark):
    got = plan_rows(spark, [("v", [100, 250])], [(99, 101, "both"), (200, 300, "up")], 30)
    assert len(got) == 30 and sum(f[0] != 100 for _, f in got) == 2
    assert len(plan_rows(spark, [("v", [100, 250])], [(99, 101, "both")], 30)) == 2
    assert plan_rows(spark, [("v", [3])], [(-50, 4, "both")], 3, [("v", [4])]) == [("v", [2]), ("v", [0]), ("v", [1])]
    assert plan_rows(spark, [("v", [3])], [], 3) == []


def test_match_details_of_windows_and_frames(spark):
    cols = "text string, search string, source string, query string, terms array<string>, found array<struct<term:int,tier:string>>, multi boolean, frame_idx long, fps double, start_s double, end_s double"
    rows = [
        ("Fire and wáter", "substring", "ocr", "x", ["fire", "water"], [(0, "exact"), (1, "normalized")], True, 50, 25.0, None, None),
        ("", "bm25", "asr", "a b", ["a b"], None, False, 0, 25.0, 10.0, 70.0), ("b c b", "bm25", "asr", "a b", ["a b"], None, False, 0, 25.0, 10.0, 70.0), (None, "regex", "ocr", "a+", ["a+"], None, False, 10, 25.0, None, None),
    ]
    out = an.details(spark.createDataFrame(rows, cols)).collect()
    assert [(s["text"], s["hit"]) for s in out[0]["segments"]] == [("Fire", True), (" and ", False), ("wáter", True)] and out[0]["matched_terms"] == ["fire", "water"] and out[0]["at_s"] == 2.0
    assert (out[1]["at_s"], out[1]["segments"], out[1]["terms_total"]) == (40.0, [], 2)
    assert (out[2]["matched_terms"], out[2]["n_spans"], out[2]["at_s"], out[2]["time_approx"]) == (["b"], 2, 40.0, True)
    assert out[3]["segments"] == [] and out[3]["at_s"] == 0.4
    assert an.details(spark.createDataFrame([], cols)).agg(F.count("*")).first()[0] == 0
