"""What a review found wrong: small cases that failed before."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from momentspark.operators import annotation
from momentspark.plans import registry

SF = "/root/testdata/sf0.001"


def same(spark, folder, name, table):
    got = registry.QUERIES[name](spark, str(folder)).toPandas()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        want = c.execute(registry.ORACLE_SQL[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
    return got


def test_urls_that_end_in_a_slash(spark, tmp_path):
    urls = [(i, u) for i, u in enumerate(["http://a.org/x", "http://a.org/en/", "http://a.org/en/5/", "http://a.org/", "http://a.org/y.html", "b", "", "http://a.org/z", "http://a.org/q/", "c.d"] * 3)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = same(spark, tmp_path, "page_names", "pages").set_index("page_id")["path"]
    assert got[1] == "" and got[7] is None and got[4] == "y.html" and got[0] == "images/a.jpg"


def test_passes_over_shown_texts_are_of_all_texts(spark):
    """5,000 shorter texts of a video without frames fill the exact pass: what has a frame is found by the folded one alone."""
    bulk = spark.range(5000).select(F.concat(F.lit("x"), "id").alias("name"), F.lit("A").alias("video"), F.lit("cho").alias("text"))
    shown = bulk.union(spark.createDataFrame([("y", "B", "a longer cho")], "name string, video string, text string"))
    asked = spark.createDataFrame([(1, "substring", "cho", ["cho"], False)], "query_id long, mode string, query string, terms array<string>, multi boolean")
    corpus = spark.createDataFrame([("B",)], "video string")
    framed = shown.where("video = 'B'").withColumn("frame_idx", F.lit(0))
    assert annotation._shown_with(shown, framed, asked, corpus).count() == 0


def test_batch_lookup_covers_all_videos(spark):
    videos = {r["video"] for r in registry.QUERIES["text_batch_lookup"](spark, SF).select("video").distinct().collect()}
    assert any(int(v.removeprefix("src")) % 4 == 0 for v in videos)


def test_streamed_top_m_equals_a_loop(spark):
    """Several blocks, parts and slices; ties by name; neighbours go along with the vectors."""

    from momentspark.operators import search

    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (90, 3)).astype(float)
    v = spark.createDataFrame([("m", f"n{(k * 37) % 90:02d}", f"v{k % 3}", k // 3, x[k].tolist()) for k in range(90)], "model string, name string, video string, pos long, vec array<float>")
    q = spark.createDataFrame([(k, "m", x[k].tolist()) for k in range(0, 90, 4)], "query_id long, model string, qvec array<float>")
    joined = {(r["query_id"], r["name"]): (r["raw_score"], r["score"], r["n_neighbors"], r["rank"]) for r in search.rerank(search.top_m(v, q, 7, size=5), v, q).collect()}
    streamed = {(r["query_id"], r["name"]): (r["raw_score"], r["score"], r["n_neighbors"], r["rank"]) for r in search.top_reranked(v, q, 7).collect()}
    assert joined == streamed
    for k in range(0, 90, 4):
        best = sorted((-float(x[k] @ x[i]), f"n{(i * 37) % 90:02d}") for i in range(90))[:7]
        assert {n for _, n in best} == {n for a, n in joined if a == k}


def test_top_m_holds_a_slice_not_a_batch(spark):
    """A block meets more vectors than a slice has, and the product is never wider than that."""
    from momentspark.operators import search

    best = search._Best(np.arange(3), np.eye(3), 2)
    x = np.arange(30.0).reshape(10, 3)
    for at in range(0, 10, 4):
        best.meet(x[at : at + 4], np.arange(at, min(at + 4, 10)), None)
    best.settle()
    assert best.kept[1].tolist() == [9, 8] * 3


def test_top_m_holds_a_few_more_than_m(spark, monkeypatch):
    """What a block holds does not grow with what it met, though each vector is better than all before; ties and sums as in a loop, also where the bound makes many small blocks."""
    import tracemalloc

    from momentspark.operators import search

    best = search._Best(np.arange(1000), np.ones((1000, 1)), 1000)
    x = np.arange(8000.0)[:, None]
    tracemalloc.start()
    for at in range(0, 8000, search.SLICE):
        best.meet(x[at : at + search.SLICE], np.arange(at, min(at + search.SLICE, 8000)), None)
    best.settle()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and best.kept[1].reshape(1000, 1000)[5].tolist() == [*range(7999, 6999, -1)]

    rng = np.random.default_rng(8)
    q, v, near = (rng.integers(-3, 4, (n, 3)).astype(float) for n in (20, 3000, 3000))
    best = search._Best(np.arange(20), q, 30)
    for at in range(0, 3000, 100):
        best.meet(v[at : at + 100], np.arange(at, at + 100), near[at : at + 100])
    best.settle()
    at, sums = (best.kept[k].reshape(20, 30) for k in (1, 3))
    for k in range(20):
        want = np.lexsort((np.arange(3000), -(v @ q[k])))[:30]
        assert at[k].tolist() == want.tolist() and sums[k].tolist() == (near[want] @ q[k]).tolist()

    rows = spark.createDataFrame([("m", f"n{k:03d}", "v", k, v[k].tolist()) for k in range(200)], "model string, name string, video string, pos long, vec array<float>")
    asked = spark.createDataFrame([(k, "m", q[k].tolist()) for k in range(20)], "query_id long, model string, qvec array<float>")
    whole = sorted(search.top_m(rows, asked, 40).collect())
    monkeypatch.setattr(search, "HELD", 2000)
    assert sorted(search.top_m(rows, asked, 40).collect()) == whole and len(whole) == 800


def test_pairs_score_only_places_near_the_anchor(spark):
    from momentspark.operators import pipelines

    plan = pipelines.discover_pairs(
        spark.createDataFrame([(1, 0, "v", "v5", 0.9)], "group_id long, event int, video string, name string, score double"),
        spark.createDataFrame([(1, 0, [1.0]), (1, 1, [1.0])], "group_id long, event int, qvec array<float>"),
        spark.createDataFrame([("v", f"v{k}", k * 40, 25.0, k, [0.5 + k / 100]) for k in range(60)], "video string, name string, frame_idx long, fps double, pos long, vec array<float>"),
        max_frames=3,
    )
    r = plan.collect()[0]
    assert (r["start_name"], r["end_name"], r["n_left"], r["n_right"]) == ("v5", "v8", 4, 4)
    assert "sequence" in plan._jdf.queryExecution().analyzed().toString()


def test_uniform_step_shuffles_ranges_not_steps(spark):
    from momentspark.operators import expansion

    ranges = spark.createDataFrame([(1, 10, 5), (1, 7, 5), (2, 0, 3), (3, 50_000, 1), (4, None, 1), (5, -9, -3), (6, 4000, 4)], "task_id int, half long, need int")
    out = expansion.uniform_step(ranges)
    assert {r["task_id"]: r["step"] for r in out.collect()} == {1: 5, 2: 1, 3: 2000, 4: 1, 5: 2000, 6: 2000}
    assert "Explode" not in out._jdf.queryExecution().analyzed().toString() and "explode" not in out._jdf.queryExecution().analyzed().toString()


def test_event_candidates_come_without_a_table_of_scores(spark):
    from momentspark.operators import temporal
    from momentspark.plans import fixtures as fx

    best = fx.event_best(spark, SF, 10)
    key = ["group_id", "event", "name", "score", "rank"]
    assert sorted(best.select(key).collect()) == sorted(temporal.event_candidates(fx.event_scores(spark, SF), 10).select(key).collect())


def test_greedy_alignment_looks_at_what_is_near(spark):
    from momentspark.operators import temporal
    from momentspark.plans import fixtures as fx

    near = temporal.align_greedy(fx.scores_after_best(spark, SF, 1200), 3, 20).collect()
    assert near and sorted(near) == sorted(temporal.align_greedy(fx.event_scores(spark, SF), 3, 20).collect())


def test_bisection_keeps_to_rows(spark):
    from momentspark.operators import expansion

    out = expansion.bisection(spark.createDataFrame([(1, 0, 16, 5), (2, 5, 5, 4)], "range_id int, lo int, hi int, k int"), 16)
    assert [(r["range_id"], r["frame"]) for r in out.orderBy("range_id", "order").collect()] == [(1, 0), (1, 16), (1, 8), (1, 4), (1, 12), (2, 5)]
    assert "row_number" not in out._jdf.queryExecution().analyzed().toString()


def test_greedy_discovery_scores_only_what_it_can_reach(spark):
    from momentspark.operators import pipelines, temporal

    rng = np.random.default_rng(5)
    rows = [(v, f"{v}{i}", i * 10, 25.0 if v == "a" else 30.0, i, None if i % 7 == 3 else rng.integers(-1, 2, 2 if i % 11 == 5 else 3).astype(float).tolist()) for v in "ab" for i in range(200)]
    rows += [("c", f"c{i}", i * 10, 25.0, i, [-3.0, -3.0, -3.0] if i > 2 else None) for i in range(30)]
    frames = spark.createDataFrame(rows, "video string, name string, frame_idx long, fps double, pos long, vec array<double>")
    events = spark.createDataFrame([(g, e, rng.integers(0, 2, 3).astype(float).tolist()) for g in range(6) for e in range(3)], "group_id long, event int, qvec array<double>")
    videos = spark.createDataFrame([(g, v) for g in range(6) for v in "abc"], "group_id long, video string")
    want = temporal.align_greedy(pipelines.score_in_videos(videos, events, frames), 3, 4).collect()
    scored = pipelines.score_after_first(videos, events, frames, 3, 4)
    assert sorted(temporal.align_greedy(scored, 3, 4).collect()) == sorted(want) and len(want) > 6
    assert scored.where("event = 0").count() == 18


def test_unreadable_frames_are_aligned_without_a_table_of_scores(spark, monkeypatch):
    """Frames of later events are scored only where the gaps reach; the paths are those of all scores."""
    from momentspark.operators import pipelines, temporal
    from momentspark.plans import composites

    reached = []
    monkeypatch.setattr(pipelines, "score_after_first", lambda videos, events, frames, *a, near=pipelines.score_after_first: reached.append((near(videos, events, frames, *a), pipelines.score_in_videos(videos, events, frames))) or reached[-1][0])
    got = composites.trake_unreadable(spark, SF)
    near, whole = reached[0]
    assert sorted(got.collect()) == sorted(temporal.align_greedy(whole, 3, 60).withColumn("path", F.array_join("path", ",")).collect())
    assert near.where("event = 0").count() == len(whole.select("group_id").distinct().collect()) and near.count() < whole.count() / 2


def test_exact_alignment_streams_frames(spark):
    """Equal to the table of all scores: several blocks and chunks, ties, windows longer than a chunk, vectors that cannot be read; no join of groups and frames."""
    from momentspark.operators import pipelines, temporal

    rng = np.random.default_rng(7)
    vec = lambda i: None if i % 17 == 3 else rng.integers(-1, 2, 2 if i % 31 == 5 else 3).astype(float).tolist()
    rows = [(v, f"{v}{i}", i * step, fps, i, vec(i)) for v, step, fps in (("a", 40, 25.0), ("b", 1, 30.0), ("c", 501, 25.0)) for i in range(700)]
    frames = spark.createDataFrame(rows, "video string, name string, frame_idx long, fps double, pos long, vec array<double>")
    events = spark.createDataFrame([(g, e, None if g == 5 and e == 1 else rng.integers(0, 2, 3).astype(float).tolist()) for g in range(9) for e in range(3) if (g, e) != (6, 2)], "group_id long, event int, qvec array<double>")
    videos = spark.createDataFrame([(g, v) for g in range(9) for v in "abc"], "group_id long, video string")
    want = temporal.align_dp(pipelines.score_in_videos(videos, events, frames), 3, 20, [25.0, 30.0]).collect()
    got = temporal.align_frames(videos, events, frames, 3, 20, size=3)
    assert sorted(got.collect()) == sorted(want) and len(want) == 16
    assert got.where("video = 'b'").count() == 8


def test_trake_dp_has_no_table_of_scores(spark):
    from momentspark.operators import temporal
    from momentspark.plans import fixtures as fx

    plan = registry.QUERIES["trake_dp"](spark, SF)
    want = temporal.align_dp(fx.event_scores(spark, SF), 3, 20, [25.0, 30.0]).withColumn("path", F.array_join("path", ","))
    assert sorted(plan.collect()) == sorted(want.collect())
    assert "frame_idx#" in want._jdf.queryExecution().analyzed().toString() and "MapInArrow" in plan._jdf.queryExecution().analyzed().toString()


def test_plans_shuffle_tasks_not_candidates(spark):
    """Candidates are made and ranked in a task's row: no expression explodes or ranks them; nulls and halves as before."""
    from momentspark.operators import expansion

    a = spark.createDataFrame([(1, k, "v" if k else None, [10 * k, 100, None if k == 2 else 300]) for k in range(3)] + [(2, 0, "w", None), (2, 1, "w", [1, 0])], "task_id int, anchor int, video string, frames array<long>")
    w = spark.createDataFrame([(1, 40, [(1, 26, "both"), (90, 99, "up"), (250, 301, "down")]), (2, 4, [(1, 16, "both")])], "task_id int, need int, windows array<struct<lo:long,hi:long,mode:string>>")
    plan = expansion.event_plan(a, w, a.select("task_id", "video", "frames"))
    rows = plan.collect()
    assert sum(r["task_id"] == 1 for r in rows) == 40 and [r["frames"] for r in rows if r["task_id"] == 2] == [[16, 0], [2, 0], [3, 0], [4, 0]]
    analyzed = plan._jdf.queryExecution().analyzed().toString().lower()
    assert "explode" not in analyzed and "row_number" not in analyzed


def test_spreads_shuffle_tasks_not_candidates(spark):
    from momentspark.operators import expansion

    spread = expansion.anchor_spread(
        spark.createDataFrame([(1, 0, "v", 5, 2, None, None, 6), (1, 1, None, 5, 2, "up", 4, 6), (1, 2, "v", None, 2, "up", 4, 6)], "task_id int, anchor int, video string, frame long, step int, direction string, reach long, need int"),
        spark.createDataFrame([(1, "v", 7), (1, None, 7)], "task_id int, video string, frame long"),
    )
    assert [(r["anchor"], r["frame"]) for r in spread.orderBy("rank").collect()] == [(1, 7), (0, 3), (0, 9), (1, 9), (0, 1), (0, 11)]
    analyzed = spread._jdf.queryExecution().analyzed().toString().lower()
    assert "explode" not in analyzed and "row_number" not in analyzed


def term_places(spark, monkeypatch, cuts):
    """Hits of three queries by place, over texts in stretches cut at `cuts`, and what a loop says. Many texts have one length; one is met without accents alone."""
    from momentspark.operators import lexical

    monkeypatch.setattr(lexical, "_cuts", lambda *_: cuts)
    words = ["pho", "phở", "bun", "bún cha", "x", "cha pho", "PHỞ bun", "bun pho x"]
    texts = [(f"n{k:02d}", f"v{k % 3}", words[k % 8] + " z" * (k % 4)) for k in range(60)] + [("blank", "v0", " ")]
    queries = [(1, ["pho", "bun"]), (2, ["phở", "bún cha", "x"]), (3, ["bun pho"]), (4, ["nothing"])]
    flat = lambda t: t.lower().translate(str.maketrans("ởú", "ou"))
    want = {}
    for q, terms in queries:
        rows = []
        for name, video, t in texts:
            whole = [{k: x in s for k, x in enumerate(map(f, terms)) if s.strip() and all(w in s for w in x.split())} for f, s in ((str.lower, t.lower()), (flat, flat(t)))]
            if any(whole):
                own = whole[1] | whole[0]
                rows.append((name, video, len(t), -len(own), bool(whole[1].keys() - whole[0].keys()), -sum(own.values()), *((-len(w), -sum(w.values())) for w in whole)))
        ranks = [{r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[p], r[2], r[0])))} for p in (6, 7)]
        for k, r in enumerate(sorted((r for r in rows if r[1] != "v2"), key=lambda r: (*r[3:6], r[2], r[0]))):
            want[q, r[0]] = r[1], k + 1, ranks[r[4]][r[0]], sum(x[6 + r[4]][0] < 0 for x in rows)
    t, q = spark.createDataFrame(texts, "name string, video string, text string"), spark.createDataFrame(queries, "query_id int, terms array<string>")
    return t, q, spark.createDataFrame([("v0",), ("v1",), ("v1",), ("v9",)], "video string"), want


CUTS = [[], [(3, "n08"), (3, "n16"), (5, "n30"), (9, "n00")]]


@pytest.mark.parametrize("cuts", CUTS)
def test_places_of_terms_come_from_counts(spark, monkeypatch, cuts):
    from momentspark.operators import lexical

    t, q, corpus, want = term_places(spark, monkeypatch, cuts)
    got = lexical.term_search(t, q, corpus)
    assert {(r["query_id"], r["name"]): (r["video"], r["place"], r["pass_rank"], r["pass_total"]) for r in got.collect()} == want
    assert not [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x and "name#" in x]
    assert got.count() == len(want)


@pytest.mark.parametrize("cuts", CUTS)
def test_first_places_of_terms(spark, monkeypatch, cuts):
    from momentspark.operators import lexical

    t, q, corpus, want = term_places(spark, monkeypatch, cuts)
    got = {(r["query_id"], r["name"]): (r["video"], r["place"], r["pass_rank"], r["pass_total"]) for r in lexical.term_search(t, q, corpus, most=5).collect()}
    assert got == {k: v for k, v in want.items() if v[1] <= 5}


@pytest.mark.parametrize("cuts", CUTS)
def test_batch_of_terms_ranks_videos_by_counts(spark, monkeypatch, cuts):
    from momentspark.operators import lexical

    t, q, corpus, want = term_places(spark, monkeypatch, cuts)
    asked = [(1, "v0"), (2, "v1"), (3, "v1"), (3, "v2")]
    got = lexical.batch_term_lookup(t, q, spark.createDataFrame(asked + asked, "query_id int, video string"), corpus)
    first = {}
    for (k, _), (video, place, *_) in want.items():
        first[k, video] = min(place, first.get((k, video), place))
    ranks = {(k, v): (1 + sum(x < p for (a, _), x in first.items() if a == k), sum(a == k for a, _ in first)) for (k, v), p in first.items()}
    assert {(r["query_id"], r["name"]): ((r["video"], r["place"], r["pass_rank"], r["pass_total"]), (r["video_rank"], r["n_videos"])) for r in got.collect()} == {k: (v, ranks[k[0], v[0]]) for k, v in want.items() if (k[0], v[0]) in asked}
    assert not [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x and "name#" in x]


def test_cuts_are_even(spark):
    """Also where nearly all texts have one length."""
    from momentspark.operators import lexical

    t = spark.range(4000).select(F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("name"), F.when(F.col("id") % 50 == 0, "longer").otherwise("text").alias("text"))
    cuts = lexical._cuts(t, 8, 100)
    ends = [0, *(sum((len("longer") if k % 50 == 0 else 4, f"n{k:04d}") < c for k in range(4000)) for c in cuts), 4000]
    assert len(cuts) == 7 and max(b - a for a, b in zip(ends, ends[1:], strict=False)) < 1000


def test_two_tiers_rank_by_counts(spark, monkeypatch):
    """A pass keeps two texts; what the exact pass cuts off may be a normalised hit. Stretches are cut within a length."""
    from momentspark.operators import lexical

    monkeypatch.setattr(lexical, "_cuts", lambda *_: [(3, "b"), (4, "a")])
    t = spark.createDataFrame([("c", "v", "phở"), ("a", "v", "pho"), ("b", "w", "pho"), ("d", "w", "pho x"), ("e", "v", "phở phở")], "name string, video string, text string")
    got = lexical.two_tier_search(t, spark.createDataFrame([(1, "phở"), (2, "nothing")], "query_id int, query string"), most=2, corpus=spark.createDataFrame([("v",), ("w",)], "video string"))
    rows = [tuple(r) for r in got.orderBy("place").collect()]
    assert rows == [(1, "c", "v", "exact", True, 1, 2, 1, 1, 2), (1, "e", "v", "exact", True, 2, 2, 2, 1, 2), (1, "a", "v", "normalized", True, 1, 5, 3, 1, 2), (1, "b", "w", "normalized", True, 2, 5, 4, 2, 2)]


def test_annotation_keeps_every_shown_hit(spark, tmp_path):
    """More than 5,000 shorter texts hold the term of a request: the longer one of its result is annotated all the same."""
    bulk = spark.range(5200).select(F.col("id").alias("doc_id"), F.lit("cho").alias("half"), F.lit("src1").alias("source"))
    rare = spark.createDataFrame([(6000, "a longer cho", "src2"), (6001, "a much longer chợ", "src3"), (6002, "nothing", "src5")], "doc_id long, half string, source string")
    half, word = F.col("half"), F.when(F.col("source") != "src1", " zebra").otherwise("")
    bulk.union(rare).select("doc_id", "source", F.concat(half, word, F.repeat(F.lit("."), F.length(half) - F.length(word))).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, "a zebra c d cho"), (10, "a zebra c d longer")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("annotate_sources", "match_details"):
        got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
        with duckdb.connect() as c:
            for table in ("documents", "benchmark"):
                c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
            want = c.execute(registry.ORACLE_SQL[name]).df()
        rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
        assert rows(got) == rows(want)
        if name == "annotate_sources":
            found = {(r["query_id"], r["video"]): (r["ocr_name"], r["ocr_tier"], r["ocr_where"]) for _, r in got.iterrows()}
            assert found[4, "src2"] == ("doc-6000", "exact", "here") and found[4, "src3"] == ("doc-6001", "normalized", "here") and found[10, "src3"] == ("doc-6001", "exact", "here")
            assert found[4, "src5"][2] == "none"


def test_annotation_searches_each_text_once(spark, monkeypatch):
    """Results are searched for once, shown texts once for all terms, though each is asked for many times."""
    from momentspark.operators import lexical
    from momentspark.plans import annotation as plans

    passes, scan = [], lexical._scan
    monkeypatch.setattr(lexical, "_scan", lambda *a: passes.append(a) or scan(*a))
    out = plans.annotate_sources(spark, SF)
    assert len(passes) == 3  # results, shown texts, speech
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") < 8
