"""Result videos annotated by what is said and what is shown: one hit for each source, and where in its text it stands.

A request has a query and a mode for speech (substring, regex, bm25) and for on-screen text (substring, regex); either may be off.
Results are neither removed nor put in another order.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentspark.functions.media import moment
from momentspark.functions.text import fold, split_terms, tokens
from momentspark.sources.scratch import Scratch

from . import lexical, timeline

WIDTH, SLACK, MOST_SPANS = 90, 10, 200
ON_SCREEN, SPEECH = ("substring", "regex"), ("substring", "regex", "bm25")


def plan(requests: DataFrame) -> DataFrame:
    """query_id, asr_query, asr_mode, ocr_query, ocr_mode (null: off), multi_term, mode: which source is searched for what.

    requests: query_id, asr_filter, asr_mode, ocr_filter, ocr_mode, text_filter, text_mode. Filters of their own win over the one for both, which is
    never split into terms and asks speech alone where its mode is bm25. mode is that of the source in use, 'mixed' for two with
    filters of their own, '' for none. A blank filter is none; a mode that a source does not have turns it off.
    """
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    own = said(F.col("asr_filter")).isNotNull() | said(F.col("ocr_filter")).isNotNull()
    query = lambda s: F.when(own, said(F.col(f"{s}_filter"))).otherwise(said(F.col("text_filter")))
    mode = lambda s, known: F.when(query(s).isNotNull(), F.when(own, F.col(f"{s}_mode")).otherwise(F.col("text_mode"))).isin(*known)
    chosen = lambda s, known: F.when(mode(s, known), F.when(own, F.col(f"{s}_mode")).otherwise(F.col("text_mode")))
    asr, ocr = chosen("asr", SPEECH), chosen("ocr", ON_SCREEN)
    label = F.when(~own, F.when(query("asr").isNotNull(), F.col("text_mode"))).when(asr.isNotNull() & ocr.isNotNull(), "mixed").otherwise(F.coalesce(asr, ocr))
    return requests.select("query_id", F.when(asr.isNotNull(), query("asr")).alias("asr_query"), asr.alias("asr_mode"), F.when(ocr.isNotNull(), query("ocr")).alias("ocr_query"), ocr.alias("ocr_mode"), own.alias("multi_term"), F.coalesce(label, F.lit("")).alias("mode"))


def _asked(planned: DataFrame, source: str) -> DataFrame:
    """query_id, mode, query, terms, multi of the requests that use a source; a list without a term uses none."""
    many = F.col("multi_term") & (F.col(f"{source}_mode") == "substring")
    q = planned.where(F.col(f"{source}_mode").isNotNull()).select("query_id", F.col(f"{source}_mode").alias("mode"), F.col(f"{source}_query").alias("query"), F.when(many, split_terms(F.col(f"{source}_query"))).otherwise(F.array(f"{source}_query")).alias("terms"))
    return q.where(F.size("terms") > 0).withColumn("multi", F.size("terms") > 1)


def _bits(whole: str, exact: str) -> Column:
    """(term, tier) of the terms that bits say are there; those in `exact` are of that tier."""
    has = lambda c, k: F.getbit(F.col(c), k) == 1
    numbers = F.sequence(F.lit(0), F.greatest(F.length(F.bin(whole)) - 1, F.lit(0)))
    return F.transform(F.filter(numbers, lambda k: has(whole, k)), lambda k: F.struct(k.alias("term"), F.when(has(exact, k), "exact").otherwise("normalized").alias("tier")))


COLUMNS = ["query_id", "video", "name", "tier", "found", "place", "video_rank", "n_videos", "exact_phrase"]


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _frames_with(texts: DataFrame, asked: DataFrame, place: str) -> DataFrame:
    """Frames that hold a term as a whole, or that a pattern matches; by `place`. Nothing ranks their videos."""
    found = "array<struct<term:int,tier:string>>"
    s = lexical.scan(texts, asked.where("mode = 'substring'").select("query_id", "terms")).withColumn("whole", F.col("exact_phrase").bitwiseOR(F.col("folded_phrase"))).where("whole > 0")
    s = s.select("query_id", "video", "name", F.when(F.col("whole") == F.col("exact_phrase"), "exact").otherwise("normalized").alias("tier"), _bits("whole", "exact_phrase").alias("found"), F.col(place).cast("long").alias("place"))
    return s.unionByName(_matching(texts, asked, place, found)).select("*", _none("int").alias("video_rank"), _none("long").alias("n_videos"), _none("boolean").alias("exact_phrase"))


def _matching(texts: DataFrame, asked: DataFrame, place: str, found: str) -> DataFrame:
    r = lexical.pattern_search(texts.select("name", "text"), asked.where("mode = 'regex'").select("query_id", F.col("query").alias("pattern"))).join(texts.select("name", "video", place), "name")
    return r.select("query_id", "video", "name", F.lit("exact").alias("tier"), _none(found).alias("found"), F.col(place).cast("long").alias("place"))


def _windows_with(windows: DataFrame, frames: DataFrame, asked: DataFrame) -> DataFrame:
    """The best window of each video by BM25, at the frame nearest to its start; its rank is that among videos with frames."""
    scores = lexical.bm25(windows.select("doc_id", "text"), asked.where("mode = 'bm25'").select("query_id", "query"))
    best = lexical.best_window(scores, windows.select("doc_id", "video", "start_s")).join(frames.select("video", "fps").distinct(), "video")
    probes = best.select("video", (F.col("start_s") * F.col("fps")).alias("x"), "query_id", "doc_id", "rank")
    w = Window.partitionBy("query_id")
    ranked = timeline.nearest(probes, frames.select("video", "frame_idx", "name")).withColumn("video_rank", F.row_number().over(w.orderBy("rank"))).withColumn("n_videos", F.count(F.lit(1)).over(w))
    return ranked.select("query_id", "video", F.col("nearest.name").alias("name"), F.lit("exact").alias("tier"), _none("array<struct<term:int,tier:string>>").alias("found"), F.col("rank").cast("long").alias("place"), "video_rank", "n_videos", _none("boolean").alias("exact_phrase"), "doc_id")


def _shown_with(shown: DataFrame, texts: DataFrame, asked: DataFrame, corpus: DataFrame, pairs: DataFrame | None = None, most: int | None = 5000) -> DataFrame:
    """On-screen text: terms by two passes (videos of the corpus ranked by their first frame), patterns frame by frame.

    The passes are over all of `shown`, so that ranks in a pass and what it keeps are those of all texts; `texts` are those of them that have a frame.
    `most`: texts that each pass keeps for a query of one term, all if None. Only hits of `pairs` (query_id, video) are given, if stated, but for those of one term
    where a pass keeps `most`.
    """
    found, terms = "array<struct<term:int,tier:string>>", asked.where("mode = 'substring'").select("query_id", "terms")
    if most is None:  # the order of several terms is that of two passes for one: exact before normalised, whole phrases, shorter texts, names
        one, many = None, lexical.batch_term_lookup(shown, terms, pairs, corpus)
    else:
        one, many = lexical.shown_terms(shown, terms, pairs, corpus, most)
        one = one.select("query_id", "video", "name", "tier", F.array(F.struct(F.lit(0).alias("term"), F.col("tier").alias("tier"))).alias("found"), F.col("place").cast("long").alias("place"), "video_rank", "n_videos", F.col("is_phrase").alias("exact_phrase"))
    many = many.select("query_id", "video", "name", F.when(F.col("worst_tier") == 2, "exact").otherwise("normalized").alias("tier"), F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tier"].alias("tier"))).alias("found"), F.col("place").cast("long").alias("place"), "video_rank", "n_videos", F.col("all_phrases").alias("exact_phrase"))
    matched = _matching(texts, asked, "frame_idx", found).select("*", _none("int").alias("video_rank"), _none("long").alias("n_videos"), _none("boolean").alias("exact_phrase"))
    return (many if one is None else one.unionByName(many)).unionByName(matched)


def _choose(results: DataFrame, hits: DataFrame, asked: DataFrame) -> DataFrame:
    """The hit that stands for a source in each (query, video): most terms (of several), exact before normalised, a frame among the results
    before one elsewhere, then its place; with `where` ('here', 'elsewhere')."""
    shown = results.select("query_id", "video", "name").distinct().withColumn("where", F.lit("here"))
    hits = hits.join(results.select("query_id", "video").distinct(), ["query_id", "video"], "left_semi").join(shown, ["query_id", "video", "name"], "left").withColumn("where", F.coalesce("where", F.lit("elsewhere")))
    hits = hits.join(asked.select("query_id", "multi"), "query_id")
    rank = F.struct(-F.when(F.col("multi"), F.size("found")).otherwise(0), (F.col("tier") != "exact"), F.col("where") != "here", "place", "name")
    return hits.groupBy("query_id", "video").agg(F.min_by(F.struct(*(c for c in hits.columns if c not in ("query_id", "video", "multi"))), rank).alias("hit")).select("query_id", "video", "hit.*")


def annotate_sources(results: DataFrame, requests: DataFrame, frames: DataFrame, speech: DataFrame, windows: DataFrame, shown: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(annotations, hits) for the videos of `results` (query_id, video, name).

    annotations: query_id, video, matched, score (1 if a source matched), mode, and for asr and ocr `<s>_name`, `<s>_tier`, `<s>_where` ('here', 'elsewhere', 'none').
    hits: source, query_id, video, name and what `details` needs. requests as in `plan`. frames: video, name, frame_idx, fps. speech and shown: name, video, text
    of frames. windows: doc_id, video, start_s, end_s, text. Only videos that have frames take part. An invalid pattern turns its source off.
    `most`: texts that each pass over on-screen text keeps for a query of one term; all if None, so that no hit is missed.
    Results and the plan are asked for many times; they are written to the shared folder once.
    """
    scratch = Scratch(results.sparkSession, "annotation")
    results = scratch.write(results.select("query_id", "video", "name"), "results")
    planned, corpus = scratch.write(plan(requests), "plan"), frames.select("video").distinct()
    wanted = results.select("video").distinct()
    placed = lambda t: t.select("name", "video", "text").join(frames.select("name", "frame_idx"), "name")
    asr, ocr = (scratch.write(_asked(planned, s), s) for s in ("asr", "ocr"))
    said = _frames_with(placed(speech).join(wanted, "video", "left_semi"), asr, "frame_idx").withColumn("doc_id", _none(dict(windows.dtypes)["doc_id"]))
    said = said.unionByName(_windows_with(windows, frames, asr))
    seen = _shown_with(shown, placed(shown), ocr, corpus, results, most).withColumn("doc_id", _none(dict(windows.dtypes)["doc_id"]))
    chosen = {"asr": _choose(results, said, asr), "ocr": _choose(results, seen, ocr)}
    out, hits = results.select("query_id", "video").distinct().join(planned.select("query_id", "mode"), "query_id", "left"), None
    for s, (c, a) in {"asr": (chosen["asr"], asr), "ocr": (chosen["ocr"], ocr)}.items():
        out = out.join(c.select("query_id", "video", F.col("name").alias(f"{s}_name"), F.col("tier").alias(f"{s}_tier"), F.col("where").alias(f"{s}_where")), ["query_id", "video"], "left").withColumn(f"{s}_where", F.coalesce(f"{s}_where", F.lit("none")))
        one = c.withColumn("source", F.lit(s)).join(a.select("query_id", F.col("mode").alias("search"), "query", "terms", "multi"), "query_id")
        hits = one if hits is None else hits.unionByName(one)
    matched = (F.col("asr_where") != "none") | (F.col("ocr_where") != "none")
    return out.withColumn("mode", F.coalesce("mode", F.lit(""))).withColumn("matched", matched).withColumn("score", matched.cast("double")), hits


# ---- where in a text


def mapped(text: str, plain: bool) -> tuple[str, list[int] | None]:
    """The text in lower case (and without accents if `plain`), and for each of its characters the place in `text`; None where places agree."""
    if text.isascii():
        return text.lower(), None
    out, places = [], []
    for at, c in enumerate(text):
        if plain:
            c = {"đ": "d", "Đ": "D"}.get(c, c)
            c = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        c = c.lower()
        out.append(c)
        places += [at] * len(c)
    places.append(len(text))
    return "".join(out), places


def occurrences(text: tuple[str, list[int] | None], needle: str, most: int) -> list[tuple[int, int]]:
    """The first `most` places of a needle, from left to right without overlap, in terms of the text before it was mapped."""
    low, places = text
    out, at = [], low.find(needle) if needle else -1
    while at >= 0 and len(out) < most:
        end = at + len(needle)
        out.append((at, end) if places is None else (places[at], max(places[end], places[at] + 1)))
        at = low.find(needle, end)
    return out


def densest(text: str, spans: list[tuple[int, int]], width: int = WIDTH, slack: int = SLACK) -> tuple[int, int]:
    """The stretch of about `width` characters with most distinct strings among `spans` (sorted), then most spans, then the earliest: centred on
    its spans, its ends moved out to white space up to `slack` characters away. Without spans: the beginning. Two pointers, one pass."""
    if not spans:
        return 0, min(len(text), width)
    inside, best, last = Counter(), None, 0
    words = [text[a:b].lower() for a, b in spans]
    for first, (start, _) in enumerate(spans):
        while last <= first or last < len(spans) and spans[last][1] <= start + width:
            inside[words[last]] += 1
            last += 1
        rank = (len(inside), last - first)
        if best is None or rank > best[0]:
            best = rank, first, last
        inside[words[first]] -= 1
        if not inside[words[first]]:
            del inside[words[first]]
    _, first, last = best
    start, extent = spans[first][0], min(width, max(b for _, b in spans[first:last]) - spans[first][0])
    hi = min(len(text), max(0, start - (width - extent) // 2) + width)
    lo = max(0, hi - width)
    lo = next((p for p in range(lo, max(lo - slack, 0) - 1, -1) if p == 0 or text[p - 1].isspace()), lo)
    return lo, next((p for p in range(hi, min(hi + slack, len(text)) + 1) if p == len(text) or text[p].isspace()), hi)


def segments(text: str, spans: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[str, bool]]:
    """The stretch in parts that are hits or not: overlapping and touching spans are one, runs of white space one space, and an ellipsis
    (part of a text that is no hit) shows that something is cut off. Nothing but white space gives nothing."""
    parts, at = [], lo
    for a, b in sorted(spans):
        a, b = max(a, at), min(b, hi)
        if a < b:
            if parts and parts[-1][1] and a == at:
                parts[-1] = (parts[-1][0] + text[a:b], True)
            else:
                parts += [(text[at:a], False)] * (a > at) + [(text[a:b], True)]
            at = b
    parts += [(text[at:hi], False)] * (at < hi)
    out: list[tuple[str, bool]] = []
    for part, hit in parts:
        part = re.sub(r"\s+", " ", part)
        if out and out[-1][0].endswith(" "):
            part = part.removeprefix(" ")
        if part:
            out.append((part, hit))
    if out and not out[0][1]:
        out[0] = (out[0][0].lstrip(), False)
    if out and not out[-1][1]:
        out[-1] = (out[-1][0].rstrip(), False)
    out = [p for p in out if p[0]]
    if not any(p.strip() for p, _ in out):
        return []
    if lo > 0:
        out = [("…", False), *out] if out[0][1] else [("…" + out[0][0], False), *out[1:]]
    if hi < len(text):
        out = [*out, ("…", False)] if out[-1][1] else [*out[:-1], (out[-1][0] + "…", False)]
    return out


def spans_of(text: str, needles: list[dict], pattern: str | None, most: int = MOST_SPANS) -> list[tuple[int, int]]:
    """Spans of needles (text, words, plain), `most` of each: as a whole or, where it does not stand so, by its words; or of a pattern."""
    out: list[tuple[int, int]] = []
    if pattern is not None:
        for m in re.finditer(pattern, text, re.IGNORECASE):
            if m.end() > m.start():
                out.append(m.span())
            if len(out) >= most:
                break
    forms = {plain: mapped(text, plain) for plain in {bool(n["plain"]) for n in needles}}
    for n in needles:
        form = forms[bool(n["plain"])]
        own = occurrences(form, n["text"], most)
        if not own:
            for w in n["words"]:
                own += occurrences(form, w, most - len(own))
        out += own
    return sorted(out)


def token_spans(text: str, wanted: list[str]) -> list[tuple[int, int]]:
    """Spans of whole tokens that are wanted."""
    return [m.span() for m in re.finditer("[0-9a-zA-ZÀ-ỹ]+", text) if m.group().lower() in wanted]


def details(hits: DataFrame) -> DataFrame:
    """Adds to hits what stands where: segments (text, hit), lo, hi, n_spans, matched_terms, terms_total, at_s, start_s, end_s, time_approx.

    hits: text, search (substring, regex, bm25), source, query, terms, found (term, tier), multi, frame_idx, fps, start_s, end_s. Speech stands as a whole or not at all;
    a term on screen may stand by its words. A frame's moment is its own time; of a window it is estimated from where the stretch stands in it.
    The texts are those of chosen hits, at most one for each video and source.
    """
    flat = lambda x: F.trim(F.lower(fold(x)))
    needle = lambda t: F.struct(F.when(t["tier"] == "exact", F.trim(F.lower(F.get("terms", t["term"])))).otherwise(flat(F.get("terms", t["term"]))).alias("text"), (t["tier"] != "exact").alias("plain"))
    words = lambda n: F.struct(n["text"].alias("text"), F.when(F.col("source") == "ocr", F.array_distinct(tokens(n["text"]))).otherwise(F.array().cast("array<string>")).alias("words"), n["plain"].alias("plain"))
    needles = F.transform(F.transform(F.coalesce("found", F.array().cast("array<struct<term:int,tier:string>>")), needle), words)
    asked = F.array_distinct(tokens(F.col("query")))

    @F.pandas_udf("segments array<struct<text: string, hit: boolean>>, lo int, hi int, n_spans int, n int, tokens array<string>")
    def look(text: pd.Series, search: pd.Series, needles: pd.Series, query: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s, n, q, w in zip(text, search, needles, query, wanted, strict=True):
            t = t or ""
            spans = token_spans(t, set(w)) if s == "bm25" else spans_of(t, [] if s == "regex" else list(n), q if s == "regex" else None)
            lo, hi = densest(t, spans)
            there = {t[a:b].lower() for a, b in spans} if s == "bm25" else ()
            rows.append(([{"text": x, "hit": h} for x, h in segments(t, spans, lo, hi)], lo, hi, len(spans), len(t), [x for x in w if x in there]))
        return pd.DataFrame(rows, columns=["segments", "lo", "hi", "n_spans", "n", "tokens"])

    d = hits.withColumn("_d", look("text", "search", needles, "query", asked))
    by_window = F.col("search") == "bm25"
    at = F.when(by_window, moment((F.col("_d.lo") + F.col("_d.hi")) / 2, F.col("_d.n"), F.least("start_s", "end_s"), F.greatest("start_s", "end_s"))).otherwise(F.col("frame_idx") / F.col("fps"))
    terms = F.when(by_window, F.col("_d.tokens")).when(F.col("multi"), F.transform("found", lambda f: F.get("terms", f["term"]))).otherwise(F.array().cast("array<string>"))
    total = F.when(by_window, F.size(asked)).when(F.col("multi"), F.size("terms")).otherwise(0)
    shown = [c for c in hits.columns if c not in ("text", "start_s", "end_s")]
    return d.select(
        *shown, "_d.segments", "_d.lo", "_d.hi", "_d.n_spans", terms.alias("matched_terms"), total.alias("terms_total"), F.round(at, 3).alias("at_s"),
        F.when(by_window, F.round("start_s", 3)).alias("start_s"), F.when(by_window, F.round("end_s", 3)).alias("end_s"), by_window.alias("time_approx"),
    )


def describe(hits: DataFrame, frames: DataFrame, speech: DataFrame, windows: DataFrame, shown: DataFrame) -> DataFrame:
    """`details` of the hits of `annotate_sources`, each with the text it stands in: a frame's, or the window's."""
    by_window = F.col("search") == "bm25"
    keyed = hits.withColumn("_in", F.when(by_window, "window").otherwise(F.col("source"))).withColumn("_key", F.when(by_window, F.col("doc_id").cast("string")).otherwise(F.col("name")))
    of_frames = [t.select(F.lit(s).alias("_in"), F.col("name").alias("_key"), "text", _none("double").alias("start_s"), _none("double").alias("end_s")) for s, t in (("asr", speech), ("ocr", shown))]
    of_windows = windows.select(F.lit("window").alias("_in"), F.col("doc_id").cast("string").alias("_key"), "text", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))
    texts = of_frames[0].unionByName(of_frames[1]).unionByName(of_windows)
    return details(keyed.join(texts, ["_in", "_key"]).drop("_in", "_key").join(frames.select("name", "frame_idx", "fps"), "name"))
