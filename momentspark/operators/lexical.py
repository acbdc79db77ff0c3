"""Text search for a table of queries: phrases and words, several terms in two tiers, patterns, BM25, annotation.

Queries come as a table, a stated set. One automaton (Aho and Corasick, 1975) of all words of up to `most_queries` queries finds in one pass over a
text which of them it holds, however many there are; a query is looked at only where its longest word stands. Texts are folded
and lowered once, before. A pattern is tried only on texts that hold the characters that every match of it must hold; those without such
characters are packed into rows of about a thousand, each of which meets every text once. BM25 reads texts twice, once for the counts of the
words asked for, once for scores, and shuffles only the counts. Places among all hits of a query come from counts: texts are dealt in stretches by
length and name, each hit gets its place in its stretch as it is found, and what lies before the stretch is added up from counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentspark.functions.text import fold, tokens
from momentspark.sources.scratch import Scratch


def packed(queries: DataFrame, columns: list[str], size: int = 1000) -> DataFrame:
    """One row (items) for each `size` queries or so."""
    n = queries.agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    block = F.pmod(F.xxhash64(*columns), F.greatest(F.col("blocks"), F.lit(1)))
    return queries.crossJoin(n).groupBy(block.alias("block")).agg(F.collect_list(F.struct(*columns)).alias("items")).select("items")


def _meet(texts: DataFrame, queries: DataFrame, columns: list[str], hit) -> DataFrame:
    found = texts.crossJoin(packed(queries, columns)).withColumn("items", F.filter("items", hit)).where(F.size("items") > 0)
    return found.select(*texts.columns, F.inline("items"))


class _Finder:
    """The terms of queries that stand in a text, as bits: term k of a query is bit k. Terms in `skip` (query, term) are left out."""

    def __init__(self, queries: list[list[tuple[int, str, list[str]]]], skip: frozenset = frozenset()):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        self.number: dict[str, int] = {}
        self.by_probe: dict[int, list] = {}  # from a term's longest word to (query, bit, its other words, phrase), None for those that are met with it
        self.anywhere: list[tuple[int, int, str]] = []
        for q, terms in enumerate(queries):
            for term, phrase, words in terms:
                if (q, term) in skip:
                    continue
                if not words and len(terms) == 1:  # nothing to ask for: every text has it
                    self.anywhere.append((q, 1 << term, phrase))
                    continue
                probe, *rest = sorted(words or [phrase], key=len, reverse=True)
                self.by_probe.setdefault(self._number(probe), []).append((q, 1 << term, frozenset(map(self._number, rest)) or None, None if phrase == probe else phrase))
        if self.number:
            self.words.make_automaton()

    def _number(self, word: str) -> int:
        if word not in self.number:
            self.number[word] = len(self.number)
            self.words.add_word(word, self.number[word])
        return self.number[word]

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """From queries to the terms that have all their words in the text, and those that stand there as a whole."""
        met = {number for _, number in self.words.iter(text)} if self.number else set()
        out: dict[int, tuple[int, int]] = {}
        for q, bit, phrase in self.anywhere:
            out[q] = (bit, bit * (phrase in text))
        for number in met & self.by_probe.keys():
            for q, bit, words, phrase in self.by_probe[number]:
                if words is None or words <= met:
                    have = out.get(q, (0, 0))
                    out[q] = (have[0] | bit, have[1] | bit if phrase is None or phrase in text else have[1])
        return out


class _Finders:
    """Exact and folded terms of queries. A text that folding leaves as it is needs one search for the terms that it leaves as they are."""

    def __init__(self, exact: list[list[tuple[int, str, list[str]]]], folded: list[list[tuple[int, str, list[str]]]]):
        alike = [(q, t[0]) for q, (x, y) in enumerate(zip(exact, folded, strict=True)) for t in x if t in y and (t[2] or len(x) == len(y))]
        self.alike: dict[int, int] = {}  # bits of the terms of a query
        for q, term in alike:
            self.alike[q] = self.alike.get(q, 0) | 1 << term
        self.exact, self.folded, self.other = _Finder(exact), _Finder(folded), _Finder(exact, frozenset(alike))

    def find(self, low: str, flat: str) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int]]]:
        folded = self.folded.find(flat)
        if low != flat:
            return self.exact.find(low), folded
        exact = self.other.find(low)
        for q in folded.keys() & self.alike.keys():
            bits, (a, b), (c, d) = self.alike[q], folded[q], exact.get(q, (0, 0))
            if a & bits | c:
                exact[q] = a & bits | c, b & bits | d
        return exact, folded


_BUILT: list = [None, None]  # of a worker: what it built last, after what it was built from


def _once(value, build):
    """build(value), kept for the next task of this worker."""
    if _BUILT[0] is not value:
        _BUILT[:] = value, build(value)
    return _BUILT[1]


def _blocks(rows: DataFrame, most: int) -> list[DataFrame]:
    """Parts of about `most` rows, all rows of a query_id in one of them."""
    n = max(1, -(-rows.count() // most))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)]


def _needles(terms: Column, norm) -> Column:
    """Of an array of terms: (term, needle, words) of those that are not blank."""
    each = F.transform(terms, lambda x, k: F.struct(k.cast("int").alias("term"), F.trim(norm(x)).alias("needle")))
    each = F.filter(each, lambda x: x["needle"] != "")
    return F.transform(each, lambda x: F.struct(x["term"].alias("term"), x["needle"].alias("needle"), F.array_distinct(tokens(x["needle"])).alias("words")))


def _flat(text: Column) -> Column:
    return F.lower(fold(text))


def scan(texts: DataFrame, queries: DataFrame, most_queries: int = 50_000, passes: tuple[str, ...] = ("exact", "folded")) -> DataFrame:
    """Where terms stand: the columns of `texts` but for `text`, n (its length), query_id, and four sets of terms as bits of a long:
    `exact` and `exact_phrase` (case apart), `folded` and `folded_phrase` (accents apart too).

    texts: name, text and more; those without a visible character are not searched. queries: query_id, terms (array, 62 at most). A term
    stands in a text if each of its words is a substring of it; the phrase bit tells that it stands there as a whole. A term without a word is
    a literal phrase, or, where the query has no other, stands everywhere. Queries come to the driver, `most_queries` at a time; there is a pass
    over the texts for each such block. `passes`: those asked for; bits of the other one are 0.
    """
    return _scan(texts.where(F.col("text").rlike(r"\S")).withColumn("n", F.length("text")), queries, most_queries, BITS, _scanner, passes)


def _scan(texts: DataFrame, queries: DataFrame, most_queries: int, found: tuple[str, ...], scanner, passes: tuple[str, ...] = ("exact", "folded")) -> DataFrame:
    """A pass over the texts for each block of queries; scanner(broadcast rows, names kept) gives these, query_id and `found`."""
    kept = [f for f in texts.schema if f.name != "text"]
    id_type = queries.schema["query_id"].dataType.simpleString()
    as_type = "bigint" if id_type in ("tinyint", "smallint", "int") else id_type  # as Arrow infers it
    norms = {"exact": F.lower, "folded": _flat}
    asked = queries.select(F.col("query_id").cast(as_type).alias("query_id"), *((_needles(F.col("terms"), f) if c in passes else F.lit(None)).alias(c) for c, f in norms.items()), F.size("terms").alias("n_terms"))
    names = [f.name for f in kept]
    source = texts.select(*names, *((f(F.col("text")) if c in passes else F.lit("")).alias(f"_{c}") for c, f in norms.items()))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"query_id {as_type}", *(f"{c} long" for c in found)])
    out = None
    for block in _blocks(asked, most_queries):
        rows = block.collect()
        if any(r["n_terms"] > 62 for r in rows):
            raise ValueError("a query has more than 62 terms")
        part = source.mapInArrow(scanner(texts.sparkSession.sparkContext.broadcast(rows), names), schema)
        out = part if out is None else out.union(part)
    return out.withColumn("query_id", F.col("query_id").cast(id_type))


BITS = ("exact", "exact_phrase", "folded", "folded_phrase")


def _scanner(shared, names: list[str]):
    def run(batches):
        rows = shared.value
        finders = _once(rows, lambda rows: _Finders(*([[tuple(t) for t in r[c] or []] for r in rows] for c in ("exact", "folded"))))
        ids = pa.array([r["query_id"] for r in rows])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                row, query, bits = [], [], []
                for r, (x, y) in enumerate(zip(b.column("_exact").to_pylist(), b.column("_folded").to_pylist(), strict=True)):
                    a, z = finders.find(x, y)
                    for q in a.keys() | z.keys():
                        row.append(r)
                        query.append(q)
                        bits.append((*a.get(q, (0, 0)), *z.get(q, (0, 0))))
                if row:
                    found = np.array(bits, dtype=np.int64)
                    where = pa.array(row, pa.int64())
                    yield pa.record_batch([*(b.column(c).take(where) for c in names), ids.take(pa.array(query, pa.int64())), *(pa.array(found[:, k]) for k in range(4))], names=[*names, "query_id", *BITS])

    return run


def phrase_search(texts: DataFrame, queries: DataFrame, limit: int, folded: bool = False, video_prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Texts that hold every word of a query (as a substring). texts: name, text. queries: query_id, query.

    Returns (hits: query_id, name, is_phrase, rank up to `limit`; counts: query_id, n_phrase, n_words, n_searched, before the limit). The whole
    phrase comes first, then shorter texts, then names. Blank queries find nothing; one without a word finds every text. With
    `video_prefix` only names that start so are searched.
    """
    t = texts.select("name", "text").where(F.col("name").startswith(video_prefix))
    words, phrase = ("folded", "folded_phrase") if folded else ("exact", "exact_phrase")
    hits = scan(t, queries.select("query_id", F.array("query").alias("terms")), passes=(words,)).where(F.col(words) > 0)
    hits = hits.select("query_id", "name", (F.col(phrase) > 0).alias("is_phrase"), "n")
    searched = t.where(F.col("text").rlike(r"\S")).agg(F.count(F.lit(1)).alias("n_searched"))
    counts = hits.groupBy("query_id").agg(F.count_if("is_phrase").alias("n_phrase"), F.count(F.lit(1)).alias("n_words")).crossJoin(searched)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("is_phrase"), "n", "name"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "name", "is_phrase", "rank"), counts


TOKEN = re.compile("[0-9a-zA-ZÀ-ỹ]+")  # of lowered texts, as `tokens` has them
#: Orders of a query's hits. By a code (the smaller comes first), then shorter texts, then names.
ORDERS = ("place", "exact", "folded")
#: Codes lie below _CODES; in a pass, those of texts with a term in that pass lie below _NOT_FOUND.
_CODES, _NOT_FOUND = 1 << 13, 62 * 64
RANKED = (*BITS, *(f"{o}_code" for o in ORDERS), *(f"{o}_nth" for o in ORDERS))


def _codes(exact: np.ndarray, exact_phrase: np.ndarray, folded: np.ndarray, folded_phrase: np.ndarray) -> list[np.ndarray]:
    """By more terms, exact before normalised, more whole phrases; and of each pass by its terms, then its whole phrases."""
    n = lambda bits: np.bitwise_count(bits).astype(np.int64)
    plain = folded & ~exact
    return [((62 - n(exact | folded)) * 2 + (plain != 0)) * 64 + 62 - n(exact_phrase | folded_phrase & plain), (62 - n(exact)) * 64 + 62 - n(exact_phrase), (62 - n(folded)) * 64 + 62 - n(folded_phrase)]


def _nth(keys: np.ndarray, met: dict[int, int]) -> np.ndarray:
    """The number of each key among its likes, from 1; `met` counts those of earlier batches."""
    each, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    nth = np.empty(len(keys), dtype=np.int64)
    nth[order] = np.arange(1, len(keys) + 1) - np.repeat(np.cumsum(times) - times, times)
    before = np.array([met.get(k, 0) for k in each.tolist()], dtype=np.int64)
    met.update(zip(each.tolist(), (before + times).tolist(), strict=True))
    return nth + before[which]


def _numberer(shared, names: list[str]):
    """`_scanner` over the texts of a stretch in order, with codes and the number of each hit among those of the stretch with its query and code."""

    def run(batches):
        ids, met = pa.array(dict.fromkeys(r["query_id"] for r in shared.value)), [{} for _ in ORDERS]
        for b in _scanner(shared, names)(batches):
            query = pc.index_in(b.column("query_id"), value_set=ids).to_numpy().astype(np.int64)
            codes = _codes(*(b.column(c).to_numpy() for c in BITS))
            takes = [b.column("in_corpus").to_numpy(zero_copy_only=False), *(np.ones(len(query), dtype=bool) for _ in ORDERS[1:])]
            nths = [np.zeros(len(query), dtype=np.int64) for _ in ORDERS]
            for nth, code, take, seen in zip(nths, codes, takes, met, strict=True):
                nth[take] = _nth(query[take] * _CODES + code[take], seen)
            yield pa.record_batch([*b.columns, *map(pa.array, codes), *map(pa.array, nths)], names=[*b.schema.names, *RANKED[len(BITS) :]])

    return run


def _cuts(texts: DataFrame, most: int, least: int) -> list[tuple[int, str]]:
    """Lengths and names that cut texts into up to `most` stretches of about even size, no less than about `least` texts. They are those of names
    with the smallest hashes, and settle only which task a text goes to."""
    n = min(most, texts.count() // least)
    if n < 2:
        return []
    some = texts.where("name is not null").select(F.length("text").alias("n"), "name").where("n is not null").orderBy(F.xxhash64("name")).limit(16 * n).collect()
    some = sorted((r["n"], r["name"]) for r in some)
    return sorted({some[k * len(some) // n] for k in range(1, n)}) if some else []


def _numbered(texts: DataFrame, queries: DataFrame, corpus: DataFrame | None = None, most_queries: int = 50_000, most_stretches: int = 256, least_texts: int = 500) -> tuple[DataFrame, DataFrame]:
    """Hits of `scan` with their places in a stretch, and where stretches begin.

    hits: the columns of `texts` but for text, n, in_corpus (its video is in `corpus`; broadcast), stretch, query_id, BITS, and for each of ORDERS its code and nth (number
    among those of the query, code and stretch; of place only hits in the corpus have one). starts: query_id, stretch, starts (a map from `_key` to before and total).
    Texts are shuffled once, by stretch. Hits are written to the shared folder once, since both tables come from them: no hit is shuffled, and no window is over more
    than the counts of a query.
    """
    t = texts.withColumn("in_corpus", F.lit(True))
    if corpus is not None:
        t = texts.join(F.broadcast(corpus.select("video").distinct().withColumn("in_corpus", F.lit(True))), "video", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))
    t = t.select(*texts.columns, "in_corpus").where(F.col("text").rlike(r"\S")).withColumn("n", F.length("text"))
    cuts = _cuts(texts, most_stretches, least_texts)
    at = F.struct("n", "name")
    marks = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(name).alias("name")) for n, name in cuts))
    t = t.withColumn("stretch", F.size(F.filter(marks, lambda c: c <= at)) if cuts else F.lit(0))
    dealt = t.repartitionById(len(cuts) + 1, F.col("stretch")).sortWithinPartitions("n", "name")
    hits = Scratch(texts.sparkSession, "hits").write(_scan(dealt, queries, most_queries, RANKED, _numberer), "numbered")
    cells = hits.groupBy("query_id", "stretch", "in_corpus", *(f"{o}_code" for o in ORDERS)).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*(F.struct(F.lit(o).alias("order"), F.col(f"{o}_code").alias("code"), (F.when(F.col("in_corpus"), F.col("n")).otherwise(F.lit(0)) if o == "place" else F.col("n")).alias("n")) for o in ORDERS))
    cells = cells.select("query_id", "stretch", F.inline(each)).groupBy("query_id", "order", "code", "stretch").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("query_id", "order")
    before = F.coalesce(F.sum("n").over(of.orderBy("code", "stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.coalesce(F.sum(F.when(F.col("code") < _NOT_FOUND, F.col("n"))).over(of), F.lit(0))
    number = F.array_position(F.array(*map(F.lit, ORDERS)), F.col("order")) - 1
    starts = cells.select("query_id", "stretch", F.struct((number * _CODES + F.col("code")).alias("key"), F.struct(before.alias("before"), total.alias("total")).alias("start")).alias("e"))
    return hits, starts.groupBy("query_id", "stretch").agg(F.map_from_entries(F.collect_list("e")).alias("starts"))


def _placed(hits: DataFrame, starts: DataFrame) -> DataFrame:
    """Hits with `starts`."""
    s = starts.select(F.col("query_id").alias("_query"), F.col("stretch").alias("_stretch"), "starts")
    return hits.join(s, F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("stretch") == F.col("_stretch"))).drop("_query", "_stretch")


def _start(order: str) -> Column:
    return F.col("starts")[F.lit(ORDERS.index(order) * _CODES) + F.col(f"{order}_code")]


def _rank(order: str) -> Column:
    return (_start(order)["before"] + F.col(f"{order}_nth")).cast("int")


def _merged(hits: DataFrame) -> DataFrame:
    """Adds n_terms, worst_tier (2: all terms exact, 1: some only without accents), n_phrases (of the pass that gave each term its tier)."""
    plain = F.col("folded").bitwiseAND(F.bitwise_not("exact"))
    whole = F.col("exact_phrase").bitwiseOR(F.col("folded_phrase").bitwiseAND(F.bitwise_not("exact")))
    hits = hits.withColumn("n_terms", F.bit_count(F.col("exact").bitwiseOR(F.col("folded")))).withColumn("n_phrases", F.bit_count(whole))
    return hits.withColumn("worst_tier", F.when(plain == 0, 2).otherwise(1))


def _term_hits() -> Column:
    """(term, tier, phrase) of each term found, by its number."""
    either = F.col("exact").bitwiseOR(F.col("folded"))
    has = lambda c, k: F.getbit(F.col(c), k) == 1
    numbers = F.filter(F.sequence(F.lit(0), F.length(F.bin(either)) - 1), lambda k: F.getbit(either, k) == 1)
    return F.transform(numbers, lambda k: F.struct(k.alias("term"), F.when(has("exact", k), "exact").otherwise("normalized").alias("tier"), F.when(has("exact", k), has("exact_phrase", k)).otherwise(has("folded_phrase", k)).alias("phrase")))


def term_search(texts: DataFrame, queries: DataFrame, corpus: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Texts with at least one of a query's terms: the columns of `texts` but for text, and query_id, n_terms, worst_tier, n_phrases, all_phrases, place, pass_rank,
    pass_total (texts of that pass), terms (term, tier, phrase of each one found). With `corpus` (video) only texts of its videos have a place.

    texts: name, text and more. queries: query_id, terms (array). Each term goes by the rule of `scan`, exact before folded. Order (place): more
    terms, exact before normalised, more whole phrases, shorter text, name. pass_rank is the place among all texts of the pass of the
    worst tier (exact or folded), by the terms found in that pass. `most`: places asked for, all if None; ranks are those among all hits.
    """
    hits, starts = _numbered(texts, queries, corpus)
    return _term_places(hits if most is None else hits.where(F.col("place_nth") <= most), starts, texts.columns).where("true" if most is None else F.col("place") <= most)


def _term_places(hits: DataFrame, starts: DataFrame, columns: list[str]) -> DataFrame:
    by_pass = lambda f: F.when(F.col("worst_tier") == 2, f("exact")).otherwise(f("folded"))
    ranked = _merged(_placed(hits.where("in_corpus"), starts)).withColumn("place", _rank("place")).withColumn("pass_rank", by_pass(_rank)).withColumn("pass_total", by_pass(lambda o: _start(o)["total"]))
    return ranked.select(*(c for c in columns if c != "text"), "query_id", "n_terms", "worst_tier", "n_phrases", (F.col("n_phrases") == F.col("n_terms")).alias("all_phrases"), "place", "pass_rank", "pass_total", _term_hits().alias("terms"))


def with_video_ranks(hits: DataFrame, order: str) -> DataFrame:
    """Adds video_rank, n_videos: the videos of a query numbered by their first hit in `order`, and how many there are."""
    first = hits.withColumn("_first", F.min(order).over(Window.partitionBy("query_id", "video")))
    numbered = first.withColumn("video_rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))).drop("_first")
    return numbered.withColumn("n_videos", F.max("video_rank").over(Window.partitionBy("query_id")).cast("long"))


def two_tier_search(texts: DataFrame, queries: DataFrame, most: int = 5000, corpus: DataFrame | None = None) -> DataFrame:
    """One term a query, an exact pass and then a folded one, each text once: query_id, name, video, tier, is_phrase, rank, n_matched, place, video_rank, n_videos.

    texts: name, video, text. Each pass is a phrase search and keeps `most` texts; rank is the place in it and n_matched its size before that. A
    text of both passes is exact. place runs over both, exact first. video_rank numbers videos by their first text. With `corpus` (video) only
    texts of its videos have a place and a video rank; ranks in a pass and its size stay those of all texts.
    """
    hits, starts = _numbered(texts.select("name", "video", "text"), queries.select("query_id", F.array("query").alias("terms")), corpus)
    return _two_tiers(hits, starts, most)


def _two_tiers(hits: DataFrame, starts: DataFrame, most: int = 5000) -> DataFrame:
    near = F.exists(F.map_entries("starts"), lambda e: (F.pmod(e["key"], F.lit(_CODES)) < _NOT_FOUND) & (e["key"] >= _CODES) & (e["value"]["before"] < most))
    tier = lambda name, o: F.when(F.col(o) > 0, F.struct(F.lit(name).alias("tier"), (F.col(f"{o}_phrase") > 0).alias("is_phrase"), _rank(o).alias("rank"), _start(o)["total"].alias("n_matched")))
    passes = F.array_compact(F.array(tier("exact", "exact"), tier("normalized", "folded")))
    each = _placed(hits, starts.where(near)).select("query_id", "name", "video", "in_corpus", F.inline(F.filter(passes, lambda x: x["rank"] <= most)))
    # of a text that both passes kept, the exact hit; one that the exact pass cut off may still be a normalised one
    once = each.withColumn("first", F.row_number().over(Window.partitionBy("query_id", "name").orderBy("tier"))).where("first = 1")
    once = once.where("in_corpus").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank")))
    return with_video_ranks(once, "place").select("query_id", "name", "video", "tier", "is_phrase", "rank", "n_matched", "place", "video_rank", "n_videos")


def batch_lookup(texts: DataFrame, queries: DataFrame, requested: DataFrame, most: int = 5000, corpus: DataFrame | None = None) -> DataFrame:
    """`two_tier_search` for requested (query_id, video) only; ranks are over all videos (of the corpus)."""
    return two_tier_search(texts, queries, most, corpus).join(requested.select("query_id", "video").distinct(), ["query_id", "video"], "left_semi")


def batch_term_lookup(texts: DataFrame, queries: DataFrame, requested: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """`term_search` with video_rank and n_videos, for requested (query_id, video) only (all if None); ranks are over all videos (of the corpus). texts: name, video, text."""
    return _batch_terms(*_numbered(texts.select("name", "video", "text"), queries, corpus), requested)


def _batch_terms(hits: DataFrame, starts: DataFrame, requested: DataFrame | None) -> DataFrame:
    wanted = lambda rows: rows if requested is None else rows.join(requested.select("query_id", "video").distinct(), ["query_id", "video"], "left_semi")
    first = hits.where("in_corpus").groupBy("query_id", "video").agg(F.min(F.struct("place_code", "stretch", "place_nth")).alias("_first"))
    w = Window.partitionBy("query_id")
    videos = first.withColumn("video_rank", F.row_number().over(w.orderBy("_first"))).withColumn("n_videos", F.count(F.lit(1)).over(w)).drop("_first")
    return _term_places(wanted(hits), starts, ["name", "video", "text"]).join(wanted(videos), ["query_id", "video"])


def shown_terms(texts: DataFrame, queries: DataFrame, requested: DataFrame | None = None, corpus: DataFrame | None = None, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """`two_tier_search` for queries of one term and `batch_term_lookup` for those of several, by one pass over the texts. queries: query_id, terms."""
    hits, starts = _numbered(texts.select("name", "video", "text"), queries, corpus)
    several = queries.where(F.size("terms") > 1).select("query_id")
    of = lambda how: (t.join(several, "query_id", how) for t in (hits, starts))
    return _two_tiers(*of("left_anti"), most), _batch_terms(*of("left_semi"), requested)


def _compiles(spark, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # PatternSyntaxException, by way of py4j
        return False


def invalid_patterns(patterns: DataFrame, most_patterns: int = 50_000) -> DataFrame:
    """query_id, pattern of those that are no regular expression of Java's. The stated patterns come to the driver to be compiled, `most_patterns` at a time."""
    spark, p = patterns.sparkSession, patterns.where(F.trim("pattern") != "").select("query_id", "pattern")
    bad = [(r["query_id"], r["pattern"]) for block in _blocks(p, most_patterns) for r in block.collect() if not _compiles(spark, r["pattern"])]
    return spark.createDataFrame(bad, p.schema)


def required(pattern: str) -> str:
    """The longest run of ASCII letters, digits and spaces, lowered, that each match of a regular expression holds; '' if none is sure.

    Groups and character classes count for nothing, nor does a character that may be left out; a pattern with alternatives, flags, quoting or
    escapes other than of classes and signs has none.
    """
    if "|" in pattern or "(?" in pattern:
        return ""
    runs, run, depth, at = [], "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c.isascii() and (c.isalnum() or c == " ") and not depth:
            run += c.lower()
            continue
        if c in "?*{":
            run = run[:-1]
        runs.append(run)
        run = ""
        if c == "\\":
            if pattern[at : at + 1].isalnum() and pattern[at] not in "dDwWsSbB":
                return ""
            at += 1
        elif c == "{":
            at = pattern.find("}", at) + 1 or len(pattern)
        elif c == "[":
            if "[" in pattern[at:].split("]")[0] or pattern[at : at + 1] in ("]", "^") or "\\" in pattern[at:].split("]")[0]:
                return max(runs, key=len) if not depth else ""  # where such a class ends is left open
            at = pattern.find("]", at) + 1 or len(pattern)
        else:
            depth += (c == "(") - (c == ")")
    return max([*runs, run], key=len)


#: Signs that are no ASCII letters but match some where case does not count.
ALIKE = str.maketrans("İıſK", "iisk")


def _suspects(shared):
    """name, text, items (query_id, pattern): texts with the patterns whose required characters they hold."""

    def build(rows):
        import ahocorasick

        words, numbers = ahocorasick.Automaton(), {}
        for k, (_, _, word) in enumerate(rows):
            numbers.setdefault(word, []).append(k)
        for word, at in numbers.items():
            words.add_word(word, at)
        words.make_automaton()
        return words, pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])

    def run(batches):
        words, ids, patterns = _once(shared.value, build)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                rows, met, ends = [], [], [0]
                for r, text in enumerate(b.column("text").to_pylist()):
                    found = {id(numbers): numbers for _, numbers in words.iter(text.translate(ALIKE).lower())}
                    if found:
                        rows.append(r)
                        met += [k for numbers in found.values() for k in numbers]
                        ends.append(len(met))
                if rows:
                    where, which = pa.array(rows, pa.int64()), pa.array(met, pa.int64())
                    items = pa.StructArray.from_arrays([ids.take(which), patterns.take(which)], ["query_id", "pattern"])
                    yield pa.record_batch([b.column("name").take(where), b.column("text").take(where), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["name", "text", "items"])

    return run


def pattern_search(texts: DataFrame, patterns: DataFrame, most_patterns: int = 50_000) -> DataFrame:
    """Texts that a regular expression (Java's, without case) matches: query_id, name, n_matched (characters of the first match).

    patterns: query_id, pattern; null, blank and invalid ones (`invalid_patterns`) find nothing, and the others are searched all the same. They
    come to the driver, `most_patterns` at a time. One automaton of what patterns require (`required`) picks the texts to try each on; a pattern that
    requires nothing is tried on every text.
    """
    spark, p = texts.sparkSession, patterns.where(F.trim("pattern") != "").select("query_id", "pattern")
    kind = p.schema["query_id"].dataType.simpleString()
    as_type = "bigint" if kind in ("tinyint", "smallint", "int") else kind  # as Arrow infers it
    t = texts.select("name", "text").where("text is not null")
    matched = lambda i: F.regexp_like(F.col("text"), i["pattern"])
    out = t.limit(0).select(F.lit(None).cast(as_type).alias("query_id"), "name", "text", F.lit(None).cast("string").alias("pattern"))
    for block in _blocks(p, most_patterns):
        rows = [(r["query_id"], f"(?iu){r['pattern']}", required(r["pattern"])) for r in block.collect() if _compiles(spark, r["pattern"])]
        sure, open_ = [r for r in rows if r[2]], [r[:2] for r in rows if not r[2]]
        if sure:
            name = t.schema["name"].dataType.simpleString()
            some = t.mapInArrow(_suspects(spark.sparkContext.broadcast(sure)), f"name {name}, text string, items array<struct<query_id: {as_type}, pattern: string>>")
            hits = some.withColumn("items", F.filter("items", matched)).select("name", "text", F.inline("items"))
            out = out.unionByName(hits)
        if open_:
            out = out.unionByName(_meet(t, spark.createDataFrame(open_, p.schema), ["query_id", "pattern"], matched).withColumn("query_id", F.col("query_id").cast(as_type)))
    return out.select(F.col("query_id").cast(kind).alias("query_id"), "name", F.coalesce(F.length(F.regexp_substr("text", "pattern")), F.lit(0)).alias("n_matched"))


def _entries(texts: pa.Array, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of a word, how often it stands there) for those words of lowered texts that have a number, and how many words each text has."""
    row, word, length = [], [], []
    for r, text in enumerate(texts.to_pylist()):
        found = TOKEN.findall(text)
        length.append(len(found))
        known = [number[w] for w in found if w in number]
        word += known
        row += [r] * len(known)
    key, times = np.unique(np.array(row, dtype=np.int64) * len(number) + np.array(word, dtype=np.int64), return_counts=True)
    return key // len(number), key % len(number), times, np.array(length, dtype=np.int64)


def _numbers(words: list[str]) -> dict[str, int]:
    return {w: k for k, w in enumerate(words)}


def _counter(shared):
    """Of a task: (-2, texts), (-1, tokens), and of each word asked for (its number, texts that have it)."""

    def run(batches):
        number = _once(shared.value, _numbers)
        texts, tokens_, df = 0, 0, np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                _, word, _, length = _entries(batch.column("text").slice(at, 500), number)
                texts += len(length)
                tokens_ += int(length.sum())
                df += np.bincount(word, minlength=len(number))
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[texts, tokens_], df[some]]))], names=["word", "n"])

    return run


def _scorer(shared, k1: float, b: float):
    def run(batches):
        words, idf, start, asking, ids, mean = shared.value
        number = _once(words, _numbers)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                row, word, times, length = _entries(batch.column("text"), number)
                part = idf[word] * times * (k1 + 1) / (times + k1 * (1 - b + b * length[row] / mean))
                many = start[word + 1] - start[word]  # queries that ask for the word
                which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[word], many)
                pair, place = np.unique(np.repeat(row, many) * len(ids) + asking[which], return_inverse=True)
                if len(pair):
                    score = np.bincount(place, weights=np.repeat(part, many))
                    yield pa.record_batch([ids.take(pa.array(pair % len(ids))), batch.column("doc_id").take(pa.array(pair // len(ids))), pa.array(score)], names=["query_id", "doc_id", "score"])

    return run


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, most_words: int = 500_000) -> DataFrame:
    """query_id, doc_id, score (six places) of documents with any token of a query. docs: doc_id, text; blank ones count for nothing.

    The words of queries come to the driver, `most_words` at a time, and for each such block two passes go over the texts: counts of the words,
    summed in each task, and scores, each made where its text is. Rows with one doc_id are documents of their own.
    """
    spark = docs.sparkSession
    d = docs.where(F.trim("text") != "").select("doc_id", F.lower("text").alias("text"))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": d.schema["doc_id"].dataType.simpleString()}
    as_type = "bigint" if kinds["query_id"] in ("tinyint", "smallint", "int") else kinds["query_id"]  # as Arrow infers it
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    out = d.limit(0).select(F.lit(None).cast(as_type).alias("query_id"), "doc_id", F.lit(None).cast("double").alias("score"))
    for block in _blocks(asked, most_words):
        rows = block.collect()
        words, number = np.unique(np.array([r["token"] for r in rows], dtype=object), return_inverse=True)
        if not len(words):
            continue
        ids = list(dict.fromkeys(r["query_id"] for r in rows))
        place = {q: k for k, q in enumerate(ids)}
        order = np.argsort(number, kind="stable")
        asking = np.array([place[r["query_id"]] for r in rows], dtype=np.int64)[order]
        start = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(words)))])
        words = words.tolist()
        counts = d.select("text").mapInArrow(_counter(spark.sparkContext.broadcast(words)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        n = {r["word"]: r["n"] for r in counts.collect()}
        df = np.array([n.get(k, 0) for k in range(len(words))])
        idf = np.log(1 + (n.get(-2, 0) - df + 0.5) / (df + 0.5))
        shared = spark.sparkContext.broadcast((words, idf, start, asking, pa.array(ids), n.get(-1, 0) / max(1, n.get(-2, 0))))
        out = out.union(d.mapInArrow(_scorer(shared, k1, b), f"query_id {as_type}, doc_id {kinds['doc_id']}, score double"))
    return out.select(F.col("query_id").cast(kinds["query_id"]).alias("query_id"), "doc_id", F.round("score", 6).alias("score"))


def best_window(scores: DataFrame, windows: DataFrame) -> DataFrame:
    """The best window of each (query, video): greatest score, earliest start, least doc_id; with norm (score over the query's best,
    four places, 0 drops) and rank. windows: doc_id, video, start_s."""
    w = Window.partitionBy("query_id", "video").orderBy(F.desc("score"), "start_s", "doc_id")
    best = scores.join(windows, "doc_id").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    best = best.withColumn("norm", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 4)).where("norm > 0")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("norm"), "video")))


def annotate(results: DataFrame, hits: DataFrame) -> DataFrame:
    """Marks each (query, video) of `results` by what `hits` found there: name, tier, place ('here' if the frame is a result itself,
    'elsewhere', 'none'). results: query_id, video, name. hits: query_id, video, name, tier, rank. Nothing is removed.

    Of several hits: exact before normalised, here before elsewhere, then rank.
    """
    shown = results.select("query_id", "name").distinct().withColumn("place", F.lit("here"))
    placed = hits.join(shown, ["query_id", "name"], "left").withColumn("place", F.coalesce("place", F.lit("elsewhere")))
    w = Window.partitionBy("query_id", "video").orderBy(F.when(F.col("tier") == "exact", 0).otherwise(1), F.desc("place"), "rank")
    chosen = placed.withColumn("k", F.row_number().over(w)).where("k = 1").select("query_id", "video", "name", "tier", "place")
    out = results.select("query_id", "video").distinct().join(chosen, ["query_id", "video"], "left")
    return out.withColumn("place", F.coalesce("place", F.lit("none")))
