"""Registered queries on text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentspark.functions import text as tx
from momentspark.operators import lexical

from .fixtures import read, spread


def texts(spark: SparkSession, d: str) -> DataFrame:
    """name, video, text: every document is a frame's text, its source the video."""
    return spread(read(spark, d, "documents")).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("video"), "text", "doc_id")


def asked(spark: SparkSession, d: str, first: int, n: int) -> DataFrame:
    """query_id, query: words `first` to `first + n - 1` of each benchmark text."""
    words = F.split("text", " ")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, first, n), " ").alias("query"))


def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = F.lower(tx.fold(F.col("text")))
    return read(spark, d, "documents").select("doc_id", F.md5(folded).alias("folded_md5"), F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def split_terms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(tx.split_terms(F.col("text")), "|").alias("terms"))


def split_query_text(spark: SparkSession, d: str) -> DataFrame:
    parts = tx.split_query_text(F.col("text"))
    return read(spark, d, "benchmark").select("item_id", F.size(parts).cast("long").alias("n_parts"), F.array_join(parts, "|").alias("parts"))


def asked_terms(spark: SparkSession, d: str) -> DataFrame:
    """query_id, terms: of each benchmark text, words 2 and 3 as one term, word 4 as another and a repeat of it without its accents."""
    words = F.split("text", " ")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.array_join(F.slice(words, 2, 2), " "), F.get(words, F.lit(3)), tx.fold(F.get(words, F.lit(5)))).alias("terms"))


def requested(spark: SparkSession, d: str) -> DataFrame:
    """query_id, video: three sources for each benchmark text."""
    three = F.explode(F.array(*[F.concat(F.lit("src"), ((F.col("item_id") + k) % 20).cast("string")) for k in (0, 7, 13)]))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), three.alias("video"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """video: sources whose number is not divisible by 4."""
    return read(spark, d, "documents").select(F.col("source").alias("video")).distinct().where("cast(regexp_extract(video, '([0-9]+)$', 1) as int) % 4 <> 0")


def ocr_phrase(spark: SparkSession, d: str) -> DataFrame:
    return lexical.phrase_search(texts(spark, d), asked(spark, d, 2, 2), 20)[0]


def ocr_counts(spark: SparkSession, d: str) -> DataFrame:
    return lexical.phrase_search(texts(spark, d), asked(spark, d, 2, 2), 20, folded=True)[1]


def ocr_multi_term(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.term_search(texts(spark, d).drop("doc_id"), asked_terms(spark, d), most=50)
    return hits.select("query_id", "name", "video", "n_terms", "worst_tier", "n_phrases", "all_phrases", "place", "pass_rank")


def text_two_tier(spark: SparkSession, d: str) -> DataFrame:
    return lexical.two_tier_search(texts(spark, d), asked(spark, d, 2, 2))


def text_batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lexical.batch_lookup(texts(spark, d), asked(spark, d, 3, 2), requested(spark, d))


def term_batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = lexical.batch_term_lookup(texts(spark, d), asked_terms(spark, d), requested(spark, d), corpus(spark, d))
    return found.withColumn("terms", F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"].cast("string"), t["tier"], t["phrase"].cast("string"))), "|"))


def regex_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth pattern is invalid."""
    q = asked(spark, d, 3, 2).select("query_id", F.when(F.col("query_id") % 10 == 9, "([a-z").otherwise(F.concat(F.regexp_replace("query", "[^a-z ]", ""), F.lit("[a-z]*"))).alias("pattern"))
    return lexical.pattern_search(texts(spark, d), q).select("query_id", "name", "n_matched")


def bm25_docs(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(spread(read(spark, d, "documents")), asked(spark, d, 4, 3))


def bm25_best_window(spark: SparkSession, d: str) -> DataFrame:
    from .timeline import windows

    scores = lexical.bm25(spread(read(spark, d, "documents")), asked(spark, d, 4, 3))
    return lexical.best_window(scores, windows(spark, d)).select("query_id", "video", "doc_id", "norm", "rank")


def annotate_results(spark: SparkSession, d: str) -> DataFrame:
    t = texts(spark, d)
    results = lexical.phrase_search(t, asked(spark, d, 2, 1), 10)[0].join(t.select("name", "video"), "name")
    hits = lexical.two_tier_search(t, asked(spark, d, 4, 1)).select("query_id", "video", "name", "tier", F.col("place").alias("rank"))
    return lexical.annotate(results, hits)


FOLD = "lower(translate(strip_accents({0}), 'đĐ', 'dD'))"
TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^0-9a-zA-ZÀ-ỹ]+'), lambda x: x <> '')"
TEXTS = f"texts AS (SELECT 'doc-' || doc_id AS name, source AS video, text, doc_id, length(text) AS n, {FOLD.format('text')} AS f FROM documents)"


def _asked(first: int, n: int) -> str:
    return f"asked AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), {first}, {first + n - 1}), ' ') AS query FROM benchmark)"


def _terms(sql: str) -> str:
    """From query_id, term, raw: the needles of both passes, their words, and how many terms a query has in each."""
    return f"""raws AS ({sql}), needles AS (SELECT query_id, term, trim(lower(raw)) AS low, trim({FOLD.format('raw')}) AS flat FROM raws WHERE raw IS NOT NULL),
terms AS (SELECT *, {TOKENS.format('low')} AS low_words, {TOKENS.format('flat')} AS flat_words,
  count(*) FILTER (low <> '') OVER (PARTITION BY query_id) AS n_low, count(*) FILTER (flat <> '') OVER (PARTITION BY query_id) AS n_flat FROM needles)"""


def _pass(name: str, text: str, needle: str) -> str:
    missing = f"len(list_filter({needle}_words, lambda w: NOT contains({text}, w)))"
    return f"""{name} AS (SELECT query_id, name, video, n, term, contains({text}, {needle}) AS phrase FROM texts, terms
  WHERE {needle} <> '' AND regexp_matches(text, '\\S') AND CASE WHEN len({needle}_words) = 0 THEN n_{needle} = 1 OR contains({text}, {needle}) ELSE {missing} = 0 END)"""


_ONE = "SELECT query_id, 0 AS term, query AS raw FROM asked"
_THREE = "SELECT query_id, unnest([0, 1, 2]) AS term, unnest([array_to_string(w[2:3], ' '), w[4], translate(strip_accents(w[6]), 'đĐ', 'dD')]) AS raw FROM (SELECT item_id AS query_id, string_split(text, ' ') AS w FROM benchmark)"
_REQUESTED = "SELECT item_id AS query_id, 'src' || ((item_id + k) % 20) AS video FROM benchmark, (SELECT unnest([0, 7, 13]) AS k)"


def _phrase(first: int, n: int, limit: int, folded: bool = False) -> str:
    return f"""{TEXTS}, {_asked(first, n)}, {_terms(_ONE)}, {_pass('found', 'f', 'flat') if folded else _pass('found', 'lower(text)', 'low')},
hits AS (SELECT query_id, name, video, phrase AS is_phrase, row_number() OVER (PARTITION BY query_id ORDER BY phrase DESC, n, name) AS rank FROM found QUALIFY rank <= {limit})"""


_CORPUS = "WHERE regexp_extract(video, '([0-9]+)$', 1)::INT % 4 <> 0"


def _two_tier(corpus: str = "", most: int | None = 5000) -> str:
    """Over `texts` and `terms`: t3 (hits) and t4 (videos). `most`: texts that a pass keeps, all if None."""
    return f"""{_pass('low_hits', 'lower(text)', 'low')}, {_pass('flat_hits', 'f', 'flat')},
t1 AS (SELECT *, 'exact' AS tier FROM low_hits UNION ALL SELECT *, 'normalized' FROM flat_hits),
t2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY phrase DESC, n, name) AS rank, count(*) OVER (PARTITION BY query_id, tier) AS n_matched FROM t1{f" QUALIFY rank <= {most}" if most else ""}),
t2b AS (SELECT * FROM t2 QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY tier) = 1),
t3 AS (SELECT query_id, name, video, n, tier, phrase AS is_phrase, rank, n_matched, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS place FROM t2b {corpus}),
t4 AS (SELECT query_id, video, row_number() OVER (PARTITION BY query_id ORDER BY min(place)) AS video_rank, count(*) OVER (PARTITION BY query_id) AS n_videos FROM t3 GROUP BY query_id, video)"""


def _multi(corpus: str = "") -> str:
    """Over `_THREE`: placed (hits of several terms) and both_passes (their terms)."""
    return f"""{TEXTS}, {_terms(_THREE)}, {_pass('low_hits', 'lower(text)', 'low')}, {_pass('flat_hits', 'f', 'flat')},
both_passes AS (SELECT query_id, name, video, n, term, CASE WHEN e.phrase IS NULL THEN 1 ELSE 2 END AS tier, coalesce(e.phrase, x.phrase) AS phrase, e.phrase IS NOT NULL AS in_low, e.phrase AS low_phrase, x.phrase IS NOT NULL AS in_flat, x.phrase AS flat_phrase
  FROM low_hits e FULL JOIN flat_hits x USING (query_id, name, video, n, term)),
frames AS (SELECT query_id, name, video, n, count(*) AS n_terms, min(tier) AS worst_tier, count(*) FILTER (phrase) AS n_phrases,
  string_agg(term || ':' || CASE tier WHEN 2 THEN 'exact' ELSE 'normalized' END || ':' || phrase, '|' ORDER BY term) AS terms,
  count(*) FILTER (in_low) AS a, count(*) FILTER (low_phrase) AS b, count(*) FILTER (in_flat) AS c, count(*) FILTER (flat_phrase) AS d FROM both_passes GROUP BY query_id, name, video, n),
passed AS (SELECT *, CASE WHEN worst_tier = 2 THEN row_number() OVER (PARTITION BY query_id ORDER BY a DESC, b DESC, n, name) ELSE row_number() OVER (PARTITION BY query_id ORDER BY c DESC, d DESC, n, name) END AS pass_rank,
  sum((a > 0)::INT) OVER (PARTITION BY query_id) AS n_exact, sum((c > 0)::INT) OVER (PARTITION BY query_id) AS n_folded FROM frames),
placed AS (SELECT query_id, name, video, n_terms, worst_tier, n_phrases, n_phrases = n_terms AS all_phrases,
  row_number() OVER (PARTITION BY query_id ORDER BY n_terms DESC, worst_tier DESC, n_phrases DESC, n, name) AS place, pass_rank, (CASE WHEN worst_tier = 2 THEN n_exact ELSE n_folded END)::BIGINT AS pass_total, terms FROM passed {corpus})"""


_BM25 = f"""{_asked(4, 3)}, d AS (SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents WHERE trim(text) <> ''),
s AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_dl FROM d),
a AS (SELECT DISTINCT query_id, unnest({TOKENS.format('query')}) AS token FROM asked),
tf AS (SELECT token, doc_id, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS token FROM d) WHERE token IN (SELECT token FROM a) GROUP BY token, doc_id),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
scores AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS score
  FROM tf JOIN df USING (token) JOIN a USING (token), s GROUP BY query_id, doc_id)"""

QUERIES = {f.__name__: f for f in (accent_fold, split_terms, split_query_text, ocr_phrase, ocr_counts, ocr_multi_term, text_two_tier, text_batch_lookup, term_batch_lookup, regex_filter, bm25_docs, bm25_best_window, annotate_results)}
ORACLE_SQL = {
    "accent_fold": f"SELECT doc_id, md5({FOLD.format('text')}) AS folded_md5, len({TOKENS.format('text')}) AS n_tokens FROM documents",
    "split_terms": f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[,;，；、]'),
          lambda x: regexp_replace(replace(x, chr(1), ','), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')), lambda x: x <> '') AS t FROM documents), k AS (SELECT *, list_transform(t, lambda x: {FOLD.format('x')}) AS keys FROM p)
        SELECT doc_id, array_to_string(list_filter(t, lambda x, i: list_position(keys, keys[i]) = i)[1:5], '|') AS terms FROM k""",
    "split_query_text": """WITH p AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(trim(text), '\\.\\s+'), lambda x: trim(regexp_replace(trim(x), '\\.+$', ''))), lambda x: x <> '') AS parts FROM benchmark)
        SELECT item_id, len(parts) AS n_parts, array_to_string(parts, '|') AS parts FROM p""",
    "ocr_phrase": f"WITH {_phrase(2, 2, 20)} SELECT query_id, name, is_phrase, rank FROM hits",
    "ocr_counts": f"""WITH {_phrase(2, 2, 20, True)} SELECT query_id, count(*) FILTER (phrase) AS n_phrase, count(*) AS n_words,
        (SELECT count(*) FROM documents WHERE regexp_matches(text, '\\S')) AS n_searched FROM found GROUP BY query_id""",
    "ocr_multi_term": f"WITH {_multi()} SELECT * EXCLUDE (pass_total, terms) FROM placed WHERE place <= 50",
    "text_two_tier": f"WITH {TEXTS}, {_asked(2, 2)}, {_terms(_ONE)}, {_two_tier()} SELECT t3.* EXCLUDE (n), video_rank, n_videos FROM t3 JOIN t4 USING (query_id, video)",
    "text_batch_lookup": f"WITH {TEXTS}, {_asked(3, 2)}, {_terms(_ONE)}, {_two_tier()} SELECT t3.* EXCLUDE (n), video_rank, n_videos FROM t3 JOIN t4 USING (query_id, video) SEMI JOIN ({_REQUESTED}) USING (query_id, video)",
    "term_batch_lookup": f"""WITH {_multi(_CORPUS)}, v AS (SELECT query_id, video, row_number() OVER (PARTITION BY query_id ORDER BY min(place)) AS video_rank, count(*) OVER (PARTITION BY query_id) AS n_videos FROM placed GROUP BY query_id, video)
        SELECT placed.*, video_rank, n_videos FROM placed JOIN v USING (query_id, video) SEMI JOIN ({_REQUESTED}) USING (query_id, video)""",
    "regex_filter": f"""WITH {TEXTS}, {_asked(3, 2)}, p AS (SELECT query_id, regexp_replace(query, '[^a-z ]', '', 'g') || '[a-z]*' AS pattern FROM asked WHERE query_id % 10 <> 9)
        SELECT query_id, name, length(regexp_extract(text, '(?i)' || pattern)) AS n_matched FROM texts, p WHERE regexp_matches(text, pattern, 'i')""",
    "bm25_docs": f"WITH {_BM25} SELECT query_id, doc_id, score FROM scores",
    "bm25_best_window": f"""WITH {_BM25}, w AS (SELECT doc_id, source AS video, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * 45.0 AS start_s FROM documents),
        b AS (SELECT * FROM scores JOIN w USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, video ORDER BY score DESC, start_s, doc_id) = 1),
        c AS (SELECT query_id, video, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 4) AS norm FROM b)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY norm DESC, video) AS rank FROM c WHERE norm > 0""",
    "annotate_results": f"""WITH {_phrase(2, 1, 10).replace('terms AS', 'terms1 AS').replace('FROM texts, terms', 'FROM texts, terms1').replace('raws', 'raws1').replace('needles', 'needles1')},
        asked2 AS (SELECT item_id AS query_id, list_extract(string_split(text, ' '), 4) AS query FROM benchmark), {_terms(_ONE.replace('asked', 'asked2'))}, {_two_tier()},
        placed AS (SELECT t.*, CASE WHEN h.name IS NULL THEN 'elsewhere' ELSE 'here' END AS place_kind FROM t3 t LEFT JOIN hits h ON h.query_id = t.query_id AND h.name = t.name),
        c AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY query_id, video ORDER BY tier, place_kind DESC, place) = 1)
        SELECT r.query_id, r.video, c.name, c.tier, coalesce(c.place_kind, 'none') AS place FROM (SELECT DISTINCT query_id, video FROM hits) r LEFT JOIN c USING (query_id, video)""",
}
