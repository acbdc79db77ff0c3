"""Registered queries on the annotation of results by two text sources: on-screen text is the first half of a document, speech the second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentspark.operators import annotation, lexical

from .fixtures import read
from .text import FOLD, TOKENS, _BM25, _ONE, _multi, _phrase, _terms, _two_tier, asked, texts

NOT_WORD = "[^0-9a-zA-ZÀ-ỹ]"
MOST_SHOWN = 5000  # texts that each pass over on-screen text keeps in `match_details`; `annotate_sources` keeps all


def _halves(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """frames, speech, windows, shown: the documents of a source follow each other every 50 frames; a quarter of the sources has no frames."""
    k = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    t = read(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("video"), "doc_id", "text", k.alias("k"), number.alias("number"))
    half = F.floor(F.length("text") / 2).cast("int")
    second = F.substr("text", half + 1, F.length("text"))
    return {
        "frames": t.where("number % 4 <> 0").select("video", "name", (F.col("k") * 50).alias("frame_idx"), F.when(F.col("number") % 2 == 0, 25.0).otherwise(30.0).alias("fps")),
        "speech": t.select("name", "video", second.alias("text")),
        "windows": t.select("doc_id", "video", (F.col("k") * 1.7).alias("start_s"), (F.col("k") * 1.7 + 60).alias("end_s"), second.alias("text")),
        "shown": t.select("name", "video", F.substr("text", F.lit(1), half).alias("text")),
    }


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Six kinds of requests by item_id % 6, of words of the benchmark texts."""
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 6).alias("k"), (F.floor(F.col("item_id") / 6) % 3).alias("j"), F.transform(F.split("text", " "), lambda w: F.regexp_replace(w, NOT_WORD, "")).alias("w"))
    w = lambda i: F.get("w", F.lit(i - 1))
    k, none = F.col("k"), F.lit(None).cast("string")
    three = F.when(F.col("j") == 0, "substring").when(F.col("j") == 1, "regex").otherwise("bm25")
    return b.select(
        "query_id",
        F.when(k == 0, F.concat_ws(", ", w(4), w(5))).when(k == 1, F.concat(w(4), F.lit("[a-z]*"))).when(k == 2, F.concat_ws(" ", w(4), w(5), w(6))).when(k == 3, w(3)).otherwise(none).alias("asr_filter"),
        F.when(k == 1, "regex").when(k == 2, "bm25").when(k < 4, "substring").alias("asr_mode"),
        F.when(k == 0, w(6)).when(k == 1, F.concat(w(2), F.lit(" "), w(3), F.lit("; "), w(5))).when(k == 2, w(3)).when(k == 4, w(5)).otherwise(none).alias("ocr_filter"),
        F.when(k == 2, "regex").when(k < 5, "substring").alias("ocr_mode"), F.when(k == 5, w(4)).alias("text_filter"), F.when(k == 5, three).alias("text_mode"),
    )


def _annotated(spark: SparkSession, d: str, most: int | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    t, h = texts(spark, d), _halves(spark, d)
    results = lexical.phrase_search(t, asked(spark, d, 2, 1), 10)[0].join(t.select("name", "video"), "name")
    return *annotation.annotate_sources(results, _requests(spark, d), **h, most=most), h


def annotate_sources(spark: SparkSession, d: str) -> DataFrame:
    return _annotated(spark, d)[0]


def match_details(spark: SparkSession, d: str) -> DataFrame:
    _, hits, h = _annotated(spark, d, MOST_SHOWN)
    out = annotation.describe(hits, **h)
    plain = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select(
        "source", "query_id", "video", "name", "lo", "hi", "n_spans", plain.alias("snippet"), F.size(F.filter("segments", lambda s: s["hit"])).alias("n_marked"), F.array_join("matched_terms", "|").alias("matched_terms"),
        "terms_total", "at_s", "start_s", "end_s", "time_approx", "video_rank", "n_videos", F.col("exact_phrase").cast("int").alias("exact_phrase"),
    )


def _sources() -> str:
    """query_id, source, mode, terms, query of sources in use; mode labels in `labels`."""
    own = lambda source, cases: "\n".join(f"UNION ALL SELECT query_id, '{source}', {mode}, {terms}, {query} FROM req WHERE {when}" for when, mode, terms, query in cases)
    sub, rx, bm = "'substring'", "'regex'", "'bm25'"
    legacy = "CASE j WHEN 0 THEN 'substring' WHEN 1 THEN 'regex' ELSE 'bm25' END"
    asr = [("k = 0", sub, "[w[4], w[5]]", "w[4] || ', ' || w[5]"), ("k = 1", rx, "[w[4] || '[a-z]*']", "w[4] || '[a-z]*'"), ("k = 2", bm, "['x']", "w[4] || ' ' || w[5] || ' ' || w[6]"), ("k = 3", sub, "[w[3]]", "w[3]"), ("k = 5", legacy, "[w[4]]", "w[4]")]
    ocr = [("k = 0", sub, "[w[6]]", "w[6]"), ("k = 1", sub, "[w[2] || ' ' || w[3], w[5]]", "w[2] || ' ' || w[3] || '; ' || w[5]"), ("k = 2", rx, "[w[3]]", "w[3]"), ("k = 4", sub, "[w[5]]", "w[5]"), ("k = 5 AND j < 2", legacy, "[w[4]]", "w[4]")]
    dedupe = f"list_filter(terms, lambda t, i: trim(t) <> '' AND list_position(list_transform(terms, lambda u: {FOLD.format('trim(u)')}), {FOLD.format('trim(t)')}) = i)"
    return f"""req AS (SELECT item_id AS query_id, item_id % 6 AS k, item_id // 6 % 3 AS j, list_transform(string_split(text, ' '), lambda w: regexp_replace(w, '{NOT_WORD}', '', 'g')) AS w FROM benchmark),
uses AS (SELECT query_id, source, mode, list_transform(terms, lambda t: trim(t)) AS terms, trim(query) AS query, len(terms) > 1 AS multi FROM (SELECT query_id, source, mode, CASE WHEN mode = 'substring' AND len(terms) > 1 THEN {dedupe} ELSE terms END AS terms, query
  FROM (SELECT NULL::BIGINT AS query_id, NULL::VARCHAR AS source, NULL::VARCHAR AS mode, NULL::VARCHAR[] AS terms, NULL::VARCHAR AS query {own('asr', asr)} {own('ocr', ocr)})) WHERE trim(query) <> '' AND len(terms) > 0),
labels AS (SELECT query_id, CASE WHEN k = 5 THEN {legacy} WHEN k < 3 THEN 'mixed' ELSE 'substring' END AS mode FROM req WHERE CASE WHEN k = 5 THEN w[4] <> '' ELSE true END)"""


def _sql(most: int | None) -> str:
    whole = lambda text, raw: f"CASE WHEN contains(lower({text}), trim(lower({raw}))) THEN 2 WHEN contains({FOLD.format(text)}, trim({FOLD.format(raw)})) THEN 1 END"
    shown = "texts AS (SELECT name, video, one AS text, doc_id, length(one) AS n, " + FOLD.format("one") + " AS f FROM halves)"
    corpus = "WHERE regexp_extract(video, '([0-9]+)$', 1)::INT % 4 <> 0"
    bm25 = _BM25.split(", d AS (", 1)[1].replace("FROM documents", "FROM (SELECT doc_id, two AS text FROM halves)")
    several = _multi(corpus).split(", raws AS", 1)[1].split("), needles AS", 1)[1]
    found = "list(struct_pack(term := term, tier := tier) ORDER BY term)"
    return f"""{_sources()},
halves AS (SELECT 'doc-' || doc_id AS name, source AS video, doc_id, text[1:length(text) // 2] AS one, text[length(text) // 2 + 1:] AS two, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, regexp_extract(source, '([0-9]+)$', 1)::INT AS number FROM documents),
frames AS (SELECT video, name, k * 50 AS frame_idx, CASE WHEN number % 2 = 0 THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END AS fps FROM halves WHERE number % 4 <> 0),
results AS (WITH {_phrase(2, 1, 10)} SELECT query_id, name, video FROM hits),
pairs AS (SELECT DISTINCT query_id, video FROM results),
spoken AS (SELECT h.name, h.video, h.two AS text, f.frame_idx FROM halves h JOIN frames f USING (name) WHERE h.video IN (SELECT video FROM results)),
asr_terms AS (SELECT query_id, multi, unnest(terms) AS raw, generate_subscripts(terms, 1) - 1 AS term FROM uses WHERE source = 'asr' AND mode = 'substring'),
asr_sub AS (SELECT query_id, video, name, min(tier) AS tier, {found} AS found, any_value(frame_idx) AS place FROM (SELECT t.query_id, t.term, s.*, {whole('s.text', 't.raw')} AS tier FROM spoken s, asr_terms t WHERE regexp_matches(s.text, '\\S')) WHERE tier IS NOT NULL GROUP BY query_id, video, name),
asr_rx AS (SELECT u.query_id, s.video, s.name, s.frame_idx AS place FROM spoken s, uses u WHERE u.source = 'asr' AND u.mode = 'regex' AND regexp_matches(s.text, u.query, 'i')),
asr_bm AS (WITH asked AS (SELECT query_id, query FROM uses WHERE source = 'asr' AND mode = 'bm25'), d AS ({bm25},
  b AS (SELECT s.*, h.video, h.k * 1.7::DOUBLE AS start_s FROM scores s JOIN halves h USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, h.video ORDER BY score DESC, h.k, doc_id) = 1),
  c AS (SELECT *, round(score / max(score) OVER (PARTITION BY query_id), 4) AS norm FROM b),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY norm DESC, video) AS place FROM c WHERE norm > 0),
  n AS (SELECT r.query_id, r.video, r.doc_id, r.place, f.name FROM r JOIN frames f USING (video) QUALIFY row_number() OVER (PARTITION BY r.query_id, r.video ORDER BY abs(f.frame_idx - r.start_s * f.fps), f.frame_idx) = 1)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS video_rank, count(*) OVER (PARTITION BY query_id) AS n_videos FROM n),
ocr_one AS (WITH {shown}, asked AS (SELECT query_id, terms[1] AS query FROM uses WHERE source = 'ocr' AND mode = 'substring' AND NOT multi), {_terms(_ONE)}, {_two_tier(corpus, most)} SELECT t3.*, video_rank, n_videos FROM t3 JOIN t4 USING (query_id, video)),
ocr_many AS (WITH {shown}, raws AS (SELECT query_id, unnest(range(0, len(terms))) AS term, unnest(terms) AS raw FROM uses WHERE source = 'ocr' AND mode = 'substring' AND multi), needles AS{several},
  v AS (SELECT query_id, video, row_number() OVER (PARTITION BY query_id ORDER BY min(place)) AS video_rank, count(*) OVER (PARTITION BY query_id) AS n_videos FROM placed GROUP BY query_id, video),
  w AS (SELECT query_id, name, {found} AS found FROM both_passes GROUP BY query_id, name)
  SELECT placed.*, w.found, video_rank, n_videos FROM placed JOIN v USING (query_id, video) JOIN w USING (query_id, name)),
ocr_rx AS (SELECT u.query_id, h.video, h.name, f.frame_idx AS place FROM halves h JOIN frames f USING (name), uses u WHERE u.source = 'ocr' AND u.mode = 'regex' AND regexp_matches(h.one, u.query, 'i')),
all_hits AS (
  SELECT 'asr' AS source, query_id, video, name, tier, found, place, NULL::BIGINT AS video_rank, NULL::BIGINT AS n_videos, NULL::BOOLEAN AS exact_phrase, NULL::BIGINT AS doc_id FROM asr_sub
  UNION ALL SELECT 'asr', query_id, video, name, 2, NULL, place, NULL, NULL, NULL, NULL FROM asr_rx UNION ALL SELECT 'asr', query_id, video, name, 2, NULL, place, video_rank, n_videos, NULL, doc_id FROM asr_bm
  UNION ALL SELECT 'ocr', query_id, video, name, CASE tier WHEN 'exact' THEN 2 ELSE 1 END, [struct_pack(term := 0, tier := CASE tier WHEN 'exact' THEN 2 ELSE 1 END)], place, video_rank, n_videos, is_phrase, NULL FROM ocr_one
  UNION ALL SELECT 'ocr', query_id, video, name, worst_tier, found, place, video_rank, n_videos, all_phrases, NULL FROM ocr_many
  UNION ALL SELECT 'ocr', query_id, video, name, 2, NULL, place, NULL, NULL, NULL, NULL FROM ocr_rx),
chosen AS (SELECT h.*, u.mode AS search, u.query, u.terms, u.multi, CASE WHEN r.name IS NULL THEN 'elsewhere' ELSE 'here' END AS spot FROM all_hits h SEMI JOIN pairs USING (query_id, video) JOIN uses u USING (query_id, source)
  LEFT JOIN (SELECT DISTINCT query_id, video, name FROM results) r USING (query_id, video, name)
  QUALIFY row_number() OVER (PARTITION BY h.source, query_id, video ORDER BY CASE WHEN u.multi THEN len(found) ELSE 0 END DESC, tier DESC, spot = 'elsewhere', place, name) = 1)"""


_TIER = "CASE {0}.tier WHEN 2 THEN 'exact' WHEN 1 THEN 'normalized' END"
_ANNOTATIONS = f"""WITH {_sql(None)} SELECT p.query_id, p.video, a.name IS NOT NULL OR o.name IS NOT NULL AS matched, CASE WHEN a.name IS NOT NULL OR o.name IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, coalesce(l.mode, '') AS mode,
  a.name AS asr_name, {_TIER.format('a')} AS asr_tier, coalesce(a.spot, 'none') AS asr_where, o.name AS ocr_name, {_TIER.format('o')} AS ocr_tier, coalesce(o.spot, 'none') AS ocr_where
  FROM pairs p LEFT JOIN labels l USING (query_id) LEFT JOIN (SELECT * FROM chosen WHERE source = 'asr') a ON a.query_id = p.query_id AND a.video = p.video LEFT JOIN (SELECT * FROM chosen WHERE source = 'ocr') o ON o.query_id = p.query_id AND o.video = p.video"""


def _details_sql() -> str:
    w, slack, most = annotation.WIDTH, annotation.SLACK, annotation.MOST_SPANS
    ends = "list_transform(range(1, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))))"
    return f"""WITH {_sql(MOST_SHOWN)},
hit AS (SELECT row_number() OVER (ORDER BY c.source, c.query_id, c.video) AS id, c.*, CASE WHEN c.source = 'ocr' THEN n.one WHEN c.search = 'bm25' THEN d.two ELSE n.two END AS text, f.frame_idx, f.fps, d.k * 1.7::DOUBLE AS start_s
  FROM chosen c JOIN halves n ON n.name = c.name JOIN frames f ON f.name = c.name LEFT JOIN halves d ON d.doc_id = c.doc_id),
asked_for AS (SELECT id, source, text, unnest(found) AS e, terms FROM hit WHERE search = 'substring'),
needle AS (SELECT id, source, e.term AS term, CASE e.tier WHEN 2 THEN lower(text) ELSE {FOLD.format('text')} END AS hay, CASE e.tier WHEN 2 THEN trim(lower(terms[e.term + 1])) ELSE trim({FOLD.format('terms[e.term + 1]')}) END AS needle FROM asked_for),
words AS (SELECT id, term, hay, unnest(ws) AS word, generate_subscripts(ws, 1) AS nth FROM (SELECT id, term, hay, CASE WHEN contains(hay, needle) THEN [needle] WHEN source = 'ocr' THEN list_filter(list_distinct({TOKENS.format('needle')}), lambda x: contains(hay, x)) ELSE [] END AS ws FROM needle)),
placed_words AS (SELECT id, term, nth, word, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(word))) AS s FROM (SELECT *, string_split(hay, word) AS p FROM words)),
span_sub AS (SELECT id, s, s + length(word) AS e FROM placed_words QUALIFY row_number() OVER (PARTITION BY id, term ORDER BY nth, s) <= {most}),
pieces_rx AS (SELECT id, query, regexp_extract_all(text, '(?is).*?(?:' || query || ')') AS p FROM hit WHERE search = 'regex'),
span_rx AS (SELECT id, e - len(regexp_extract(x, '(?is)^.*?(' || query || ')$', 1)) AS s, e FROM (SELECT id, query, unnest(p) AS x, unnest({ends}) AS e FROM pieces_rx) QUALIFY row_number() OVER (PARTITION BY id ORDER BY e) <= {most}),
pieces_bm AS (SELECT id, {TOKENS.format('query')} AS wanted, regexp_extract_all(text, '[^0-9a-zA-ZÀ-ỹ]*[0-9a-zA-ZÀ-ỹ]+') AS p FROM hit WHERE search = 'bm25'),
token_bm AS (SELECT id, wanted, regexp_replace(x, '^[^0-9a-zA-ZÀ-ỹ]+', '') AS token, e FROM (SELECT id, wanted, unnest(p) AS x, unnest({ends}) AS e FROM pieces_bm)),
span_bm AS (SELECT id, e - length(token) AS s, e, lower(token) AS token FROM token_bm WHERE list_contains(wanted, lower(token))),
span AS (SELECT id, s::BIGINT AS s, e::BIGINT AS e, row_number() OVER (PARTITION BY id ORDER BY s, e) AS i FROM (SELECT id, s, e FROM span_sub UNION ALL SELECT id, s, e FROM span_rx UNION ALL SELECT id, s, e FROM span_bm)),
str AS (SELECT span.*, lower(hit.text[s + 1:e]) AS word FROM span JOIN hit USING (id)),
stop AS (SELECT a.id, a.i, a.s, coalesce(min(b.i) FILTER (b.i > a.i AND b.e > a.s + {w}), max(b.i) + 1) AS j FROM span a JOIN span b ON b.id = a.id AND b.i >= a.i GROUP BY a.id, a.i, a.s),
best AS (SELECT t.id, t.s, max(x.e) AS e FROM stop t JOIN str x ON x.id = t.id AND x.i >= t.i AND x.i < t.j GROUP BY t.id, t.i, t.s, t.j QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY count(DISTINCT x.word) DESC, count(*) DESC, t.s, t.i) = 1),
raw AS (SELECT hit.*, length(text) AS n, CASE WHEN best.s IS NULL THEN 0 ELSE least(length(text), greatest(0, best.s - ({w} - least({w}, best.e - best.s)) // 2) + {w}) END AS top, best.s IS NULL AS bare FROM hit LEFT JOIN best USING (id)),
cut AS (SELECT *, CASE WHEN bare THEN 0 ELSE greatest(0, top - {w}) END AS low, CASE WHEN bare THEN least(n, {w}) ELSE top END AS high FROM raw),
edge AS (SELECT *, CASE WHEN bare THEN 0 ELSE coalesce(list_max(list_filter(range(greatest(low - {slack}, 0), low + 1), lambda p: p = 0 OR text[p:p] IN (' ', chr(10)))), low) END AS lo,
  CASE WHEN bare THEN high ELSE coalesce(list_min(list_filter(range(high, least(high + {slack}, n) + 1), lambda p: p = n OR text[p + 1:p + 1] IN (' ', chr(10)))), high) END AS hi FROM cut),
isle AS (SELECT id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh, i FROM span),
merged AS (SELECT id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS g FROM isle) GROUP BY id, g)
SELECT source, query_id, video, name, lo, hi, (SELECT count(*) FROM span WHERE span.id = edge.id) AS n_spans,
  CASE WHEN trim(regexp_replace(text[lo + 1:hi], '\\s+', ' ', 'g')) = '' THEN '' ELSE CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(regexp_replace(text[lo + 1:hi], '\\s+', ' ', 'g')) || CASE WHEN hi < n THEN '…' ELSE '' END END AS snippet,
  (SELECT count(*) FROM merged m WHERE m.id = edge.id AND greatest(m.s, lo) < least(m.e, hi)) AS n_marked,
  CASE WHEN search = 'bm25' THEN array_to_string(list_filter(list_distinct_in_order, lambda x: list_contains(coalesce(there, []), x)), '|') WHEN multi THEN array_to_string(list_transform(found, lambda x: terms[x.term + 1]), '|') ELSE '' END AS matched_terms,
  CASE WHEN search = 'bm25' THEN len(list_distinct_in_order) WHEN multi THEN len(terms) ELSE 0 END AS terms_total,
  round(CASE WHEN search = 'bm25' THEN start_s + CASE WHEN n > 0 THEN least(1.0, greatest(0.0, (lo + hi) / 2.0::DOUBLE / n)) ELSE 0.5 END * 60 ELSE frame_idx / fps END, 3) AS at_s,
  CASE WHEN search = 'bm25' THEN round(start_s, 3) END AS start_s, CASE WHEN search = 'bm25' THEN round(start_s + 60, 3) END AS end_s, search = 'bm25' AS time_approx, video_rank, n_videos, exact_phrase::INT AS exact_phrase
FROM edge LEFT JOIN (SELECT id, list(DISTINCT token) AS there FROM span_bm GROUP BY id) USING (id)
  LEFT JOIN (SELECT id, list_filter(wanted, lambda x, i: list_position(wanted, x) = i) AS list_distinct_in_order FROM pieces_bm) USING (id)"""


QUERIES = {f.__name__: f for f in (annotate_sources, match_details)}
ORACLE_SQL = {"annotate_sources": _ANNOTATIONS, "match_details": _details_sql()}
