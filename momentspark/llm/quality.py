"""Quality rules (dealt operator 7): a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or that the their they this to was were which will with you "
    "au aux avec ce dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour qu que qui sa se ses son sur un une vous "
    "als auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht noch sich sie sind so und von vor war wie wird zu zum zur "
    "al como con del el ella en era es esta este ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin su sus también un una y ya"
).split()


class Rule(NamedTuple):
    """A ratio of two measures with the bounds (inclusive) between which a document is kept; None leaves a side open."""

    name: str
    over: str
    under: str
    low: float | None
    high: float | None


#: Bounds set so that prose passes in any of the four languages; what they reject is mark-up noise, tables, lists and boilerplate.
RULES = (
    Rule("words", "n_words", "one", 50, None),
    Rule("mean_word_chars", "word_chars", "n_words", 2, 12),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.3),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_word_share", "n_repeat_words", "n_words", None, 0.5),
)
SPACE = r"[\\x20\\x09-\\x0D]"


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words (long).

    Null and empty texts have none of each. Columns of `docs` with these names are replaced; names that start with `_q_`
    are used in between. n_repeat_words: three-word windows are sorted by a number made of 33 bits of their hash and
    their position, and only those that share these bits with a neighbour are compared word by word.
    """
    steps = [
        ("_q_text", f"coalesce({text_col}, '')"),
        ("_q_words", f"filter(split(_q_text, '{SPACE}+', -1), x -> x <> '')"),
        ("_q_lines", rf"filter(split(_q_text, '\\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        ("_q_sorted", "sort_array(transform(if(size(_q_words) < 4, array(), sequence(0, size(_q_words) - 3)), i -> shiftleft(xxhash64(_q_words[i], _q_words[i + 1], _q_words[i + 2]), 31) | cast(i as bigint)))"),
        ("_q_like", "transform(filter(_q_sorted, (x, i) -> shiftright(x, 31) = shiftright(get(_q_sorted, i + 1), 31) or shiftright(x, 31) = shiftright(get(_q_sorted, i - 1), 31)), x -> cast(x & 2147483647 as int))"),
        ("_q_like", "sort_array(transform(_q_like, i -> struct(struct(_q_words[i] as a, _q_words[i + 1] as b, _q_words[i + 2] as c) as w, i as i)))"),
        ("_q_like", "transform(filter(_q_like, (x, i) -> x.w = get(_q_like, i + 1).w or x.w = get(_q_like, i - 1).w), x -> x.i)"),
        ("n_words", "cast(size(_q_words) as bigint)"),
        ("word_chars", "cast(length(array_join(_q_words, '')) as bigint)"),
        ("n_symbols", "cast(regexp_count(_q_text, '[#*$%&|<>]') as bigint)"),
        ("n_stop_words", "cast(size(filter(_q_words, x -> lower(rtrim('.,;:!?', x)) in (" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "))) as bigint)"),
        ("n_lines", "cast(size(_q_lines) as bigint)"),
        ("n_dup_lines", "cast(size(_q_lines) - size(array_distinct(_q_lines)) as bigint)"),
        ("n_repeat_words", "cast(size(array_distinct(flatten(transform(_q_like, i -> array(i, i + 1, i + 2))))) as bigint)"),
    ]
    out = docs
    for name, how in steps:
        out = out.withColumn(name, F.expr(how))
    # a filter on a column that is not deterministic keeps later filters from being pushed below, where
    # they would repeat the measures in place of each name
    return out.withColumn("_q_mark", F.monotonically_increasing_id()).where("_q_mark >= 0").drop("_q_text", "_q_words", "_q_lines", "_q_sorted", "_q_like", "_q_mark")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule holds. A ratio over nothing counts as 0."""
    kept = F.lit(True)
    for r in rules:
        ratio = F.col(r.over).cast("double") if r.under == "one" else F.when(F.col(r.under) > 0, F.col(r.over) / F.col(r.under)).otherwise(0.0)
        if r.low is not None:
            kept = kept & (ratio >= r.low)
        if r.high is not None:
            kept = kept & (ratio <= r.high)
    return kept


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """`docs` with the measures, base_failed and kept. Rows are judged one by one: repeated rows each, whatever their id.

    base_failed: fewer than 50 words, or more than half of the words lie in repeated three-word windows.
    kept: not base_failed, and all rules hold. Null and empty texts fail. An empty table gives an empty one.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `judge` keeps, with the columns of `docs`."""
    slim = docs.select(F.struct(*docs.columns).alias("_q_row"), F.col(text_col).alias("_q_in"))
    return judge(slim, rules, "_q_in").where("kept").select("_q_row.*")


#: The same by windows and grouping over (doc, position), for DuckDB; one row for each row of documents.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) >= 2),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(ws, lambda x: list_contains([STOPS], lower(rtrim(x, '.,;:!?'))))) AS n_stop_words,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words >= 2 AND word_chars / n_words <= 12 AND n_symbols / n_words <= 0.3
    AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM f
""".replace("STOPS", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))))
