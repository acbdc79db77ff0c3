"""Document fingerprints (dealt operator 11): a Merkle tree over sections, paragraphs and phrases, in DataFrame functions only.

Leaves are phrases (48 code points, or up to and with `.!?,;:`, and the blanks after them); a paragraph is a line with its line feed; a section ends
after a blank line and after a paragraph whose hash begins with 0 or 1, so that an edit moves no border beyond its own section.
A leaf's mark is the md5 of its text and its length, a paragraph's hash the md5 of its leaves' marks, a section's that of its
paragraphs' hashes, the root the sha256 of the sections' hashes. Leaves joined in order are the text, so roots are equal
exactly where texts are (but for collisions), and branches that differ say where an edit is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PARAGRAPH = r"[^\n]*\n|[^\n]+"
PHRASE = r"[^.!?,;:]{1,48}[.!?,;:]*[ \t\n]*|[.!?,;:]+[ \t\n]*"
#: The low bits of a leaf's key hold its length in code points, at most this.
LONGEST = 2**20 - 1


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds `<prefix>root` (string), `<prefix>sections` (array of strings: the paragraphs' hashes of a section, comma-joined),
    `<prefix>paragraphs` (their hashes in order) and `<prefix>leaves` (distinct keys, long: 40 bits of the md5, 20 of the length).

    The text must not be null; an empty one has no branches and the sha256 of nothing as its root.
    """
    p = prefix
    marked = F.transform(
        F.regexp_extract_all(F.col(text), F.lit(PARAGRAPH), F.lit(0)),
        lambda q: F.transform(F.regexp_extract_all(q, F.lit(PHRASE), F.lit(0)), lambda x: F.concat(F.md5(x.cast("binary")), F.char_length(x).cast("string"))),
    )
    df = df.withColumn(f"{p}marks", marked)
    key = lambda m: F.conv(F.substring(m, 1, 10), 16, 10).cast("bigint") * (LONGEST + 1) + F.least(F.substring(m, 33, 20).cast("bigint"), F.lit(LONGEST))
    df = df.withColumn(f"{p}leaves", F.array_distinct(F.transform(F.flatten(f"{p}marks"), key)))
    # a blank line is one line feed, so its one leaf has the md5 of that
    blank = F.concat(F.md5(F.lit("\n").cast("binary")), F.lit("1"))
    hashed = F.transform(f"{p}marks", lambda m: F.concat(F.md5(F.array_join(m, "").cast("binary")), F.when((F.element_at(m, 1) == blank), "|").otherwise("")))
    df = df.withColumn(f"{p}hashed", hashed).drop(f"{p}marks")
    ends = F.transform(f"{p}hashed", lambda h: F.concat(F.substring(h, 1, 32), F.when((F.char_length(h) > 32) | (F.substring(h, 1, 1) < "2"), "|").otherwise(",")))
    df = df.withColumn(f"{p}sections", F.filter(F.split(F.array_join(ends, ""), r"\|"), lambda s: s != ""))
    df = df.withColumn(f"{p}paragraphs", F.transform(f"{p}hashed", lambda h: F.substring(h, 1, 32))).drop(f"{p}hashed")
    return df.withColumn(f"{p}root", F.sha2(F.array_join(F.transform(f"{p}sections", lambda s: F.md5(s.cast("binary"))), "").cast("binary"), 256))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct leaves: twice the characters of leaves in both, over the characters of either (1 for none at all)."""
    weight = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, k: s + k % (LONGEST + 1))
    total = weight(a) + weight(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((2 * weight(F.array_intersect(a, b))).cast("double") / total.cast("double"))


def differing(sections: Column, others: Column) -> Column:
    """Where a document differs from another: (section, paragraph), both from 0, of each paragraph in a section that has no equal
    one in `others`, unless an unlike section of `others` holds that paragraph. Equal branches are not gone into."""
    theirs = F.split(F.array_join(F.filter(others, lambda s: ~F.array_contains(sections, s)), ","), ",+")
    inside = lambda s, i: F.filter(F.transform(F.split(F.rtrim(s, F.lit(",")), ","), lambda h, j: F.when(~F.array_contains(theirs, h), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())
    return F.flatten(F.transform(sections, lambda s, i: F.when(F.array_contains(others, s), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(inside(s, i))))


def _ring(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """ids (k, doc_id, n, copies) with `next_k`, the key that follows by (doc_id, nulls first, k), after the last the first.

    Rows are dealt by range, so that only what starts each part (one row a part) meets in one task.
    """
    ranged = scratch.write(ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), "k").withColumn("part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "k")
    parts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "k")).alias("first"))
    in_order = Window.orderBy("part")
    every = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = parts.select("part", F.coalesce(F.lead("first").over(in_order), F.first("first").over(every))["k"].alias("after"))
    return ranged.withColumn("next_k", F.lead("k").over(inside)).join(after, "part").withColumn("next_k", F.coalesce("next_k", "after")).drop("part", "after")


def edits_and_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of an edited text (its last quarter of code points replaced by as many first ones of the next
    document, or all it has), and how like it is to the edited text and to the next document.

    Null texts count as empty. Documents go by id (null ids first), those of one id by a hash; repeated rows follow each other, so all
    but the last have a next document equal to themselves. The only document is its own next one. Other columns are ignored.
    Texts are shuffled once, and of a next document only the beginning that is needed and the leaves.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    text = F.coalesce(F.col(text_col), F.lit(""))
    k = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary")))
    keyed = docs.select(k.alias("k"), F.col(id_col).alias("doc_id"), text.alias("text"))
    ids = keyed.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first(F.char_length("text").cast("long")).alias("n"), F.count(F.lit(1)).alias("copies"))
    ring = scratch.write(_ring(scratch.write(ids, "ids"), scratch), "ring")
    ring = scratch.write(ring.join(ring.select(F.col("next_k").alias("k"), F.col("k").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("asked")), "k"), "both_ways")
    held = keyed.groupBy("k").agg(F.first("text").alias("text")).join(ring, "k")
    sent = with_tree(held.select(F.col("before").alias("k"), F.expr("left(text, asked)").alias("head"), "text"), "text", "next_").select("k", "head", "next_leaves")

    quarter = F.floor(F.col("n") / 4).cast("int")
    both = with_tree(held.select("k", "doc_id", "n", "copies", "text"), "text").select("k", "doc_id", "n", "copies", "text", "root", "sections", "leaves").join(sent, "k")
    kinds = F.explode(F.when(F.col("copies") > 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    both = both.withColumn("self", kinds).withColumn("head", F.when(F.col("self"), F.expr("left(text, cast(floor(n / 4) as int))")).otherwise(F.col("head")))
    both = both.withColumn("next_leaves", F.when(F.col("self"), F.col("leaves")).otherwise(F.col("next_leaves")))
    both = both.withColumn("edited", F.concat(F.expr("left(text, cast(n as int) - cast(floor(n / 4) as int))"), F.when(quarter > 0, F.col("head")).otherwise(""))).drop("text", "head")
    both = with_tree(both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "edited_").drop("edited")
    out = both.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", F.col("root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        F.size(differing(F.col("sections"), F.col("edited_sections"))).cast("long").alias("n_changed"),
        F.when(F.col("self"), F.col("copies") - 1).otherwise(F.lit(1)).alias("times"),
    )
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def _tree_sql(source: str) -> str:
    """The tree of `source` (id, text) in DuckDB's SQL: id, root, sections, leaves."""
    return f"""SELECT id, sha256(array_to_string(list_transform(sections, lambda s: md5(s)), '')) AS root, sections, leaves FROM (
      SELECT id, leaves, list_filter(string_split(array_to_string(list_transform(hashed, lambda h: h[1:32] || CASE WHEN len(h) > 32 OR h[1:1] < '2' THEN '|' ELSE ',' END), ''), '|'), lambda s: s <> '') AS sections FROM (
        SELECT id, list_distinct(list_transform(flatten(marks), lambda m: ('0x' || m[1:10])::BIGINT * {LONGEST + 1} + least(m[33:]::BIGINT, {LONGEST}))) AS leaves,
          list_transform(marks, lambda m: md5(array_to_string(m, '')) || CASE WHEN m[1] = md5(chr(10)) || '1' THEN '|' ELSE '' END) AS hashed FROM (
          SELECT id, list_transform(regexp_extract_all(text, '{PARAGRAPH}'), lambda q: list_transform(regexp_extract_all(q, '{PHRASE}'), lambda x: md5(x) || len(x))) AS marks FROM {source})))"""


def _like_sql(a: str, b: str) -> str:
    weight = lambda x: f"coalesce(list_sum(list_transform({x}, lambda k: k % {LONGEST + 1})), 0)"
    total = f"({weight(a)} + {weight(b)})"
    return f"CASE WHEN {total} = 0 THEN 1.0::DOUBLE ELSE CAST(2 * {weight(f'list_intersect({a}, {b})')} AS DOUBLE) / CAST({total} AS DOUBLE) END"


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')))) AS id FROM documents),
n AS (SELECT d.id, d.doc_id, d.text, len(d.text) AS n, o.id AS next_id, d.text[1:len(d.text) - len(d.text) // 4] || o.text[1:len(d.text) // 4] AS edited FROM d JOIN d o ON o.id = d.id % (SELECT count(*) FROM d) + 1),
t AS ({_tree_sql('d')}), e AS ({_tree_sql('(SELECT id, edited AS text FROM n)')}),
j AS (SELECT n.doc_id, n.n, n.edited, t.root, t.sections, t.leaves, e.root AS e_root, e.sections AS e_sections, e.leaves AS e_leaves, x.leaves AS n_leaves FROM n JOIN t ON t.id = n.id JOIN e ON e.id = n.id JOIN t x ON x.id = n.next_id)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, root AS fingerprint, e_root AS edited_fingerprint, {_like_sql('leaves', 'e_leaves')} AS near_edited, {_like_sql('leaves', 'n_leaves')} AS near_next,
  len(list_filter(string_split(array_to_string(list_filter(sections, lambda s: NOT list_contains(e_sections, s)), ','), ','),
    lambda h: h <> '' AND NOT list_contains(string_split(array_to_string(list_filter(e_sections, lambda s: NOT list_contains(sections, s)), ','), ','), h))) AS n_changed FROM j"""
