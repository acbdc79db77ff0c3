"""Text expressions: accent folding, tokens, query terms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_map() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into a base letter and marks, and that letter; đ and Đ are added."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_map()
# What separates tokens, and what separates terms (a comma between two digits does not). Results depend on them.
NOT_TOKEN = "[^0-9a-zA-ZÀ-ỹ]+"
NOT_TERM = "(?<![0-9]),|,(?![0-9])|[;，；、]"


def fold(text: Column) -> Column:
    """Without accents: letters lose their marks, loose marks go."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def tokens(text: Column) -> Column:
    """Runs of digits and letters (accents kept), in lower case."""
    return F.filter(F.split(F.lower(text), NOT_TOKEN), lambda x: x != "")


def split_terms(text: Column, most: int = 5) -> Column:
    """Terms between , ; and their full-width forms (a comma between two digits does not split): trimmed, the first
    of those equal without case and accents, at most `most`."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), NOT_TERM), lambda x: F.regexp_replace(x, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")), lambda x: x != "")
    keyed = F.transform(parts, lambda x: F.struct(F.lower(fold(x)).alias("key"), x.alias("term")))
    none = F.array().cast("array<struct<key:string,term:string>>")
    new = lambda acc, x: (F.size(acc) < most) & ~F.exists(acc, lambda y: y["key"] == x["key"])
    first = F.aggregate(keyed, none, lambda acc, x: F.when(new(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return F.transform(first, lambda x: x["term"])


def split_query_text(text: Column) -> Column:
    """Parts between a full stop and white space, without stops at their ends; empty ones drop."""
    return F.filter(F.transform(F.split(F.trim(text), r"\.\s+"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"\.+$", ""))), lambda x: x != "")


def clean_answer(text: Column) -> Column:
    """Curly quotes straight, line breaks as spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "“”„‘’", "\"\"\"''"), r"[\r\n]+", " "))


def normalize_phase(phase: Column) -> Column:
    """p2 for 2, p2 and P2; p1 for anything else."""
    return F.when(F.lower(F.trim(phase)).isin("2", "p2"), "p2").otherwise("p1")
