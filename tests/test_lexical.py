"""Text search against plain loops: BM25 in blocks, patterns behind what they require."""

import math
import random
import re
from collections import Counter

import pytest

from momentspark.operators import lexical


def plain_bm25(docs, queries, k1=1.5, b=0.75):
    words = lambda t: [w for w in re.split("[^0-9a-zA-ZÀ-ỹ]+", t.lower()) if w]
    have = [(i, words(t)) for i, t in docs if t is not None and t.strip(" ")]
    mean = sum(len(w) for _, w in have) / max(1, len(have))
    df = Counter(x for _, w in have for x in set(w))
    out = []
    for q, text in queries:
        for i, w in have:
            tf = Counter(w)
            parts = [math.log(1 + (len(have) - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * (k1 + 1) / (tf[x] + k1 * (1 - b + b * len(w) / mean)) for x in set(words(text or "")) if tf[x]]
            if parts:
                out.append((q, i, round(sum(parts), 5)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [500_000, 25])
def test_bm25_is_that_of_a_loop(spark, most):
    r = random.Random(5)
    word = lambda: "w" + str(min(r.randrange(40), r.randrange(40)))
    docs = [(k, " ".join(word() for _ in range(r.randrange(1, 60)))) for k in range(200)] + [(200, None), (201, ""), (202, "  "), (203, "..."), (204, "Phở w1 PHỞ"), (204, "w1"), (None, "w2 w2"), (205, "w3 " * 50_000)]
    queries = [(f"q{k}", " ".join(word() for _ in range(4))) for k in range(12)] + [("none", "zzz"), ("blank", " ."), ("null", None), ("p", "phở w1 w1"), (None, "w5")]
    got = lexical.bm25(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(queries, "query_id string, query string"), most_words=most)
    assert got.schema.simpleString() == "struct<query_id:string,doc_id:int,score:double>"
    found = sorted(((x["query_id"], x["doc_id"], x["score"]) for x in got.collect()), key=lambda x: str(x[:2]) + str(x[2]))
    want = sorted(plain_bm25(docs, queries), key=lambda x: str(x[:2]) + str(x[2]))
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert all(abs(x[2] - y[2]) < 1e-4 for x, y in zip(found, want, strict=True))


def test_bm25_of_nothing(spark):
    docs, queries = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "query_id int, query string")
    assert lexical.bm25(docs.limit(0), queries).count() == 0 and lexical.bm25(docs, queries.limit(0)).count() == 0
    assert lexical.bm25(docs, queries).schema.simpleString() == "struct<query_id:int,doc_id:bigint,score:double>"


# what a pattern requires, by the docstring
@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("hello", "hello"), ("Hello World", "hello world"), ("colou?r", "colo"), ("ab+cde", "cde"), ("ab*", "a"), ("a{2,3}bc", "bc"), ("(abc)?de", "de"), ("(abcd)e", "e"), ("[abc]def", "def"), ("ab[^x]def", "ab"), ("ab[[x]]def", "ab"),
        ("a|b", ""), ("(?i)ab", ""), (r"\Qab\E", ""), (r"\x41bc", ""), (r"\d+ab", "ab"), (r"ab\.cde", "cde"), ("nước", "n"), ("^abc$", "abc"), ("", ""), (".*", ""), ("a(b[^c)]d)e", ""), ("x((ab)c)yz", "yz"), ("abc{0}", "ab"), ("ab++c", "ab"),
    ],
)
def test_what_a_pattern_requires(pattern, want):
    assert lexical.required(pattern) == want


PIECES = ["a", "B", "k", "s", " ", "1", "ab", "[ab]", "[^a]", "[]a]", "[a[b]]", "[a&&[^b]]", "(ab)", "(a(b)k)", ".", r"\d", r"\w", r"\.", r"\]", "ê", "{", "}", ")", "]", "^", "$"]
WHOLE = ["a|b", "(?x)a b", r"\Qab\E", r"\x61b", "kis", "isk", "a?"]


@pytest.mark.parametrize("seed", range(3))
def test_patterns_find_what_each_finds_alone(spark, seed):
    """Against the engine's own matcher, pattern by pattern."""
    r, compile_ = random.Random(seed), lexical._compiles
    made = ["".join(r.choice(PIECES) + r.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?", "??"]) for _ in range(r.randrange(1, 6))) for _ in range(150)]
    patterns, texts = WHOLE + made, ["".join(r.choices("abBkKsSıİſK1 êẞß.]^{", k=r.randrange(25))) for _ in range(60)]
    p = spark.createDataFrame(list(enumerate(patterns)), "query_id int, pattern string")
    t = spark.createDataFrame([(str(k), x) for k, x in enumerate([*texts, None, ""])], "name string, text string").coalesce(2)
    got = {(r[0], r[1], r[2]) for r in lexical.pattern_search(t, p).collect()}
    java = spark._jvm.java.util.regex.Pattern
    want = set()
    for q, x in enumerate(patterns):
        if x.strip(" ") and compile_(spark, x):
            compiled = java.compile("(?iu)" + x)
            for k, text in enumerate([*texts, ""]):
                m = compiled.matcher(text)
                if m.find():
                    want.add((q, str(k if k < len(texts) else len(texts) + 1), len(m.group())))
    assert got == want


def test_patterns_in_blocks_and_odd_ones(spark):
    rows = [("a", "foo[0-9]"), ("b", "([a-z"), ("c", None), ("d", "  "), ("e", "b.r"), ("e", "("), (None, "foo")]
    p = spark.createDataFrame(rows, "query_id string, pattern string")
    t = spark.createDataFrame([("x", "FOO1 bar"), ("y", None), ("z", "")], "name string, text string")
    for most in (1, 50_000):
        got = sorted(map(tuple, lexical.pattern_search(t, p, most).collect()), key=str)
        assert got == [("a", "x", 4), ("e", "x", 3), (None, "x", 3)]
    assert {r["query_id"] for r in lexical.invalid_patterns(p).collect()} == {"b", "e"}
    assert lexical.pattern_search(t, p.limit(0)).count() == 0 and lexical.pattern_search(t.limit(0), p).count() == 0
