"""Pages of any number of kinds teach a host's wrapper."""

import json

import pytest

from momentspark.llm import wrappers


def page(kind: int, k: int) -> str:
    return "<body>" + "".join(f"<div class=k{kind}x{i}>{'note' if i == 3 else f'{kind} {i} {k}'}</div>" for i in range(8)) + f"<div class=legal{kind}>Rights of kind {kind}</div></body>"


@pytest.mark.parametrize("kinds", [2, 11])
def test_a_page_of_another_kind_is_not_left_out(spark, kinds):
    rows = [(k * kinds + kind, "http://h.org/a", page(kind, k)) for k in range(3) for kind in range(kinds)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    (learned,) = wrappers.infer_wrappers(pages, most_groups=25).collect()
    for i, _, html in rows:
        kind, k = i % kinds, i // kinds
        assert wrappers.extract(html, learned["wrapper"]) == "\n\n".join(f"{kind} {j} {k}" for j in range(8) if j != 3)


def test_long_lists_have_a_whole_common_sequence():
    x, y = [k % 7 for k in range(1500)], [k % 5 for k in range(1500)]
    pairs = wrappers.common_sequence(x, y)
    best = [0] * 1501
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(best[j] + 1 if a == b else max(best[j + 1], new[j]))
        best = new
    assert len(pairs) == best[-1] and all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_alignment_leaves_what_it_is_given(spark):
    a, b = (wrappers.wrapper_of(wrappers.parse(page(k, 0))) for k in (0, 1))
    before = json.dumps([a, b])
    wrappers.align(a, b)
    assert json.dumps([a, b]) == before
