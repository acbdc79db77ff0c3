"""HTML extraction (dealt operator 8): union-free regular expressions inferred over pages of one host (wrappers).

A page is read leniently into block elements; inline tags melt into the text around them. A wrapper is such a tree whose children
form a union-free regular expression: a sequence of groups, each of which may be optional or repeated, and texts that are either
constant or slots. It starts as one page. Another page (or wrapper) is aligned with it by the longest common sequence of
children; where they mismatch, equal neighbours fold into repeated groups, children that only one side has become
optional, and texts that differ become slots. Spark infers a wrapper in each task from pages of each host it meets,
then aligns those of a host with each other.

Every page is then matched against its host's wrapper, group by group. A text that stands where the wrapper has a slot, or in an
optional or repeated group, is the page's own; one that the wrapper has as a constant of `seen` pages or more is the host's and goes, whatever the
tags around it. A wrapper of fewer pages tells nothing about constants. Fixed lists of element names and class words only break ties among what
is the page's own: they tell the article from menus, adverts and comments that also differ from page to page.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
PLAIN, QUOTE = re.compile(r"[^>\"'<]*"), {'"': '"', "'": "'"}
ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# fixed values: element names of HTML by their role
RAW = set("script style noscript template textarea title iframe canvas".split())
END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style textarea title iframe noscript".split()}  # their content is text up to the end tag
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "svg g path rect circle ellipse line polygon polyline defs use text tspan math mi mn mo mrow mfrac msup msub msqrt mtext object picture".split())
CLOSED_BY_ITSELF = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
NOT_TEXT = set("head nav footer aside form menu button dialog header select".split()) | RAW
# fixed values: words in class, id or role that mark what is not the article, and what holds it
OTHER_WORDS = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header notice notices alert cookie cookies consent "
    "comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe popup modal login signup search widget toolbar pagination pager masthead skip".split()
)
#: the same inside an article, where the others may be its subject
OTHER_INSIDE = set("ad ads advert adverts advertisement banner sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer notice notices cookie cookies consent comment comments reply replies respond disqus newsletter subscribe pagination".split())
MAIN_WORDS = set("content article post entry story main articlebody".split())
SLOT = None
#: Elements that stand in rows by their nature; others fold into repeated groups only where pages mismatch.
REPEATING = set("p li dt dd tr td th blockquote pre".split())
#: Pages on which a text must be the same to be a constant: inside an article or main part, and where the wrapper has none.
SEEN_INSIDE, SEEN_ANYWHERE = 4, 2
#: Elements nested deeper melt into the one above.
DEEPEST = 200
# fixed values: last parts of compound class words that say nothing of their own (ad-slot, comment-list, nav-left), elements that hold a part of a
# page, and words that mark what belongs to an article although it may be the same on all pages
PLAIN_PARTS = set("list box container wrapper wrap section area block slot bar panel unit group inner outer link links item items post posts button buttons form thread count top bottom left right main primary secondary mobile desktop".split())
PARTS = set("div section ul ol dl table figure details fieldset center address main".split())
OWN_WORDS = set("byline author date dateline time published meta summary lead intro abstract title subtitle headline caption".split())
#: Unfinished wrappers of a host in a task; further ones go out as they are and are aligned with the others later.
OPEN_KINDS = 8


class Node:
    """A block element: its name, words of class, id and role, and children (nodes and texts in page order)."""

    __slots__ = ("kids", "name", "words")

    def __init__(self, name: str, words: tuple[str, ...] = ()):
        self.name, self.words, self.kids = name, words, []


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag, comment or declaration (the latter two without a name), in one pass.

    A quote opens a value only after `=`; the value reaches to the next such quote however far that is, and if there is none the quote is a plain
    character. A tag that no `>` closes before another `<` is text; so is a `<` before anything but a letter, a slash, `!` or `?`. A comment without an end takes the rest of the page. Scripts and the like reach up to
    their first end tag, whatever stands inside.
    """
    at, last, ahead = page.find("<"), len(page), {}
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = last if end < 0 else end + 3
            yield at, end, "", "", ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1 or last
            yield at, end, "", "", ""
        elif m := NAME.match(page, at):
            end = _tag_end(page, m.end(), ahead)
            if end < 0:
                end = m.end()
            else:
                name, attributes = m[2].lower(), page[m.end() : end - 1]
                if name in END and not m[1] and not attributes.rstrip().endswith("/"):
                    close = END[name].search(page, end)
                    end = close.start() if close else last
                yield at, end, m[1], name, attributes
        else:
            end = at + 1
        at = page.find("<", end)


def _tag_end(page: str, at: int, ahead: dict[str, int]) -> int:
    """Just behind the `>` that closes a tag whose attributes begin at `at`; -1 if another `<` comes first. Values in quotes may hold both.

    `ahead` has, for each quote sign, the place of the next one as far as it has been looked for, so that a page is searched once for each.
    """
    begin = at
    while True:
        at = PLAIN.match(page, at).end()
        sign = page[at : at + 1]
        if sign == ">":
            return at + 1
        if sign not in QUOTE:
            return -1
        before = at - 1
        while before > begin and page[before].isspace():
            before -= 1
        at += 1
        if page[before] == "=" and before >= begin:
            if ahead.get(sign, 0) < at:
                found = page.find(sign, at)
                ahead[sign] = found if found >= 0 else len(page)
            if ahead[sign] < len(page):
                at = ahead[sign] + 1


def _words(attributes: str) -> tuple[str, ...]:
    return tuple(w for a in ATTR.finditer(attributes) for w in (a[2] or a[3] or a[4] or "").lower().split())


@lru_cache(100_000)
def _means(word: str, which: str) -> bool:
    """Whether a class word names one of a set: itself or, of a compound, its last part that says anything (`ad-slot` an ad, `ads-free` none)."""
    known = {"other": OTHER_WORDS, "inside": OTHER_INSIDE, "own": OWN_WORDS}[which]
    if word in known:
        return True
    parts = [p for p in re.split(r"[_-]+|[0-9]+$", word) if p]
    while len(parts) > 1 and parts[-1] in PLAIN_PARTS - known:
        parts.pop()
    return bool(parts) and parts[-1] in known


def _parts(words) -> set[str]:
    return {p for w in words for p in re.split(r"[_-]+", w)}


def parse(page: str) -> Node:
    """The block tree of a page. Unclosed and stray tags are put up with; comments, scripts and the like leave nothing. Elements nested deeper
    than `DEEPEST` melt into the one above."""
    root = Node("root")
    stack, text, at, hidden = [root], [], 0, None

    def flush():
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            stack[-1].kids.append(block)

    for start, end, slash, name, attributes in tags(page):
        opens_raw = name in RAW and not slash and not attributes.rstrip().endswith("/")
        if not hidden:
            text.append(page[at:start])
            at = end
        if opens_raw and name in END:
            continue
        if hidden:
            if slash and name == hidden:
                hidden, at = None, end
        elif not name:
            continue
        elif name == "br":
            text.append(" ")
        elif name in INLINE or (name in VOID and name != "hr"):
            continue
        elif name in RAW:
            hidden = name if opens_raw else None
        elif slash:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
        else:
            flush()
            closes = CLOSED_BY_ITSELF.get(name, {"p"})
            while stack[-1].name in closes:
                stack.pop()
            node = Node(name, _words(attributes))
            if len(stack) < DEEPEST:
                stack[-1].kids.append(node)
                if name not in VOID:
                    stack.append(node)
    if not hidden:
        text.append(page[at:])
    flush()
    return root


# A wrapper is JSON: [name, words, groups]; a group is [optional, repeated, [items]]; an item is a wrapper, {"text": digest of a constant, "n": pages that have it} or {"text": null} (a slot).
def digest(text: str) -> str:
    import xxhash

    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "replace"))


def _key(item) -> tuple:
    return ("text",) if isinstance(item, dict) else (item[0], *item[1])


def wrapper_of(node: Node) -> list:
    """The wrapper of one page: neighbouring paragraphs, list items and the like are repeated groups, all other texts constant."""
    items = [{"text": digest(k), "n": 1} if isinstance(k, str) else wrapper_of(k) for k in node.kids]
    groups: list = []
    for i in items:
        if groups and isinstance(i, list) and i[0] in REPEATING and _key(groups[-1][2][0]) == _key(i):
            groups[-1] = [False, True, [_align_items(groups[-1][2][0], i)]]
        else:
            groups.append([False, False, [i]])
    return [node.name, list(node.words), groups]


def _fold(groups: list) -> list:
    """Neighbouring runs of groups with like items become repeated groups (runs of one, two and three items)."""
    for period in (1, 2, 3):
        out: list = []
        for g in groups:
            out.append(g)
            while len(out) >= (2 * period if period == 1 else period + 1):
                a, b = out[-2 * period : -period], out[-period:]
                loop, tail = out[-period - 1], [g[2][0] for g in b if len(g[2]) == 1 and not g[0] and not g[1]]
                if period > 1 and loop[1] and len(loop[2]) == period == len(tail) and [_key(i) for i in loop[2]] == [_key(i) for i in tail]:
                    out[-period - 1 :] = [[loop[0], True, [_align_items(x, y) for x, y in zip(loop[2], tail, strict=True)]]]
                    break
                if period == 1:
                    if [_key(i) for i in a[0][2]] != [_key(i) for i in b[0][2]] or _key(a[0][2][0]) == ("text",):
                        break
                    merged = [a[0][0] and b[0][0], True, [_align_items(x, y) for x, y in zip(a[0][2], b[0][2], strict=True)]]
                else:
                    plain = [g for g in a + b if len(a) == period and len(g[2]) == 1 and not g[0] and not g[1]]
                    if len(plain) < 2 * period or [_key(g[2][0]) for g in a] != [_key(g[2][0]) for g in b] or len({_key(g[2][0]) for g in a}) < 2:
                        break
                    merged = [False, True, [_align_items(x[2][0], y[2][0]) for x, y in zip(a, b, strict=True)]]
                out[-2 * period :] = [merged]
                if period > 1:
                    break
        groups = out
    return groups


def _gather(groups: list, other: list) -> list:
    """Runs of single items that the other side has as one group become a group here too (one turn of its loop)."""
    for loop in (g for g in other if len(g[2]) > 1):
        keys, out, at = [_key(i) for i in loop[2]], [], 0
        while at < len(groups):
            run = groups[at : at + len(keys)]
            if all(len(g[2]) == 1 for g in run) and [_key(g[2][0]) for g in run] == keys:
                out.append([False, False, [g[2][0] for g in run]])
                at += len(keys)
            else:
                out.append(groups[at])
                at += 1
        groups = out
    return groups


def common_sequence(x: list, y: list) -> list[tuple[int, int]]:
    """Places of a longest common sequence. Equal ends are matched first.

    What is between has no bound: a row of the table is one whole number, whose bit j tells that leaving out item j of `y` makes the longest
    sequence shorter (Hyyroe, 2004). Every k-th row is kept, k being about the root of how many there are, and those between are made again on the way back.
    """
    head = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    tail = next((k for k, (a, b) in enumerate(zip(reversed(x[head:]), reversed(y[head:]))) if a != b), min(len(x), len(y)) - head)
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    n, m = len(a), len(b)
    pairs = [(k, k) for k in range(head)]
    if n and m:
        where: dict = {}  # from an item to its places in b, counted from its end
        for j, item in enumerate(b):
            where[item] = where.get(item, 0) | 1 << (m - 1 - j)
        full, every = (1 << m) - 1, math.isqrt(n) + 1

        def above(row: int, item) -> int:
            met = row & where.get(item, 0)
            return (row + met | row - met) & full

        kept, row = {n: full}, full  # a bit is off where the sequence grows
        for i in range(n - 1, -1, -1):
            row = above(row, a[i])
            if i % every == 0:
                kept[i] = row
        rows: dict[int, int] = {}

        def at(i: int) -> int:
            if i not in rows:
                last = min(n, (i // every + 1) * every)
                rows.clear()
                rows[last] = kept[last]
                for k in range(last - 1, i - 1, -1):
                    rows[k] = above(rows[k + 1], a[k])
            return rows[i]

        length = lambda row, j: m - j - (row & (1 << (m - j)) - 1).bit_count()
        i, j, below = 0, 0, length(at(1), 0)  # below: the longest of a[i + 1:] and b[j:]
        here = length(kept[0], 0)
        while i < n and j < m and here:
            if a[i] == b[j]:
                pairs.append((head + i, head + j))
                i, j, here = i + 1, j + 1, here - 1
                below = length(at(i + 1), j) if i < n else 0
            elif below == here:
                i += 1
                below = length(at(i + 1), j) if i < n else 0
            else:
                below -= at(i + 1) >> (m - 1 - j) & 1 ^ 1
                j += 1
    return pairs + [(len(x) - tail + k, len(y) - tail + k) for k in range(tail)]


def _align_items(a, b):
    if isinstance(a, dict):
        return {"text": a["text"], "n": a["n"] + b["n"]} if a["text"] is not SLOT and a["text"] == b["text"] else {"text": SLOT}
    return align(a, b)


def align(a: list, b: list) -> list:
    """The wrapper that generates what both do; they have one name and the same words."""
    keys = lambda z: [tuple(_key(i) for i in g[2]) for g in z]
    x, y = a[2], b[2]
    alike = keys(x) == keys(y)
    if not alike:  # a mismatch: repeats are looked for first
        x, y = _fold(x), _fold(y)
        x, y = _gather(x, y), _gather(y, x)
    kx, ky = keys(x), keys(y)
    if kx == ky:
        pairs = list(zip(range(len(x)), range(len(y)), strict=True))
    else:
        pairs = common_sequence(kx, ky)
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(x), len(y))]:
        out += [[True, g[1], g[2]] for g in [*x[i:p], *y[j:q]]]
        if p < len(x) and q < len(y):
            out.append([x[p][0] or y[q][0], x[p][1] or y[q][1], [_align_items(s, t) for s, t in zip(x[p][2], y[q][2], strict=True)]])
        i, j = p + 1, q + 1
    return [a[0], a[1], out if alike else _fold(out)]


def _other(name: str, words, inside: bool) -> bool:
    """Marked as something else than the article. A header inside an article is part of it."""
    if inside:
        return (name in NOT_TEXT and name != "header") or any(_means(w, "inside") for w in words)
    return name in NOT_TEXT or any(_means(w, "other") for w in words)


def _container(level: int, name: str, words) -> bool:
    if level == 0:
        return name == "article" or "article" in _parts(words) and name != "root"
    return name == "main" or "main" in _parts(words) if level == 1 else bool(MAIN_WORDS & _parts(words)) and name not in ("html", "body")


def _level(w: list) -> int:
    """How the wrapper holds its text: 0 in articles, 1 in a main part, 2 in parts so named, 3 anywhere."""
    found = 3
    todo = [w]
    while todo:
        for _, _, items in todo.pop()[2]:
            for i in items:
                if isinstance(i, list) and not _other(i[0], i[1], False):
                    found = min([found, *(lv for lv in range(3) if _container(lv, i[0], i[1]))])
                    todo.append(i)
    return found


def _has_slots(w: list) -> bool:
    """Whether any two of its pages differ in a text: else they are copies, and their constants tell nothing."""
    todo = [w]
    while todo:
        for _, _, items in todo.pop()[2]:
            for i in items:
                if isinstance(i, list):
                    todo.append(i)
                elif i["text"] is SLOT:
                    return True
    return False


def _constant(w: list, least: int) -> bool:
    """Whether a part is the same on all pages as a whole: no slot, no repeats, each text seen on `least` pages, and something in it."""
    todo, texts = [w], 0
    while todo:
        for _, repeated, items in todo.pop()[2]:
            if repeated:
                return False
            for i in items:
                if isinstance(i, list):
                    todo.append(i)
                elif i["text"] is SLOT or i["n"] < least:
                    return False
                else:
                    texts += 1
    return texts > 0


@lru_cache(2000)
def _loaded(text: str) -> tuple[list, int, bool]:
    w = json.loads(text)
    return w, _level(w), _has_slots(w)


def blocks_of(page: str, wrapper: str | None = None) -> list[tuple[str, bool, bool]]:
    """(text, the page's own, part of the article by its tags) of each block, in page order.

    The page is matched against the wrapper group by group. A text is not the page's own where the wrapper has it as a constant of enough
    pages and, in an article, where it stands in a part that is constant as a whole: headings and labels that recur among an article's own texts
    stay, and so do parts named as its own (a byline). Texts in repeated groups and slots, and those that the wrapper does not know, stay as well.
    """
    tree = parse(page)
    w, level, telling = _loaded(wrapper) if wrapper else (wrapper_of(tree), _level(wrapper_of(tree)), False)
    out: list[tuple[str, bool, bool]] = []

    def walk(node: Node, groups: list, inside: bool, off: bool, repeated: bool, fixed: bool) -> None:
        at = 0
        for kid in node.kids:
            key = ("text",) if isinstance(kid, str) else (kid.name, *kid.words)
            hit, loop = None, repeated
            for k in range(at, len(groups)):
                hit = next((i for i in groups[k][2] if _key(i) == key), None)
                if hit is not None:
                    at = k if groups[k][1] or len(groups[k][2]) > 1 else k + 1
                    loop = repeated or groups[k][1]
                    break
            if isinstance(kid, str):
                constant = telling and (fixed or level == 3) and not loop and hit is not None and hit.get("n", 0) >= (SEEN_INSIDE if level < 3 else SEEN_ANYWHERE) and hit["text"] == digest(kid)
                out.append((kid, not constant, not off and (inside or level == 3)))
            else:
                into = inside or (level < 3 and _container(level, kid.name, kid.words))
                whole = fixed or (telling and inside and hit is not None and kid.name in PARTS and not any(_means(x, "own") for x in kid.words) and _constant(hit, SEEN_INSIDE))
                walk(kid, hit[2] if hit else [], into, off or _other(kid.name, kid.words, inside), loop, whole)

    walk(tree, w[2], False, False, False, False)
    return out


def extract(page: str | None, wrapper: str | None = None) -> str:
    """The article's blocks, joined by two line feeds; '' for a null or empty page. A page of which nothing would stay is taken without the wrapper."""
    if not page:
        return ""
    text = "\n\n".join(t for t, own, article in blocks_of(page, wrapper) if own and article)
    return text if text or not wrapper else extract(page)


def host(url):
    """Of a url column: what stands between `//` and the next `/`, `?` or `#`, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def _size(w: list) -> int:
    todo, n = [w], 0
    while todo:
        groups = todo.pop()[2]
        n += len(groups)
        todo += [i for g in groups for i in g[2] if isinstance(i, list)]
    return n


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", most_groups: int = 3000) -> DataFrame:
    """(host, wrapper string): from all pages of each host in each task, then aligned over tasks.

    Pages stay where they are; only wrappers are shuffled, first by (host, task group), then by host, so that a common host's
    wrappers do not meet in one task at once. Null and empty pages teach nothing, all others do: a page that would bring its host's wrapper in a task beyond
    `most_groups` groups is of another kind and begins one of its own. Of these `OPEN_KINDS` at most are held for a host; where there are more, the
    one not met for longest goes out. All wrappers of a host are aligned with each other in the end, those of all kinds too.
    """

    def partial(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = lambda found: pa.record_batch([pa.array([h for h, _ in found], pa.string()), pa.array([part] * len(found), pa.int32()), pa.array([json.dumps(w) for _, w in found], pa.string())], names=["host", "part", "wrapper"])
        have: dict[str, list] = {}  # the kinds of a host, the one met last at the end
        for b in slices(batches, "h"):
            gone = []
            for name, page in zip(b.column("host").to_pylist(), b.column("h").to_pylist(), strict=True):
                if page:
                    new, kinds = wrapper_of(parse(page)), have.setdefault(name, [])
                    for k in range(len(kinds) - 1, -1, -1):
                        both = align(kinds[k], new)
                        if _size(both) <= most_groups:
                            del kinds[k]
                            new = both
                            break
                    kinds.append(new)
                    if len(kinds) > OPEN_KINDS:
                        gone.append((name, kinds.pop(0)))
            yield rows(gone)
        yield rows([(name, w) for name, kinds in have.items() for w in kinds])

    def together(pdf):
        import pandas as pd

        w = None
        for text in sorted(pdf["wrapper"]):
            w = align(w, json.loads(text)) if w else json.loads(text)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [int(pdf["part"].iloc[0])], "wrapper": [json.dumps(w)]})

    schema = "host string, part int, wrapper string"
    found = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("h")).mapInArrow(partial, schema)
    some = found.withColumn("part", F.pmod("part", F.lit(32))).groupBy("host", "part").applyInPandas(together, schema)
    return some.groupBy("host").applyInPandas(together, schema).select("host", "wrapper")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text string, n_chars long) for each row; text is '' for null and empty pages and where there is no article.

    The table of wrappers has a row for each host and is joined without a hint: Spark broadcasts it only below its own threshold.
    Pages without a host share the wrapper of host ''. Repeated ids keep their rows; other columns are ignored.
    """
    learned = Scratch(pages.sparkSession, "wrappers").write(infer_wrappers(pages, url_col=url_col, html_col=html_col), "wrappers")
    slim = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"), host(F.col(url_col)).alias("host"))

    def run(batches):
        for b in slices(batches, "h"):
            out = [extract(p, w) for p, w in zip(b.column("h").to_pylist(), b.column("wrapper").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("i"), b.column("u"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["i", "u", "text", "n_chars"])

    kind = slim.schema["i"].dataType.simpleString()
    done = slim.join(learned, "host", "left").select("i", "u", "h", "wrapper").mapInArrow(run, f"i {kind}, u string, text string, n_chars long")
    return done.withColumnsRenamed({"i": id_col, "u": url_col})
