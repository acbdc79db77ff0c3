"""SimHash near-duplicates (dealt operator 9): 64-bit fingerprints linked by BK-trees.

Fingerprints within `radius` bits agree, by the pigeonhole principle, on at least `blocks - radius` of `blocks` bit
blocks. Each choice of that many blocks is a table of shards; in a shard, fingerprints go one by one into a
BK-tree (children keyed by the integer Hamming distance to the parent), and a search follows only the edges
whose key lies within `radius` of the distance at the node. So each pair within the radius is found, in
shards which stay small at any size of corpus: with 6 blocks a shard fixes about 21 bits, with 8 about 32.
A shard's tree is built where its rows are, not broadcast: trees over all fingerprints have no size bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, block_pairs, join_dealt, slices, whole_groups
from .components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SIGN = 1 << 63
SLOTS = 768
ORDERS = np.random.default_rng(11).integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash over `words`-word shingles of the text in lower case (A-Z only), repeats included.

    Fewer words make one shingle; no word (empty or null text) makes fingerprint 0.
    """
    import xxhash

    found = WORD.findall((text or "").encode("utf-8", "replace").translate(LOWER))
    if not found:
        return 0
    k, joined = min(words, len(found)), b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - k + 1]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), len(starts)
    for i in range(0, n, 200_000):
        spans = zip(starts[i : i + 200_000].tolist(), (ends[k - 1 :] - 1)[i : i + 200_000].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the text's `words`-word shingles in lower case (A-Z only), ascending; of fewer words, one."""
    import xxhash

    found = WORD.findall((text or "").encode("utf-8", "replace").translate(LOWER))
    if not found:
        return np.zeros(0, dtype=np.uint64)
    k, joined, digest = min(words, len(found)), b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - k + 1]
    spans = zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype="<u8"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def set_fingerprint(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set of hashes (`shingles`), as an unsigned number. 0 for the empty set."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), 100_000):
        total += np.unpackbits(found[i : i + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(found), bitorder="little").view("<u8")[0])


def minhash_bits(found: np.ndarray) -> bytes:
    """One bit of the smallest hash of a set in each of 768 orders (Li and König, 2010): of two sets of Jaccard similarity s
    each bit differs with probability (1 - s) / 2. Zeros for the empty set."""
    if not len(found):
        return bytes(SLOTS // 8)
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SLOTS, (1 << 32) - 1, dtype=np.uint32)
    for i in range(0, len(x), 512):
        least = np.minimum(least, (ORDERS[:, None] * x[None, i : i + 512]).min(axis=1))
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return np.packbits((least >> np.uint32(31)).astype(np.uint8)).tobytes()


def band_keys(found: np.ndarray, bands: int, depth: int) -> np.ndarray:
    """One key for each band of a set of hashes: a hash of the set's smallest values in `depth` orders. None for the empty set.

    Two sets of Jaccard similarity s share one band's key with probability s ** depth.
    """
    if not len(found):
        return np.zeros(0, dtype=np.uint64)
    odd = np.random.default_rng(7).integers(0, 1 << 63, bands * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * depth, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(found), 4096):
        x = found[None, i : i + 4096] * odd[:, None]
        x ^= x >> np.uint64(32)
        x *= odd[::-1, None]
        least = np.minimum(least, x.min(axis=1))
    key = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, depth).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self):
        self.root: list | None = None  # [value, {distance: node}]

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            nxt = node[1].get(d)
            if nxt is None:
                node[1][d] = [value, {}]
                return
            node = nxt

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield at
            if children:
                todo += [c for k, c in children.items() if d - radius <= k <= d + radius]


def shard_links(prints: list[int], own: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that join up what lies within `radius` in one shard: fewer than the prints, never all pairs.

    With `own` (two stripes of a large shard), only pairs of unlike stripes count: one stripe is the tree.
    """
    parent = {p: p for p in prints}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, out = BKTree(), []
    if own is not None:
        for p, s in zip(prints, own, strict=True):
            if s == own[0]:
                tree.add(p)
    for i, p in enumerate(prints):
        if own is None or own[i] != own[0]:
            for q in tree.within(p, radius):
                if (a := top(p)) != (b := top(q)):
                    parent[b] = a
                    out.append((p, q))
            if own is None:
                tree.add(p)
    return out


def _bit_mask(chosen: tuple[int, ...], blocks: int) -> int:
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    mask = sum(((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in chosen)
    return mask - (1 << 64) if mask >= SIGN else mask


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): one row for each row of `docs`; fp holds the 64 bits as a signed number."""

    def run(batches):
        for b in slices(batches, "t"):
            fp = np.array([fingerprint(t, words) for t in b.column("t").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column("i"), pa.array(fp.view(np.int64))], names=["i", "fp"])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"i {slim.schema['i'].dataType.simpleString()}, fp long").withColumnRenamed("i", id_col)


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, most: int = 2000) -> DataFrame:
    """Distinct `prints` (fp) to links (a, b): within `radius` of each other, and enough to connect all that are.

    A shard of more than `most` prints is dealt into stripe pairs (`block_pairs`), so that no task holds it whole.
    """
    masks = [_bit_mask(c, blocks) for c in combinations(range(blocks), blocks - radius)]
    shard: Column = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(shard).alias("shard"))
    dealt = block_pairs(rows, "shard", "fp", most).repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")

    def run(batches):
        for t, at in whole_groups(batches, ["shard", "lo", "hi"]):
            ends = np.append(at[1:], len(t))
            several = np.flatnonzero(ends - at > 1)
            fps, lo, hi, own = (t.column(c).to_numpy() for c in ("fp", "lo", "hi", "own"))
            out = []
            for g in several:
                a, b = at[g], ends[g]
                values = fps[a:b].view(np.uint64).tolist()
                out += shard_links(values, None if lo[a] == hi[a] else own[a:b].tolist(), radius)
            if out:
                pairs = np.array(out, dtype=np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.select("shard", "lo", "hi", "own", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, fp long, component_id) for each row of `docs`.

    Documents are linked if their fingerprints differ in `radius` bits or fewer; component_id is the smallest id that links reach. Null and empty texts have fingerprint 0 and link like any other. Equal
    fingerprints are gathered first, so copies cost one entry. Rows with a null id take part; if all ids of a component
    are null, so is component_id. Repeated ids keep their rows. Other columns are ignored. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, words, id_col, text_col), "prints")
    classes = scratch.write(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    found = components(links(classes.select("fp"), radius, blocks), scratch)
    top = scratch.write(classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("top")), "tops")
    ids = top.groupBy("top").agg(F.min("least").alias("component_id"))
    named = scratch.write(join_dealt(top, ids, "top", "fp").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def candidate_pairs(values: list[int], bits: list[int], sizes: list[int], groups: list[int], own: list[int] | None, radius: int, total: int, threshold: float, spanning: bool) -> list[tuple[int, int]]:
    """Pairs (i, j) of one shard that may be alike: in unlike groups, of sizes that allow the threshold, their SimHash words within
    `radius` (found by BK-tree) and their MinHash bits within `total`. With `spanning` only as many as connect all such
    pairs, the nearest ones of each text first. With `own`, only across the two stripes."""
    parent = {g: g for g in groups}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    largest = max(parent, key=groups.count) if len(parent) < len(groups) / 2 else None
    everyone, outside = (BKTree(), {}), (BKTree(), {})  # all texts put in so far, and those outside the largest group

    def put(i: int) -> None:
        for tree, at in (everyone, outside) if groups[i] != largest else (everyone,):
            if values[i] not in at:
                at[values[i]] = []
                tree.add(values[i])
            at[values[i]].append(i)

    out = []

    def look(i: int) -> None:
        tree, at = outside if groups[i] == largest else everyone  # the largest group's texts are no pairs of each other
        found = []
        for w in tree.within(values[i], radius):
            for j in at[w]:
                few, many = sorted((sizes[i], sizes[j]))
                if groups[i] != groups[j] and few >= threshold * many:
                    far = (bits[i] ^ bits[j]).bit_count()
                    if far <= total:
                        found.append((far, j))
        if not spanning:
            out.extend((i, j) for _, j in found)
            return
        for _, j in sorted(found):
            a, b = top(groups[i]), top(groups[j])
            if a != b:
                parent[a] = b
                out.append((i, j))

    if own is None:
        for i in range(len(values)):
            look(i)
            put(i)
    else:
        for i, s in enumerate(own):
            if s == own[0]:
                put(i)
        for i, s in enumerate(own):
            if s != own[0]:
                look(i)
    return out


def shared_shards(nodes: DataFrame) -> DataFrame:
    """(shard, node) of all `bands` that two or more `nodes` (node, bands) have."""
    each = nodes.select("node", F.explode("bands").alias("shard"))
    return each.join(each.groupBy("shard").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("shard"), "shard").select("shard", "node")


def candidates(members: DataFrame, nodes: DataFrame, radius: int, total: int, threshold: float, spanning: bool, most: int, turn: int = 0) -> DataFrame:
    """(a, b) with a < b, each once: `candidate_pairs` of all shards. members: shard, node. nodes: node, comp, n, w, m. `turn` reverses the order in shards if odd.

    After the first turn only shards with texts of unlike components are dealt. Where all pairs are wanted, each comes from the least of the shards
    that its texts share, so that the others make no row of it.
    """
    if turn:
        mixed_ones = members.join(nodes.select("node", "comp"), "node").groupBy("shard").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("shard")
        members = members.join(mixed_ones, "shard", "left_semi")
    rows = members.join(nodes.select("node", "comp", "n", "w", "m"), "node")
    if not spanning:
        rows = rows.join(members.groupBy("node").agg(F.collect_list("shard").alias("shards")), "node")  # `bands` at most
    mixed = F.xxhash64("shard", "node")
    dealt = block_pairs(rows, "shard", "node", most).repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi", mixed.desc() if turn % 2 else mixed.asc())

    def run(batches):
        for t, at in whole_groups(batches, ["shard", "lo", "hi"]):
            ends = np.append(at[1:], len(t))
            node, lo, hi, own, comp, n, w = (t.column(x).to_numpy() for x in ("node", "lo", "hi", "own", "comp", "n", "w"))
            bits = t.column("m")
            out = []
            for g in np.flatnonzero(ends - at > 1):
                x, y = at[g], ends[g]
                if (comp[x:y] == comp[x]).all():
                    continue
                values, near = w[x:y].view(np.uint64).tolist(), [int.from_bytes(m) for m in bits.slice(x, y - x).to_pylist()]
                found = candidate_pairs(values, near, n[x:y].tolist(), comp[x:y].tolist(), None if lo[x] == hi[x] else own[x:y].tolist(), radius, total, threshold, spanning)
                if not spanning:
                    here, shared = int(t.column("shard")[x].as_py()), [set(s) for s in t.column("shards").slice(x, y - x).to_pylist()]
                    found = [(i, j) for i, j in found if min(shared[i] & shared[j]) == here]
                out += [(node[x + i], node[x + j]) for i, j in found]
            if out:
                pairs = np.sort(np.array(out, dtype=np.int64), axis=1)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.select("shard", "lo", "hi", "own", "node", "comp", "n", "w", "m", *([] if spanning else ["shards"])).mapInArrow(run, "a long, b long").distinct()


def alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) whose `sets` (node, found array<long> without repeats) have a Jaccard similarity of `threshold` or more."""
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    return joined.where(both >= threshold * (F.size("x") + F.size("y") - both)).select("a", "b")


def similar(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 20, depth: int = 6, radius: int = 22, total: int = 106, most: int = 2000, forests: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) by texts whose sets of `words`-word shingles have a Jaccard similarity of `threshold` or more.

    Texts of one shingle set are one node. Nodes meet in a shard where one of `bands` bands agrees; a BK-tree of SimHash words
    finds what lies within `radius` there, and a pair of at most `total` unlike MinHash bits (of 768; at a similarity of 0.8 the mean
    is 77 and the deviation 8.3) is a candidate. A candidate becomes a link only if the shingle sets themselves are alike enough. In the first `forests`
    rounds only as many candidates are measured as connect the others, the nearest ones; in the last, all that still stand between unlike
    components, so that no candidate is left out. A pair at 0.8 is a candidate with a probability of 0.997. Nulls, empty tables and repeats as
    in `near_duplicates`. Shards of more than `most` nodes are dealt into stripe pairs.
    """
    scratch = Scratch(docs.sparkSession, "similar")

    def printed(batches):
        import xxhash

        for b in slices(batches, "t"):
            sets = [shingles(t, words) for t in b.column("t").to_pylist()]
            prints = np.array([set_fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            keys = [band_keys(s, bands, depth).view(np.int64) for s in sets]
            yield pa.record_batch([b.column("i"), b.column("h"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.array([minhash_bits(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["i", "h", "node", "n", "w", "m", "bands"])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    kind = slim.schema["i"].dataType.simpleString()
    prints = scratch.write(slim.mapInArrow(printed, f"i {kind}, h long, node long, n long, w long, m binary, bands array<long>"), "prints")
    names = ["h", "n", "w", "m", "bands"]
    classes = scratch.write(prints.groupBy("node").agg(F.min("i").alias("least"), *(F.min(c).alias(c) for c in names)), "classes")
    members = scratch.write(shared_shards(classes), "members")
    met = scratch.write(classes.drop("bands").join(members.select("node").distinct(), "node", "left_semi"), "met")  # no other sets are needed

    def listed(batches):
        for b in slices(batches, "t"):
            yield pa.record_batch([b.column("node"), pa.array([shingles(t, words).view(np.int64) for t in b.column("t").to_pylist()], pa.list_(pa.int64()))], names=["node", "found"])

    texts = slim.select("t", "h").join(met.select("h", "node"), "h").select("node", "t").dropDuplicates(["node"])
    sets = scratch.write(texts.mapInArrow(listed, "node long, found array<long>"), "sets")
    now, measured, linked = met.withColumn("comp", F.col("node")), None, None
    for turn in range(forests + 1):
        met_now = scratch.write(candidates(members, now, radius, total, threshold, turn < forests, most, turn), "candidates")
        if linked is not None and met_now.isEmpty():
            break
        pairs = met_now if measured is None else scratch.write(met_now.join(measured, ["a", "b"], "left_anti"), "pairs")
        new = scratch.write(alike(pairs, sets, threshold), "linked")
        measured, linked = (pairs, new) if measured is None else (measured.union(pairs), linked.union(new))
        found = scratch.write(components(linked, scratch), "found")
        now = scratch.write(met.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"), "now")
    top = scratch.write(classes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("top")), "tops")
    named = scratch.write(join_dealt(top, top.groupBy("top").agg(F.min("least").alias("component_id")), "top", "node").select("node", "component_id"), "named")
    return prints.select(F.col("i").alias(id_col), "node").join(named, "node").select(id_col, "component_id")


def keep_one(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates (`similar`): of each component, one row with the smallest id stays, whole.

    A null id counts as smaller than any other. Rows of one id but unlike texts are documents of their own; of rows alike
    in both, one stays.
    """
    slim = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).alias("key"), F.col(text_col).alias("t"))
    kept = similar(slim, words, id_col="key", text_col="t").where("key = component_id")
    kept = Scratch(docs.sparkSession, "simhash").write(kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key.id", "key.text", "n"), "kept")

    def among(some):
        s = some.select(F.col("id").alias("_kept_id"), F.col("text").alias("_kept_text"))
        return docs.join(s, F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.xxhash64(text_col) == F.col("_kept_text")), "left_semi")

    return among(kept.where("n = 1")).union(among(kept.where("n > 1")).dropDuplicates([id_col, text_col]))
