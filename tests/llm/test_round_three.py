"""Operators 11 to 13 against plain versions, with nulls, ties, repeated rows, long texts, extra columns and empty tables."""

import hashlib
import random
import re

import numpy as np

from momentspark.llm import centroids, conversations, merkle

SEED = random.Random(7)


# ---- 11


def plain_tree(text):
    leaves, paragraphs, sections, now = {}, [], [], []
    for q in re.findall(r"[^\n]*\n|[^\n]+", text):
        marks = []
        for x in re.findall(merkle.PHRASE, q):
            h = hashlib.md5(x.encode()).hexdigest()
            marks.append(h + str(len(x)))
            leaves[int(h[:10], 16) * 2**20 + len(x)] = len(x)
        h = hashlib.md5("".join(marks).encode()).hexdigest()
        paragraphs.append(h)
        if q[0] == "\n" or h[0] < "2":
            sections.append(",".join([*now, h]))
            now = []
        else:
            now.append(h)
    if now:
        sections.append(",".join(now) + ",")
    return hashlib.sha256("".join(hashlib.md5(s.encode()).hexdigest() for s in sections).encode()).hexdigest(), leaves


def plain_like(a, b):
    total = sum(a.values()) + sum(b.values())
    return 2 * sum(n for k, n in a.items() if k in b) / total if total else 1.0


def test_fingerprints_are_those_of_a_plain_tree(spark):
    words = ["alpha", "bèta,", "γάμμα.", "delta\n", "\n\n", "ε!?", "zeta;", "𝔘nicode:", "plain " * 30]
    texts = [" ".join(SEED.choices(words, k=SEED.randint(0, 40))) for _ in range(60)] + ["", None, "\n", "\n\n\n", "a", "ab", "abc", "abcd", "x" * 200_000, "word. " * 30_000]
    rows = [(k, t, "extra", 1) for k, t in enumerate(texts)] + [(None, "no id", "e", 1), (None, None, "e", 1), (3, texts[3], "e", 1), (3, texts[3], "e", 1), (4, "another text of id 4", "e", 1)]
    got = merkle.edits_and_neighbours(spark.createDataFrame(rows, "doc_id int, text string, k string, root int")).collect()
    order = sorted(((-1 if i is None else i), hashlib.md5(f"{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).digest(), t or "", i) for i, t, _, _ in rows)
    want = []
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        text, after, n = a[2], b[2], len(a[2]) // 4
        edited = text[: len(text) - n] + after[:n]
        (root, leaves), (e_root, e_leaves), (_, n_leaves) = plain_tree(text), plain_tree(edited), plain_tree(after)
        want.append((str(a[3]), len(text), hashlib.sha256(edited.encode()).hexdigest(), root, e_root, plain_like(leaves, e_leaves), plain_like(leaves, n_leaves)))
    assert sorted((str(r["doc_id"]), *r[1:7]) for r in got) == sorted(want)
    assert all((r["n_changed"] == 0) == (r["fingerprint"] == r["edited_fingerprint"]) for r in got if r["n_chars"] > 500)


def test_one_document_and_none(spark):
    one = merkle.edits_and_neighbours(spark.createDataFrame([(1, "One text. Of two phrases.")], "doc_id int, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"One text. Of two phOne te").hexdigest()
    assert merkle.edits_and_neighbours(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_differing_branches_locate_an_edit(spark):
    lines = [f"Line {k} of a text. It has two phrases.\n" for k in range(40)]
    edited = [*lines[:11], "Line 11 is another.\n", *lines[12:]]
    df = spark.createDataFrame([("".join(lines), "".join(edited))], "a string, b string")
    df = merkle.with_tree(merkle.with_tree(df, "a", "a_"), "b", "b_")
    r = df.select("a_sections", "a_paragraphs", merkle.differing(df["a_sections"], df["b_sections"]).alias("d")).first()
    assert len(r["d"]) == 1
    at = sum(s.rstrip(",").count(",") + 1 for s in r["a_sections"][: r["d"][0]["section"]]) + r["d"][0]["paragraph"]
    assert at == 11 and len(r["a_paragraphs"]) == 40


# ---- 12


def plain_repair(turns, must_go, truncated):
    """All audits, by a table over rows and states."""
    far = (1 << 60, "")
    best = {(0, 0): (0, "")}
    put = lambda k, c, a: best.__setitem__(k, min(best.get(k, far), (c, a)))
    for i in range(len(turns) + 1):
        for _ in range(3):
            for s in range(4):
                if (i, s) in best:
                    c, a = best[i, s]
                    put((i, 3 if s == 2 else 2), c + 5, a + "I")
        for s in range(4) if i < len(turns) else ():
            if (i, s) in best:
                c, a = best[i, s]
                put((i + 1, s), c + 2, a + "D")
                if not must_go[i]:
                    due, to, c = ("a", 3, c) if s == 2 else ("u", 2, c)
                    c += 5 * truncated[i]
                    put((i + 1, to), c + (turns[i] != due), a + ("K" if turns[i] == due else "R"))
                    if turns[i] == "s" and s == 0:
                        put((i + 1, 1), c, a + "K")
    return min(best.get((len(turns), s), far) for s in (0, 3))


def feed(roles, must_go, truncated):
    one = conversations.Repair(1)
    for k, (r, m, t) in enumerate(zip(roles, must_go, truncated, strict=True)):
        one.add(k, r, f"{k}" if t else f"{k}.", m, not t)
    return one.row()


def test_repairs_are_the_cheapest(monkeypatch):
    for block in (512, 3, 1):
        monkeypatch.setattr(conversations, "BLOCK", block)
        for _ in range(1500):
            n = SEED.randint(0, 15)
            roles, must_go, truncated = [SEED.choice("uasstx") for _ in range(n)], [SEED.random() < 0.2 for _ in range(n)], [SEED.random() < 0.2 for _ in range(n)]
            row = feed(roles, must_go, truncated)
            assert (row["cost"], row["audit"]) == plain_repair(roles, must_go, truncated)
            kept = [("s" if e == "K" and r == "s" else "?") for e, r in zip([e for e in row["audit"] if e != "I"], roles, strict=True) if e != "D"]
            assert kept.count("s") <= 1


def test_long_conversations_take_blocks(spark):
    n = 3000
    roles = [SEED.choice(["user", "assistant", "system", "tool", ""]) for _ in range(n)]
    rows = [(7, k, roles[k], f"text {k}" + SEED.choice([".", "?", "", " "]), True) for k in range(n)]
    got = conversations.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, there boolean")).first()
    assert (got["cost"], got["audit"]) == plain_repair([r[:1] for r in roles], [False] * n, [r[3].rstrip()[-1] not in ".?" for r in rows])
    out = "\n".join(f"{r}:{t}" for r, t in conversations.apply([conversations.Turn(r[2][:1], False, False, r[2], r[3]) for r in rows], 0, got["audit"]))
    assert got["repaired_sha256"] == hashlib.sha256(out.encode()).hexdigest()


def test_faults_nulls_ties_and_conversations_without_rows(spark):
    rows = [
        (1, 0, "user", "Hi.", True, 9), (1, 0, "user", "Hi.", True, 9), (1, 3, "assistant", "Yes", True, 9), (1, 4, None, None, True, 9), (1, None, "user", "\t\n", True, 9),
        (2, 5, "user", "gone.", False, 9), (None, None, None, "x?", True, 9), (4, -(2**63), "user", "a.", True, 9), (4, 2**63 - 1, "assistant", "b.", True, 9),
    ]
    got = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(rows, "conv_id int, turn long, role string, text string, there boolean, audit int")).collect()}
    assert len(got) == 4
    r = got[1]
    assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == (2, 2, 1, 1, 3)
    assert (r["cost"], r["audit"]) == (10, "DDDDD")
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[None]["truncated"] == 0 and got[None]["audit"] == "D"
    assert got[4]["audit"] == "KK" and got[4]["repaired_sha256"] == hashlib.sha256(b"user:a.\nassistant:b.").hexdigest()
    assert conversations.repair(spark.createDataFrame([], "conv_id int, turn long, role string, text string, there boolean")).count() == 0


# ---- 13


def test_the_nearest_centroid_by_the_threshold_algorithm():
    rng = np.random.default_rng(3)
    for n, k, d, spread in ((0, 3, 4, 9), (50, 1, 3, 5), (300, 40, 64, 60), (400, 17, 2, 4), (200, 9, 1, 3), (100, 40, 8, 2**27)):
        x, c = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (k, d))
        c[k // 2 :] = c[: k - k // 2]  # ties
        who, distance = centroids.nearest(x, c)
        exact = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (distance == (exact.min(axis=1) if n else [])).all() and (who == (exact.argmin(axis=1) if n else [])).all()


def plain_clusters(vectors, k, rounds):
    seeds = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"2:{v[0]}".encode()).hexdigest(), v[1]))[:k]
    cent = [list(v) for _, v in seeds]
    find = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        found = [find(v)[1] for _, v in vectors]
        for j in range(len(cent)):
            if own := [v for (_, v), f in zip(vectors, found, strict=True) if f == j]:
                cent[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [find(v) for _, v in vectors]
    each = [sum(d for d, j in last if j == c) for c in range(len(cent))]
    return [(i, j, d, each[j], sum(each), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(vectors, last, strict=True)]


def test_clusters_with_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for k in range(120)]
    good += [(3, good[3][1]), (3, good[3][1]), (None, [0.5, -0.5, 0.0, 1e-9]), (500, [-1e-9, 0.0, -0.0, 2.0])]
    bad = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0]), (905, [float("nan")] * 4), (906, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<float>, cluster string").repartition(5)
    got = sorted((tuple(r) for r in centroids.cluster(df, k=6, rounds=3, dims=4).collect()), key=str)
    assert got == sorted(plain_clusters([(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in good], 6, 3), key=str)
    assert len(centroids.cluster(df.where("vec_id < 3"), k=6, rounds=2, dims=4).collect()) == 3
    huge = centroids.cluster(spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>"), k=1, dims=2).collect()
    assert len(huge) == 2 and all(r["distance"] >= 0 for r in huge)
    assert centroids.cluster(df.where("vec_id > 899"), dims=4).count() == 0
