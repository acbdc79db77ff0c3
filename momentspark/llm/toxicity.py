"""Toxicity (dealt operator 1): a linear classifier trained by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other training text, labelled or not, is unlabelled. The risk of a score
function f with class prior p is p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)]), the second term being the risk
on the negatives hidden in the unlabelled text (Kiryo et al., 2017), which counts as zero where its estimate is below. l is the logistic loss, so the sigmoid of f estimates the share of toxic text at a point.

Features of a document are the words it has, the first 4, 5 and 6 characters of its longer words (compounds of one stem share
these), and which of those beginnings two and three or more of its words share: a stem that stands in a text now and then by
chance is no sign, several words of one stem are. Spark counts, over all distinct training texts and all distinct positives, in
how many texts each feature stands; those much more frequent among the positives than elsewhere become the model's vocabulary, of a
bounded size. Gradient steps take a bounded sample; a feature that no sampled positive has gets its weight from the counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¿¡«»„“”‘’"
BEGINNINGS, LONGEST = (4, 5, 6), 40


def features_of_word(word: str) -> tuple[str, ...]:
    """Of a word in lower case: itself (`=word`, up to 40 characters) and its first characters (`4...`, `5...`, `6...`), where it has more."""
    whole = ("=" + word,) if 0 < len(word) <= LONGEST else ()
    return whole + tuple(f"{k}{word[:k]}" for k in BEGINNINGS if len(word) > k)


class Words(dict):
    """From a word as it stands in a text to (the word without signs at its ends, its features among `wanted`), or None if it has none.
    Keeps those of words met before."""

    def __init__(self, wanted: Collection[str] | None = None, most: int = 150_000):
        super().__init__()
        self.wanted, self.most = None if wanted is None else {f: f for f in wanted}, most  # one copy of each name

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(EDGE)
        found = features_of_word(bare)
        if self.wanted is not None:
            found = tuple(self.wanted[f] for f in found if f in self.wanted)
        self[word] = out = (bare, found) if found else None
        return out


def features(text: str | None, words: Words) -> set[str]:
    """The set of features of a whole text; `f#2` and `f#3`: two, three or more of its words have the beginning f."""
    met = set(map(words.__getitem__, set((text or "").lower().split())))
    met.discard(None)
    n = Counter(chain.from_iterable(found for _, found in met))
    out = set(n)
    for f, k in n.items():
        if k > 1:
            out.add(f + "#2")
            if k > 2:
                out.add(f + "#3")
    return out


def base(feature: str) -> str:
    """The feature of a word behind a count of words."""
    return feature[:-2] if feature[-2:] in ("#2", "#3") else feature


def implied(feature: str) -> list[str]:
    """The other features that a text has whenever it has this one."""
    plain, n = base(feature), int(feature[-1]) if feature != base(feature) else 1
    shorter = [f"{m}{plain[1 : m + 1]}" for m in BEGINNINGS if m < len(plain) - 1]
    return [plain + suffix for suffix in ("", "#2")[: n - 1]] + [s + suffix for s in shorter for suffix in ("", "#2", "#3")[:n]]


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, found: set[str]) -> float:
        z = self.bias + math.fsum(self.weights[f] for f in found & self.weights.keys())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, rounds: int = 800, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) from 0/1 rows of positives and of unlabelled text, by Adam over whole passes.

    Features are chosen as signs of toxic text, so their weights are kept at zero or above.
    """
    n_features = pos.shape[1]
    (pr, pc), (ur, uc) = np.nonzero(pos), np.nonzero(unl)
    w = np.zeros(n_features + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    scores = lambda r, c, n: np.bincount(r, w[c], n) + w[-1]
    mean_of = lambda g, r, c: np.append(np.bincount(c, g[r], n_features), g.sum()) / len(g)
    for t in range(1, rounds + 1):
        fp, fu = scores(pr, pc, len(pos)), scores(ur, uc, len(unl))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        toxic = sigmoid(fp)
        grad = -prior * mean_of(1 - toxic, pr, pc) + decay * np.append(w[:-1], 0)
        if negative >= 0:
            grad += mean_of(sigmoid(fu), ur, uc) - prior * mean_of(toxic, pr, pc)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def text_counts(texts: DataFrame, most: int = 200_000, wanted: Broadcast | None = None) -> DataFrame:
    """(f, n): in how many of the distinct `texts` (t, h) each feature stands (with `wanted`, a set of features of words, those and
    their counts of words). Copies go in their task, then in that of their hash."""

    def once(batches):
        done: set[int] = set()
        for b in batches:
            keep = []
            for h in b.column("h").to_pylist():
                keep.append(h not in done)
                done.add(h)
            yield b.filter(pa.array(keep, pa.bool_()))

    def count(batches):
        words, n = Words(wanted.value if wanted else None), Counter()

        def out():
            return pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["f", "n"])

        for b in once(batches):
            for part in slices([b], "t"):
                for t in part.column("t").to_pylist():
                    n.update(features(t, words))
                    if len(n) > most:
                        yield out()
                        n.clear()
        yield out()

    apart = texts.select("t", "h").mapInArrow(once, "t string, h long").repartition("h")
    return apart.mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame, labels: DataFrame, most_positives: int = 4000, most_unlabelled: int = 8000, most_features: int = 2000, least: int = 3, most_shared: int = 300_000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model | None:
    """Trains on the documents whose crc32(id as text) mod 3 is not 1. None if no positive or no other text is left.

    The vocabulary is counted by Spark over all training texts (each text once), from features of `least` positives or more. Where more
    than `most_features` are signs of toxic text, the surest stay. The sample that comes to the driver is bounded: the `most_positives`
    positives and the `most_unlabelled` training texts of any kind with the smallest hash of their text, as rows of at most
    `most_features` numbers. The class prior is the share of toxic rows among the labelled training rows whose text is in `docs`.
    Up to `most_shared` positives' ids and candidate features are broadcast; where there are more, they are joined.
    Labels that are null or of unknown documents count for nothing; a document labelled twice is toxic if any label says so.
    """
    context = docs.sparkSession.sparkContext
    training = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    texts = docs.where(F.col(text_col).isNotNull() & (F.col(id_col).isNull() | training)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    joined = scratch.write(texts.select("i", "h").join(known, "i", "left"), "joined")
    total = joined.where("y is not null").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    if not total["n"] or not total["p"]:
        scratch.clear()
        return None
    prior = min(0.9, total["p"] / total["n"])
    hashes = scratch.write(joined.groupBy("h").agg(F.max(F.coalesce("y", F.lit(0))).alias("y")), "hashes")
    sizes = hashes.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    n_pos, n_unl = sizes["p"], sizes["n"]

    marked = joined.where("y = 1").select("i").distinct()
    if total["p"] <= most_shared:
        marked = F.broadcast(marked)
    of_positives = scratch.write(text_counts(texts.join(marked, "i", "left_semi")).where(F.col("n") >= min(least, n_pos)).withColumnRenamed("n", "p"), "of_positives")
    n_candidates = of_positives.count()
    wanted = context.broadcast({base(r["f"]) for r in of_positives.select("f").collect()}) if n_candidates <= most_shared else None
    counted = scratch.write(of_positives.join(text_counts(texts, wanted=wanted).withColumnRenamed("n", "u"), "f"), "counted")
    usual = n_pos * (F.col("u") + 1) / n_unl  # positives with the feature if it stood in them as often as in any text
    surprise = F.col("p") * F.log(F.col("p") / usual) - (F.col("p") - usual)  # chance exceeds it about once among exp(surprise) features
    sure = (F.col("p") >= 0.4 / prior * usual) & (surprise >= math.log(max(1, n_candidates)))
    best = counted.where(sure).orderBy(F.desc(surprise), "f").limit(most_features).select("f", "p", "u").collect()
    vocabulary = {r["f"]: k for k, r in enumerate(best)}
    if not vocabulary:
        scratch.clear()
        return Model({}, math.log(prior / (1 - prior)), prior)

    mixed = F.xxhash64(F.lit("sample"), "h")
    drawn = lambda rows, n: [r[0] for r in rows.orderBy(mixed, "h").limit(n).select("h").collect()]
    positives, unlabelled = drawn(hashes.where("y = 1"), most_positives), drawn(hashes, most_unlabelled)
    marks = dict.fromkeys(positives, 1)
    marks |= {h: 3 if h in marks else 2 for h in unlabelled}  # 1: positive, 2: unlabelled, 3: both
    shared = context.broadcast((marks, vocabulary))  # at most most_positives + most_unlabelled numbers, most_features words

    def sample(batches):
        (marked, at), done = shared.value, set()
        words = Words({base(f) for f in at})
        for b in batches:
            h = b.column("h").to_pylist()
            for k in [k for k, x in enumerate(h) if x in marked and x not in done]:
                if h[k] not in done:  # no copy
                    done.add(h[k])
                    found = sorted(at[f] for f in features(b.column("t")[k].as_py(), words) if f in at)
                    yield pa.record_batch([pa.array([h[k]]), pa.array([marked[h[k]]], pa.int32()), pa.array([found], pa.list_(pa.int32()))], names=["h", "mark", "found"])

    rows = texts.select("t", "h").mapInArrow(sample, "h long, mark int, found array<int>").dropDuplicates(["h"]).orderBy("h").collect()
    scratch.clear()

    def matrix(kept):
        out = np.zeros((len(kept), len(vocabulary)), dtype=bool)
        for k, r in enumerate(kept):
            out[k, r["found"]] = True
        return out

    toxic = matrix([r for r in rows if r["mark"] % 2 == 1])
    w = train_nnpu(toxic, matrix([r for r in rows if r["mark"] >= 2]), prior)
    # No gradient: the share of toxic text among texts with the feature, by the counts. What it implies stands in the same texts and comes before it in this order.
    for f, k in sorted(((f, k) for f, k in vocabulary.items() if not toxic[:, k].any()), key=lambda x: (len(implied(x[0])), x)):
        share = min(0.98, prior * (best[k]["p"] / n_pos) / ((best[k]["u"] + 1) / n_unl))
        w[k] = max(0.0, math.log(share / (1 - share)) - w[-1] - math.fsum(w[vocabulary[x]] for x in implied(f) if x in vocabulary))
    return Model({f: float(w[k]) for f, k in vocabulary.items()}, float(w[-1]), prior)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double) for each row, from its whole text alone. Null and empty texts get the score of no feature.
    Without a model all scores are 0. The model is broadcast; its size is bounded by the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(model or Model({}, -30.0, 0.0))

    def run(batches):
        m = shared.value
        words = Words({base(f) for f in m.weights})
        for b in slices(batches, "t"):
            out = [m.score(features(t, words)) for t in b.column("t").to_pylist()]
            yield pa.record_batch([b.column("i"), pa.array(out, pa.float64())], names=["i", "score"])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"i {slim.schema['i'].dataType.simpleString()}, score double").withColumnRenamed("i", id_col)


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores below `threshold`, with the columns of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model or Model({}, -30.0, 0.0))

    def run(batches):
        m = shared.value
        words = Words({base(f) for f in m.weights})
        for b in slices(batches, text_col):
            keep = [m.score(features(t, words)) < threshold for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
