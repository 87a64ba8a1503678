"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is the logistic of a bias and the weights of its words and word
beginnings (of 3, 4 and 5 letters, so that inflected forms share a weight); a document's
is the noisy-or of its sentences, 1 - prod(1 - s). Only document labels are known; the
gradient of their likelihood reaches the sentences through the noisy-or. Training:

1. A bounded sample of labelled documents (a hash of the id picks ``fit_docs`` at most).
2. Words and beginnings counted per label over the sample; those clearly commoner in
   documents of label 1 (two-proportion z of at least ``min_z``, ``min_lift`` times the
   share) become features, ``max_words`` at most.
3. The sample's sentences become lists of feature ids, written once. Training goes in
   ``rounds`` of parameter mixing, one Spark job each: every partition takes ``steps`` Adam
   steps on its own documents from the shared weights, and the mean of the partitions'
   weights starts the next round. Documents of label 1 count ``positive`` times.

The trained model then scores every whole text and locates its offending sentences (score
of at least ``sentence_cut``) by index and character span.

Results: a null text counts as empty; a text without sentences scores 0; without usable
labels every score is 0; repeated rows keep their rows, and a document labelled twice counts
once with its larger label; a row without doc_id is scored, but never learned from; a text of
any length is scored as a whole; sentences that tie with ``sentence_cut`` are located; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import bounded, chunks, id_remainder, per_text, save

FIT_DOCS, MAX_WORDS, ROUNDS, STEPS, PARTS = 30_000, 4096, 8, 12, 4
SENTENCE = re.compile(r"[^.!?\n]*\w[^.!?\n]*")
WORD = re.compile(r"\w+").findall
BEGINNINGS, CACHE = (3, 4, 5), 400_000


def features(words) -> set[str]:
    """The words and, marked with a star, their beginnings."""
    own = set(words)
    for k in BEGINNINGS:
        own |= {w[:k] + "*" for w in words if len(w) >= k}
    return own


def softplus(z):
    return np.logaddexp(0, z)


def sigmoid(z):
    return np.exp(-softplus(-z))


class _Ids(dict):
    """Word -> its feature ids, worked out once per word."""

    def __init__(self, names):
        super().__init__()
        self.names = names

    def __missing__(self, word):
        self[word] = out = [self.names[f] for f in features([word]) if f in self.names]
        return out


class Model:
    def __init__(self, words: list[str], weight: np.ndarray, bias: float):
        self.words, self.weight, self.bias = {w: i for i, w in enumerate(words)}, weight, bias
        self.ids = _Ids(self.words)

    def __reduce__(self):
        return Model, (list(self.words), self.weight, self.bias)

    def sentences(self, text: str) -> tuple[int, list[tuple[int, int, int, list[int]]]]:
        """How many sentences hold no feature, and (index, start, end, feature ids) of the others."""
        own = self.ids
        if len(own) > CACHE:
            own.clear()
        if not any(map(own.__getitem__, set(WORD(text.lower())))):
            return len(SENTENCE.findall(text)), []
        found, n = [], 0
        for n, m in enumerate(SENTENCE.finditer(text), 1):
            ids = {i for w in WORD(m[0].lower()) for i in own[w]}
            if ids:
                found.append((n - 1, m.start(), m.end(), sorted(ids)))
        return n - len(found), found

    def score(self, text: str, sentence_cut: float) -> tuple[float, int, list[dict]]:
        """Document score, number of sentences, offending sentences."""
        plain, found = self.sentences(text)
        z = np.array([self.bias + self.weight[ids].sum() for _, _, _, ids in found])
        total = plain * softplus(self.bias) + softplus(z).sum()
        bad = [{"index": i, "start": a, "end": b, "score": float(s)}
               for (i, a, b, _), s in zip(found, sigmoid(z)) if s >= sentence_cut]
        return float(-np.expm1(-total)) if plain + len(found) and len(self.words) else 0.0, plain + len(found), bad


def fit(docs: DataFrame, labels: DataFrame, label: str, fit_docs: int = FIT_DOCS, max_words: int = MAX_WORDS,
        min_z: float = 4.0, min_lift: float = 3.0, positive: float = 3.0,
        rounds: int = ROUNDS, steps: int = STEPS, rate: float = 0.5, decay: float = 1e-4) -> Model:
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    sample = bounded(marked, "doc_id", fit_docs)     # at most fit_docs ids, so safe to broadcast
    rows = save(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
                .select("text", "y").where("text is not null"), "toxic")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    n, pos = size["n"], size["pos"] or 0
    if not pos or pos == n:
        return Model([], np.zeros(0), -20.0)

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(frames, 4_000_000):
            seen = [Counter(), Counter()]
            for t, y in zip(pdf["text"], pdf["y"]):
                seen[int(y)].update(features(set(WORD(t.lower()))))
            w = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": w, "neg": [seen[0][x] for x in w], "pos": [seen[1][x] for x in w]})

    counted = rows.mapInPandas(words, "word string, neg long, pos long").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    p1, p0, p = F.col("pos") / pos, F.col("neg") / (n - pos), (F.col("pos") + F.col("neg")) / n
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / pos + 1 / (n - pos)) + 1e-12)
    best = (counted.where("pos >= 3").withColumn("z", z).where((F.col("z") >= min_z) & (p1 >= min_lift * p0))
            .orderBy(F.desc("z"), "word").limit(max_words).toPandas())
    odds = np.log((best["pos"] + 0.5) / (pos + 1)) - np.log((best["neg"] + 0.5) / (n - pos + 1))
    model = Model(best["word"].tolist(), np.clip(odds.to_numpy(dtype=np.float64), -4, 4), -6.0)
    if not len(model.words):
        return Model([], np.zeros(0), -20.0)
    shared = spark.sparkContext.broadcast(model)

    def instances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = [shared.value.sentences(t) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "plain": [a for a, _ in own], "sizes": [[len(x[3]) for x in b] for _, b in own],
                                "ids": [[i for x in b for i in x[3]] for _, b in own]})

    bags = save(rows.mapInPandas(instances, "y double, plain long, sizes array<int>, ids array<int>"), "bags")
    # Texts of label 0 without features act on the bias alone, through their number of sentences.
    bare = (F.col("y") == 0) & (F.size("ids") == 0)
    rest = bags.where(bare).agg(F.sum("plain")).first()[0] or 0
    bags = bags.where(~bare).coalesce(PARTS)
    theta = np.concatenate([model.weight, [model.bias]])

    def mix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat([pd.DataFrame(columns=["y", "plain", "sizes", "ids"]), *frames])
        if len(own):
            grad = loss_gradient(own, rest * len(own) / left, positive)
            t, m1, m2 = theta.copy(), np.zeros_like(theta), np.zeros_like(theta)
            for step in range(1, steps + 1):
                g = grad(t) / (n * len(own) / left) + decay * np.concatenate([t[:-1], [0.0]])
                m1, m2 = 0.8 * m1 + 0.2 * g, 0.95 * m2 + 0.05 * g ** 2
                t = t - rate * (m1 / (1 - 0.8 ** step)) / (np.sqrt(m2 / (1 - 0.95 ** step)) + 1e-8)
            yield pd.DataFrame({"t": [t.tobytes()], "n": [len(own)]})

    left = bags.count()
    for _ in range(rounds):
        parts = bags.mapInPandas(mix, "t binary, n long").collect()      # PARTS rows at the most
        theta = sum(r["n"] * np.frombuffer(bytes(r["t"])) for r in parts) / sum(r["n"] for r in parts)
        rate *= 0.7
    return Model(best["word"].tolist(), theta[:-1], float(theta[-1]))


def loss_gradient(bags: pd.DataFrame, rest: float, positive: float):
    """The gradient, as a function of the weights (bias last), of these documents' negative
    log-likelihood; ``rest`` more sentences belong to documents of label 0."""
    y, plain = bags["y"].to_numpy(dtype=np.float64), bags["plain"].to_numpy(dtype=np.float64)
    none = np.zeros(0, dtype=np.int64)
    sizes = [np.asarray(x, dtype=np.int64) for x in bags["sizes"]]
    sent = np.concatenate([none, *sizes])
    ids = np.concatenate([none, *[np.asarray(x, dtype=np.int64) for x in bags["ids"]]])
    of = np.repeat(np.arange(len(sent)), sent)
    bag = np.repeat(np.arange(len(y)), [len(x) for x in sizes])

    def gradient(theta: np.ndarray) -> np.ndarray:
        z = theta[-1] + np.bincount(of, weights=theta[ids], minlength=len(sent))
        total = plain * softplus(theta[-1]) + np.bincount(bag, weights=softplus(z), minlength=len(y))
        outer = np.where(y > 0, -positive / np.expm1(np.clip(total, 1e-9, 500)), 1.0)     # d loss / d total
        inner = outer[bag] * sigmoid(z)
        slope = sigmoid(theta[-1])
        return np.append(np.bincount(ids, weights=inner[of], minlength=len(theta) - 1),
                         inner.sum() + (outer * plain).sum() * slope + rest * slope)
    return gradient


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1,
             cut: float = 0.7, sentence_cut: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo ``folds`` is ``held``), score, predicted,
    n_sentences, offending (array of index, start, end, score). Learns only from labels of
    the other rows."""
    model = fit(docs.where(id_remainder(folds) != held), labels.where(id_remainder(folds) != held), label, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            own = [shared.value.score(t or "", sentence_cut) for t in texts]
            return {"score": [x[0] for x in own], "predicted": np.array([x[0] >= cut for x in own], dtype=np.int32),
                    "n_sentences": [x[1] for x in own], "offending": [x[2] for x in own]}
        return work

    return per_text(docs, ["doc_id", (id_remainder(folds) == held).alias("held_out")], make,
                    "score double, predicted int, n_sentences long, "
                    "offending array<struct<index: int, start: int, end: int, score: double>>")
