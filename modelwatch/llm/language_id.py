"""Language identification with bit-sliced n-gram filters.

Training counts letter n-grams (with word edges) per language over a bounded sample of
labelled documents. A language owns an n-gram if it is frequent enough there and its share
is at least ``typical`` of the largest share any language has. One filter serves all
languages: every slot holds a bitmask with one bit per language, an n-gram sets its
owners' bits in ``k`` slots, and the AND of its slots gives all languages that (may) own
it. Per text and language, the bits are counted over the text's n-grams; the filter's own
false-positive rate, known from the fill of each language's bit, is taken out:
(hits / n - rate) / (1 - rate). The largest corrected share decides and is the score.

The filter has a fixed number of slots whatever the corpus, so it is safe to broadcast.

Results: ``und`` with score 0 for a null text or one without letters (and if nothing could
be learned); a text none of whose n-grams is known gets the most frequent training
language and score 0; ties go to the language whose name sorts first; repeated rows and
rows without doc_id keep their rows; a text of any length is read as a whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import SLOTS, chunks, id_remainder, per_text, release, save, slot_of

#: Slots of the filter and hashes per n-gram; letters per n-gram.
SLOT_BITS, HASHES, N = 20, 2, 3
#: Documents per language that the fit reads at the most (a hash of the id picks them).
FIT_DOCS = 20_000
MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
CHARS = 2_000_000


def letter_map() -> np.ndarray:
    """Code point -> itself for letters, 0 for everything else."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32)


def grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and the row that each belongs to.

    Every run of letters is taken with one edge (0) on either side; an n-gram holds no
    edge in its middle and at least two letters.
    """
    raw = [t.lower().encode("utf-32-le", "replace") for t in texts]
    size = np.array([len(r) // 4 for r in raw], dtype=np.int64)
    cp = letters[np.frombuffer(b"\0\0\0\0".join([b"", *raw, b""]), dtype="<u4")]
    row = np.repeat(np.arange(len(texts)), size + 1)
    a, b, c = cp[:-2], cp[1:-1], cp[2:]
    ok = (b != 0) & ((a != 0) | (c != 0))
    h = a[ok] * MULT[0]
    h = (h ^ (h >> np.uint64(31))) + b[ok] * MULT[1]
    h = (h ^ (h >> np.uint64(29))) * MULT[2] + c[ok]
    h = (h ^ (h >> np.uint64(32))) * MULT[3]
    row = np.concatenate([[0], row])[1:-1] if len(cp) > 2 else row[:0]
    return h ^ (h >> np.uint64(30)), row[: len(ok)][ok]


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(shift)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for shift in (0, SLOT_BITS, 2 * SLOT_BITS)[:HASHES]]


class Model:
    def __init__(self, langs: list[str], prior: str | None, table: np.ndarray):
        self.langs, self.prior, self.table = langs, prior, table
        self.letters = None
        fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.rate = np.minimum(fill ** HASHES, 0.999)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not texts:
            return [], np.zeros(0), np.zeros(0, dtype=np.int64)
        if self.letters is None:
            self.letters = letter_map()
        m = len(texts)
        h, row = grams(texts, self.letters)
        total = np.bincount(row, minlength=m)
        hits = np.zeros((max(1, len(self.langs)), m))
        at = slots(h)
        for word in range(self.table.shape[1]):
            mask = self.table[at[0], word]
            for s in at[1:]:
                mask &= self.table[s, word]
            for i in range(64 * word, min(len(self.langs), 64 * word + 64)):
                hits[i] = np.bincount(row, weights=((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.float64), minlength=m)
        rate = self.rate[:, None] if len(self.langs) else np.zeros((1, 1))
        share = np.clip((hits / np.maximum(total, 1) - rate) / (1 - rate), 0, 1)
        best = share.argmax(axis=0)
        score = share[best, np.arange(m)]
        pred = []
        for i, t in enumerate(texts):
            if not self.langs or not (total[i] or any(map(str.isalpha, t))):
                pred.append("und")
            else:
                pred.append(self.langs[best[i]] if score[i] > 0 else self.prior)
        return pred, np.where([p == "und" for p in pred], 0.0, score), total


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, typical: float = 0.5, least: float = 1e-5) -> Model:
    """Learn from the rows of ``docs`` (text, lang; doc_id only picks the bounded sample)."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    width = max(1, -(-len(langs) // 64))
    if not langs:
        return Model([], None, np.zeros((1 << SLOT_BITS, width), dtype=np.uint64))
    cut = F.lit(0)
    for lang, n in sizes.items():
        cut = F.when(F.col("lang") == lang, int(min(1.0, fit_docs / n) * SLOTS)).otherwise(cut)
    sample = docs.where(slot_of("doc_id") < cut).select("text", "lang")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_map()
        for pdf in chunks(frames, CHARS):
            for lang, part in pdf.groupby("lang"):
                gram, n = np.unique(grams(part["text"].tolist(), letters)[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})
        release()

    counts = save(sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(totals), "lang").withColumn("p", F.col("n") / F.col("total"))
    top = share.groupBy("gram").agg(F.max("p").alias("top"))
    owned = share.join(top, "gram").where((F.col("p") >= F.lit(typical) * F.col("top")) & (F.col("p") >= least))

    # One bitmask per slot and 64 languages: at most 2**SLOT_BITS rows reach the driver.
    def to_slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {x: i for i, x in enumerate(langs)}
        for pdf in frames:
            i = pdf["lang"].map(place).to_numpy(dtype=np.int64)
            bit = (np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64)
            for s in slots(pdf["gram"].to_numpy().view(np.uint64)):
                yield pd.DataFrame({"word": i // 64, "slot": s, "mask": bit})

    masks = (owned.select("lang", "gram").mapInPandas(to_slots, "word long, slot long, mask long")
             .groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask")).toPandas())
    table = np.zeros((1 << SLOT_BITS, width), dtype=np.uint64)
    table[masks["slot"].to_numpy(), masks["word"].to_numpy()] = masks["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return Model(langs, max(langs, key=lambda x: sizes[x]), table)


def identify(docs: DataFrame, model: Model, keep: list) -> DataFrame:
    """``keep`` columns of every row with lang_pred, score and n_grams (n-grams in the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            pred, score, n = shared.value.predict([t or "" for t in texts])
            return {"lang_pred": pred, "score": score, "n_grams": n}
        return work

    return per_text(docs, keep, make, "lang_pred string, score double, n_grams long", CHARS)


def accepted(docs: DataFrame, model: Model, least: float = 0.3, sure: int = 20) -> DataFrame:
    """The rows of ``docs`` in a known language: not ``und``, and not a text of at least
    ``sure`` n-grams of which the best language knows a share below ``least``."""
    told = identify(docs, model, [F.struct(*docs.columns).alias("_row"), F.col("text")])
    return told.where((F.col("lang_pred") != "und") & ((F.col("score") >= least) | (F.col("n_grams") < sure))).select("_row.*")


def language_id(docs: DataFrame, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo ``folds`` is ``held``), lang_pred, score.
    Learns only from the other rows with a language."""
    model = fit(docs.where(id_remainder(folds) != held), **options)
    return identify(docs, model, ["doc_id", (id_remainder(folds) == held).alias("held_out")])
