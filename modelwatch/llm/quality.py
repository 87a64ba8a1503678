"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

1. One pass turns every text into a short row of document statistics, written once.
2. Labelled rows give means and deviations; the clipped, standardised statistics go
   through ``features`` random cosines, which approximate a Gaussian kernel.
3. Each partition of the training rows sums its part of the normal equations (X'X, X'y);
   the sums are added up and one small ridge system is solved.
4. A fixed quarter of the training rows is left out of 3 and calibrates: its ridge scores are binned,
   the bins' label means are made monotone (pool adjacent violators) and interpolated.

The fit uses at most ``fit_rows`` labelled rows (picked by a hash of the id); everything
on the driver is bounded by the features and bins.

Results: a null text counts as empty and is scored like any other; without usable labels
every score is 0.5; null labels are not learned from; repeated rows keep their rows, and a
document labelled twice counts once with its larger label; a row without doc_id is scored,
but never learned from; a text of any length is read as a whole; raw scores that tie get one
calibrated score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import bounded, id_remainder, per_text, save, slot_of

FIT_ROWS, FEATURES, RIDGE, BINS, SEED = 100_000, 256, 1.0, 1024, 11
#: Partial sums of the normal equations that reach the driver at the most.
PARTS = 32
GROUPS = [set(range(65, 91)), set(range(97, 123)), set(range(48, 58)), {9, 11, 12, 13, 32}, {10}, set(range(128, 256)),
          set(map(ord, ".,;:'\"()?-")), set(map(ord, "!|#$%&*@_~^=+<>[]{}\\/`"))]
NAMES = ["chars", "words", "word_len", "word_len_sd", "distinct", "top_word", "repeat_next", "odd_next", "entropy",
         "lines", "line_distinct", "line_words", "upper", "lower", "digit", "space", "newline", "wide", "stop", "odd",
         "odd_word", "upper_word"]
CLASS = np.zeros((256, len(GROUPS)))
for _i, _g in enumerate(GROUPS):
    CLASS[list(_g), _i] = 1


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    words, lines = text.split(), text.split("\n")
    n, m = max(1, len(raw)), max(1, len(words))
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = hist[hist > 0] / n
    size = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    seen = Counter(words)
    top = max(seen.values(), default=0)
    same = sum(map(str.__eq__, words, words[1:]))
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:'\")?-" for w in words)
    upper = sum(map(str.isupper, words))
    bare = sum(not w[0].isalnum() for w in words)
    return [np.log1p(len(text)), np.log1p(len(words)), size.mean(), size.std(), len(seen) / m, top / m, same / m, bare / m,
            float(-(share * np.log2(share)).sum()), np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
            np.log1p(len(words) / max(1, len(lines))), *(hist @ CLASS / n)[:8].tolist(), odd / m, upper / m]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one double per statistic."""
    def make():
        def work(texts):
            x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), len(NAMES))
            return {c: x[:, i] for i, c in enumerate(NAMES)}
        return work
    return per_text(docs, ["doc_id"], make, ", ".join(f"{c} double" for c in NAMES))


class Model:
    def __init__(self, mean, sd, features=FEATURES):
        rng = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w, self.b = rng.normal(size=(d, features)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + d + 1)
        self.x = self.y = None

    def design(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -4, 4)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.design(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.x is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)


def pool(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the monotone blocks of bins."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([a / c for a, _, c in blocks]), np.array([b / c for _, b, c in blocks])


def fit(stats: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS, ridge: float = RIDGE) -> Model:
    """Learn ``label`` (0 / 1) from the statistics of the labelled rows."""
    spark = stats.sparkSession
    marked = (labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("double").alias("_y")))
    rows = save(bounded(stats.join(marked, "doc_id"), "doc_id", fit_rows), "fit")
    part = rows.withColumn("_c", F.pmod(slot_of("doc_id"), F.lit(4)) == 0)
    agg = part.agg(*[F.avg(c).alias(f"m_{c}") for c in NAMES], *[F.stddev_pop(c).alias(f"s_{c}") for c in NAMES],
                   F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).first()
    if not agg["n"] or agg["pos"] in (0, agg["n"]):
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model(np.array([agg[f"m_{c}"] for c in NAMES]), np.array([agg[f"s_{c}"] for c in NAMES]))
    size = len(model.beta)
    shared = spark.sparkContext.broadcast(model)

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xx, xy = np.zeros((size, size)), np.zeros(size)
        for pdf in frames:
            x = shared.value.design(pdf[NAMES].to_numpy())
            xx += x.T @ x
            xy += x.T @ pdf["_y"].to_numpy()
        yield pd.DataFrame({"xx": [xx.tobytes()], "xy": [xy.tobytes()]})

    sums = part.where("not _c").coalesce(PARTS).select("_y", *NAMES).mapInPandas(equations, "xx binary, xy binary").collect()
    xx = sum(np.frombuffer(bytes(r["xx"])).reshape(size, size) for r in sums)
    xy = sum(np.frombuffer(bytes(r["xy"])) for r in sums)
    model.beta = np.linalg.solve(xx + ridge * np.eye(size), xy)
    shared = spark.sparkContext.broadcast(model)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            r = shared.value.raw(pdf[NAMES].to_numpy())
            yield pd.DataFrame({"bin": np.clip(((r + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1), "r": r, "y": pdf["_y"].to_numpy()})

    bins = (part.where("_c").select("_y", *NAMES).mapInPandas(scored, "bin long, r double, y double").groupBy("bin")
            .agg(F.avg("r").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin"))
    if len(bins):
        x, y = pool(bins["x"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(dtype=np.float64))
    else:
        x, y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    # A slight slope within flat blocks keeps the order of the ridge scores.
    edge = np.linspace(min(-0.5, x[0]), max(1.5, x[-1]), 65)
    grid = np.unique(np.concatenate([edge, x]))
    model.x, model.y = grid, 0.98 * np.interp(grid, x, y) + 0.02 * (grid - grid[0]) / (grid[-1] - grid[0])
    return model


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2,
            cut: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo ``folds`` is ``held``), score, predicted.
    Learns only from labels of the other rows."""
    stats = save(document_statistics(docs), "statistics")
    model = fit(stats.where(id_remainder(folds) != held), labels, label, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(shared.value.score(x[NAMES].to_numpy()))

    out = stats.select("doc_id", (id_remainder(folds) == held).alias("held_out"), score(F.struct(*NAMES)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
