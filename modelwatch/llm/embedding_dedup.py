"""Embedding near-duplicates by PCA-ordered, tiled comparison.

1. Equal vectors become one class with a count. Unit vectors are turned into the principal
   axes of a bounded sample, so their leading coordinates hold as much as possible.
2. A tree of median cuts along the leading axes (from the same sample) makes cells of
   about ``cell_rows`` classes; a cell that holds more is cut by a hash of the class. Two
   unit vectors with cosine of at least t are at most sqrt(2 (1 - t)) apart, also along
   the leading axes, so a vector meets another cell only if that cell's box is that near.
   Every pair of cells that may link is one group of two bounded sides.
3. Inside a group, tiles of vectors are multiplied along the leading axes only. With the
   norms of the remaining coordinates the product is bounded from above, and a pair whose
   bound cannot reach the threshold is stopped there. Survivors take in the next axes and
   are bounded again. What is left is compared by its cosine of the original vectors in
   double precision.
4. A group returns, per class, how many vectors it links to and a spanning forest (never
   the pairs); components come from star rounds.

Results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths don't link; a cosine that ties with the threshold
links; repeated rows count as vectors of their own; a row without vec_id is counted but names no component; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import bounded, components, drop, local_roots, save

#: Sampled vectors for axes and cells (fewer for long vectors), classes per cell, rows of a tile.
SAMPLE, SAMPLE_NUMBERS, CELL_ROWS, TILE = 65_536, 1 << 23, 8192, 1024
LEAD = 8
#: Slack of the bounds for rounding; the last comparison has none.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (by an exact power of two first, against overflow)."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Space:
    """Axes and cells for the vectors of one length."""

    def __init__(self, sample: np.ndarray, dim: int, total: int, cell_rows: int):
        u = unit(sample) if len(sample) else np.zeros((0, dim))
        value, axes = np.linalg.eigh(u.T @ u) if len(u) else (None, np.eye(dim))
        self.axes = axes[:, ::-1]
        self.lead = min(LEAD, dim)
        want = max(1, -(-total // cell_rows))
        cells = [(u @ self.axes[:, : self.lead], np.full((2, self.lead), -np.inf) * np.array([[1], [-1]]))]
        while len(cells) < want:
            k = max(range(len(cells)), key=lambda i: len(cells[i][0]))
            y, box = cells[k]
            if len(y) < 32:
                break
            axis = int(np.argmax(y.max(axis=0) - y.min(axis=0)))
            cut = float(np.median(y[:, axis]))
            left = y[:, axis] < cut
            if not left.any() or left.all():
                break
            a, b = box.copy(), box.copy()
            a[1, axis] = b[0, axis] = cut
            cells[k:k + 1] = [(y[left], a), (y[~left], b)]
        self.low, self.high = np.array([b[0] for _, b in cells]), np.array([b[1] for _, b in cells])
        self.sub = -(-want // len(cells))          # hash parts of a cell
        self.parts = len(cells) * self.sub

    def meet(self, x: np.ndarray, salt: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, group, side) of all groups that the vectors take part in. A group is a pair
        of parts a <= b, written a * parts + b; side 0 belongs to a, side 1 to b."""
        y = unit(x) @ self.axes[:, : self.lead]
        off = np.maximum(np.maximum(self.low[None] - y[:, None], y[:, None] - self.high[None]), 0)
        gap = np.einsum("ijk,ijk->ij", off, off)
        inside = ((y[:, None] >= self.low[None]) & (y[:, None] < self.high[None])).all(axis=2)
        home = inside.argmax(axis=1) * self.sub + salt % self.sub
        row, cell = np.nonzero(gap <= reach * reach + SLACK)
        row, part = np.repeat(row, self.sub), (cell[:, None] * self.sub + np.arange(self.sub)).ravel()
        mine = home[row]
        return row, np.minimum(mine, part) * self.parts + np.maximum(mine, part), (mine > part).astype(np.int64)


def close_pairs(x1, y1, x2, y2, threshold):
    """Index pairs of two tiles whose cosine reaches the threshold (x: unit, original axes
    and their norms; y: unit vectors in principal axes)."""
    dim = y1.shape[1]
    steps = sorted({max(1, dim // 4), max(1, dim // 2), dim})
    k = steps[0]
    tail1, tail2 = ([np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", y[:, :s], y[:, :s]))) for s in steps] for y in (y1, y2))
    bound = np.hstack([y1[:, :k], tail1[0][:, None]]) @ np.hstack([y2[:, :k], tail2[0][:, None]]).T
    at = np.flatnonzero(bound.ravel() >= threshold - SLACK)
    i, j = at // len(y2), at % len(y2)
    got = bound.ravel()[at] - tail1[0][i] * tail2[0][j]
    for n, (lo, hi) in enumerate(zip(steps, steps[1:]), 1):
        got = got + np.einsum("ij,ij->i", y1[i, lo:hi], y2[j, lo:hi])
        go = got + tail1[n][i] * tail2[n][j] >= threshold - SLACK
        i, j, got = i[go], j[go], got[go]
    (r1, n1), (r2, n2) = x1, x2
    keep = np.einsum("ij,ij->i", r1[i], r2[j]) / (n1[i] * n2[j]) >= threshold
    return i[keep], j[keep]


def group_links(pdf: pd.DataFrame, axes: np.ndarray, threshold: float, same: bool) -> pd.DataFrame:
    """cid, links (vectors of other classes it links to here), root (cid) of one group."""
    pdf = pdf.sort_values(["side", "cid"], kind="stable")
    x = np.vstack(pdf["vector"].to_numpy())
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    y = (x / norm[:, None]) @ axes
    cid, n, side = (pdf[c].to_numpy() for c in ("cid", "n", "side"))
    split = len(cid) if same else int((side == 0).sum())
    first = range(0, split, TILE)
    links, root, a, b, found = np.zeros(len(cid), dtype=np.int64), np.arange(len(cid)), [], [], 0
    for p in first:
        for q in range(p, split, TILE) if same else range(split, len(cid), TILE):
            pe, qe = min(p + TILE, split), min(q + TILE, split if same else len(cid))
            i, j = close_pairs((x[p:pe], norm[p:pe]), y[p:pe], (x[q:qe], norm[q:qe]), y[q:qe], threshold)
            i, j = i + p, j + q
            if same:
                once = i < j
                i, j = i[once], j[once]
            links += np.bincount(i, weights=n[j], minlength=len(cid)).astype(np.int64)
            links += np.bincount(j, weights=n[i], minlength=len(cid)).astype(np.int64)
            a.append(i)
            b.append(j)
            found += len(i)
            if found > 1 << 20:
                root = local_roots(len(cid), *(np.concatenate(z) for z in ([np.arange(len(cid)), *a], [root, *b])))
                a, b, found = [], [], 0
    root = local_roots(len(cid), *(np.concatenate(z) for z in ([np.arange(len(cid)), *a], [root, *b])))
    at = np.flatnonzero(links)
    return pd.DataFrame({"cid": cid[at], "links": links[at], "root": cid[root[at]]})


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(fine & F.exists("vector", lambda x: x != 0), F.lit(False))
    classes = save(own.where(usable).groupBy("vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
                   .withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")

    spaces: dict[int, Space] = {}
    for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        rows = bounded(classes.where(F.col("dim") == r["dim"]), "cid", min(sample, max(64, SAMPLE_NUMBERS // r["dim"])), r["n"])
        seen = rows.select("vector").toPandas()["vector"]
        spaces[r["dim"]] = Space(np.vstack(seen.to_numpy()) if len(seen) else np.zeros((0, r["dim"])), r["dim"], r["n"], cell_rows)
    shared = spark.sparkContext.broadcast(spaces)    # axes and boxes: bounded by the sample
    reach = float(np.sqrt(max(0.0, 2 * (1 - threshold))))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                for lo in range(0, len(part), 2048):
                    p = part.iloc[lo:lo + 2048]
                    row, group, side = shared.value[dim].meet(np.vstack(p["vector"].to_numpy()), p["cid"].to_numpy(), reach)
                    yield p[["dim", "cid", "n", "vector"]].iloc[row].assign(group=group, side=side)

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        space = shared.value[int(key[0])]
        return group_links(pdf, space.axes, threshold, key[1] // space.parts == key[1] % space.parts)

    routed = classes.select("cid", "n", "dim", "vector").mapInPandas(
        route, "dim int, cid long, n long, vector array<double>, group long, side long")
    found = save(routed.groupBy("dim", "group").applyInPandas(compare, "cid long, links long, root long"), "links")
    roots = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = (classes.select("cid", "low", "n").join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
             .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
             .select("cid", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    named = save(named, "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = classes.select("cid", "vector").join(named.join(lows, "root").select("cid", "n_links", "component_id"), "cid").drop("cid")
    component = F.coalesce("component_id", "vec_id")
    return own.join(of_class, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def embedding_groups_sql(threshold: float = 0.9) -> str:
    """The same result for a table ``embeddings`` without odd rows as DuckDB SQL."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
         WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}),
walk AS (SELECT vec_id AS u, vec_id AS r FROM v UNION SELECT link.v, walk.r FROM walk JOIN link ON link.u = walk.u),
low AS (SELECT u, min(r) AS component_id FROM walk GROUP BY u)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.u = v.vec_id) AS n_links, low.component_id,
       v.vec_id = low.component_id AS kept FROM v JOIN low ON low.u = v.vec_id"""
