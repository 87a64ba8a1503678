"""SimHash near-duplicates found with vantage-point trees.

1. One pass computes each text's 64-bit fingerprint. Equal fingerprints become one row,
   so a group of copies of any size costs one row from here on.
2. A vantage-point tree built on a bounded sample of the distinct fingerprints cuts the
   space into shards. A node holds a vantage fingerprint, one of four 16-bit blocks, and
   a cut: fingerprints whose block differs from the vantage in at most ``cut`` bits go
   left. A fingerprint has one home shard; as a query it also visits every shard that the
   triangle bound cannot exclude. The four blocks are disjoint, so the distances that a
   path must cross in different blocks add up; a branch is pruned once the sum exceeds
   the radius. No pair within the radius is lost.
3. Each shard builds the same kind of tree over its home rows down to small buckets, runs
   its home rows and visitors through it, and compares exactly. It returns a spanning
   forest of the pairs it found (never the pairs themselves).
4. Components come from star rounds over those forests.

Results: a null text counts as empty; texts without words have fingerprint 0 and link like
any other; a bit set in exactly half the shingles is 0; a text of any length is read as a
whole; repeated rows keep their own result rows; a row without ``doc_id`` is linked but never
names a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import bounded, components, drop, local_roots, per_text, save

BLOCKS = np.array([0xFFFF << s for s in (0, 16, 32, 48)], dtype=np.uint64)
#: Sampled fingerprints that shape the shards, home rows a shard aims at, rows of a bucket.
TREE_SAMPLE, SHARD_ROWS, BUCKET = 65_536, 32_768, 64


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash of one text (A-Z lowered; words between ASCII white space)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    buf = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    stop = end[shingle - 1:].tolist()
    h = np.array([digest(buf[a:b], seed) for a, b in zip(start, stop)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 14):
        part = h[lo:lo + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): ``fp`` is the fingerprint as a signed long."""
    def make():
        return lambda texts: {"fp": np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)}
    return per_text(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")], make, "fp long")


class Tree:
    """Vantage-point tree over 64-bit fingerprints in flat arrays; children >= 0 are nodes,
    child ``-1 - k`` is leaf ``k``."""

    def __init__(self, fps: np.ndarray, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vantage, self.block, self.cut, self.left, self.right = [], [], [], [], []
        self.leaves = 0
        todo = [(fps, 0, None)]
        self.root = None
        while todo:
            own, depth, parent = todo.pop()
            split = self._split(own, depth, rng) if len(own) > leaf else None
            if split is None:
                at, self.leaves = -1 - self.leaves, self.leaves + 1
            else:
                at = len(self.vantage)
                v, block, cut, inside = split
                for col, x in ((self.vantage, v), (self.block, block), (self.cut, cut), (self.left, 0), (self.right, 0)):
                    col.append(x)
                todo += [(own[inside], depth + 1, (at, self.left)), (own[~inside], depth + 1, (at, self.right))]
            if parent is None:
                self.root = at
            else:
                parent[1][parent[0]] = at
        self.vantage = np.array(self.vantage, dtype=np.uint64)
        self.block, self.cut, self.left, self.right = (np.array(x, dtype=np.int64) for x in (
            self.block, self.cut, self.left, self.right))

    @staticmethod
    def _split(own, depth, rng):
        """The most even cut among a few vantages, or None if none parts the rows."""
        best = None
        for block in (depth % 4, (depth + 1) % 4, (depth + 2) % 4, (depth + 3) % 4):
            for v in own[rng.integers(0, len(own), 3)]:
                d = np.bitwise_count((own ^ v) & BLOCKS[block])
                share = np.cumsum(np.bincount(d, minlength=17))[:-1] / len(own)
                cut = int(np.argmin(np.abs(share - 0.5)))
                off = abs(share[cut] - 0.5)
                if off < 0.5 and (best is None or off < best[0]):
                    best = (off, v, block, cut, d <= cut)
            if best and best[0] < 0.2:
                break
        return best and best[1:]

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for every leaf that may hold a fingerprint within ``radius``."""
        n = len(fps)
        row, node = np.arange(n), np.full(n, self.root, dtype=np.int64)
        gaps, home = np.zeros((n, 4), dtype=np.uint8), np.ones(n, dtype=bool)
        out = [[], [], []]
        while len(row):
            at_leaf = node < 0
            for col, x in zip(out, (row, -1 - node, home)):
                col.append(x[at_leaf])
            row, node, gaps, home = row[~at_leaf], node[~at_leaf], gaps[~at_leaf], home[~at_leaf]
            if not len(row):
                break
            block = self.block[node]
            d = np.bitwise_count((fps[row] ^ self.vantage[node]) & BLOCKS[block]).astype(np.int64) - self.cut[node]
            parts = []
            for child, gap in ((self.left[node], d), (self.right[node], 1 - d)):
                g = gaps.copy()
                k = np.arange(len(row))
                g[k, block] = np.maximum(g[k, block], np.clip(gap, 0, 255).astype(np.uint8))
                stay = g.sum(axis=1, dtype=np.int64) <= radius
                parts.append((row[stay], child[stay], g[stay], (home & (gap <= 0))[stay]))
            row, node, gaps, home = (np.concatenate(x) for x in zip(*parts))
        return tuple(np.concatenate(x) for x in out)


def shard_links(member: np.ndarray, visitor: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, smaller-index fingerprint) of all pairs within ``radius``
    between a member and a member or visitor."""
    fps = np.concatenate([member, visitor])
    root = np.arange(len(fps))
    if len(member):
        tree = Tree(member, BUCKET)
        row, leaf, home = tree.route(fps, radius)
        order = np.argsort(leaf, kind="stable")
        row, leaf, home = row[order], leaf[order], home[order]
        edges = np.searchsorted(leaf, np.arange(tree.leaves + 1))
        a, b, found = [], [], 0
        for lo, hi in zip(edges[:-1], edges[1:]):
            r, own = row[lo:hi], row[lo:hi][home[lo:hi] & (row[lo:hi] < len(member))]
            step = max(1, (1 << 22) // max(1, len(own)))
            for s in range(0, len(r), step):
                q = r[s:s + step]
                i, j = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[own][None, :]) <= radius)
                keep = q[i] != own[j]
                a.append(q[i][keep])
                b.append(own[j][keep])
                found += len(a[-1])
            if found > 1 << 20:  # fold what was found into roots, so memory stays with the rows
                root = local_roots(len(fps), *_with(root, a, b))
                a, b, found = [], [], 0
        root = local_roots(len(fps), *_with(root, a, b))
    at = np.flatnonzero(root != np.arange(len(fps)))
    return fps[at], fps[root[at]]


def _with(root, a, b):
    n = np.arange(len(root))
    return np.concatenate([n, *a]), np.concatenate([root, *b])


def link_fingerprints(fps: DataFrame, radius: int = 2, sample: int = TREE_SAMPLE,
                      shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (u, v) of the distinct fingerprints ``fp`` within ``radius`` bits."""
    spark = fps.sparkSession
    total = fps.count()
    shards = max(1, -(-total // shard_rows))
    seen = np.array([r[0] for r in bounded(fps, "fp", sample, total).select("fp").collect()], dtype=np.int64)
    tree = spark.sparkContext.broadcast(Tree(np.unique(seen).view(np.uint64), max(1, len(seen) // shards)))

    def route(frames):
        for pdf in frames:
            fp = pdf["fp"].to_numpy()
            for lo in range(0, len(fp), 8192):
                own = fp[lo:lo + 8192]
                row, leaf, home = tree.value.route(own.view(np.uint64), radius)
                yield pd.DataFrame({"shard": leaf, "fp": own[row], "home": home})

    def compare(pdf):
        fp, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(dtype=bool)
        u, v = shard_links(fp[home], fp[~home], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    routed = fps.select("fp").mapInPandas(route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(compare, "u long, v long")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, sample: int = TREE_SAMPLE,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest
    doc_id reachable over links of at most ``radius`` differing bits), n_copies (rows with
    the same fingerprint), text_hash (tells texts under one doc_id apart)."""
    own = save(fingerprints(docs, shingle), "fp")
    classes = save(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_copies")), "classes")
    roots = components(link_fingerprints(classes, radius, sample, shard_rows))
    roots = save(roots, "roots")
    grouped = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "low", "n_copies", F.coalesce("root", "fp").alias("root"))
    lows = (grouped.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("low").alias("component_id")))
    named = grouped.join(lows, "root").select("fp", "n_copies", "component_id")
    named = save(named, "named")
    drop(classes)
    return own.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies", "text_hash")
