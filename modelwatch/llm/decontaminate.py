"""Benchmark decontamination with item-sized SimHash windows.

Texts are lower-cased and read as words (runs of letters, digits and underscores), so case
and punctuation don't matter. For every item length L, windows of L words slide over each
document (a document shorter than L is one window). A window's 64-bit SimHash over its
5-word shingles is looked up in a multi-index: each item's fingerprint is cut into four
16-bit blocks, and a fingerprint within ``radius`` bits of the window's must agree with it
in some block up to ``radius // 4`` bits; tables over all 2**16 block values hold exactly
that, so no fingerprint within the radius is missed. Survivors within the radius are then
compared exactly: weighted Jaccard of the shingles (weight: occurrences), sum of minima
over sum of maxima, at least ``threshold``.

A window without any shingle of any item has similarity 0 to all of them, so only windows
that hold at least one are fingerprinted; no match is lost by that. Items shorter than
five words are compared as one whole shingle.

The items go through in blocks of ``block_items``, one Spark job a block: its index is built,
broadcast, and let go before the next block is read, so neither the driver nor a worker ever
holds more than one, however large the benchmark is. What a block finds (few rows: a hash of
the text and the items in it) is written to the shared folder; at the end the findings join
the documents by that hash. A benchmark of one block needs no such table.

Null texts and texts without words match nothing; a document that holds an item without an id
is contaminated, without that item in its ``item_ids``; repeated items are one; repeated rows
keep their rows; texts of any length are read as a whole; an empty benchmark or table gives
no matches; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import drop, per_text, save

WORD = re.compile(r"\w+").findall
BLOCK_ITEMS = 2048
MIX = np.uint64(0x9E3779B97F4A7C15)
CACHE = 200_000


def word_hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    missing = set(words).difference(seen)
    if len(seen) > CACHE:
        seen.clear()
        missing = set(words)
    for w in missing:
        seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
    return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, well mixed for SimHash bits."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        x = (x ^ h[j:j + n]) * MIX
        x ^= x >> np.uint64(29)
    return x


def bits_of(h: np.ndarray) -> np.ndarray:
    """One row of 64 columns, +1 / -1, per hash."""
    raw = np.ascontiguousarray(h).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


class Index:
    """Fingerprints, shingle weights and block tables of one block of items."""

    def __init__(self, items: list[tuple], shingle: int, radius: int, threshold: float):
        self.shingle, self.radius, self.threshold = shingle, radius, threshold
        self.by_length: dict[int, list] = {}
        near = np.bitwise_count(np.arange(1 << 16, dtype=np.uint32)) <= radius // 4
        ball = np.flatnonzero(near)
        every: dict[int, list] = {}
        for item_id, text in items:
            h = word_hashes(WORD((text or "").lower()), {})
            if len(h):
                k = min(shingle, len(h))
                s = shingle_hashes(h, k)
                fp = int(pack(bits_of(s).sum(axis=0, keepdims=True))[0])
                self.by_length.setdefault(len(h), []).append((item_id, fp, Counter(s.tolist())))
                every.setdefault(k, []).append(s)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in every.items()}
        self.maybe = {}
        for k, v in self.known.items():
            self.maybe[k] = np.zeros(1 << 20, dtype=bool)
            self.maybe[k][(v >> np.uint64(44)).astype(np.int64)] = True
        self.tables = {}
        for length, own in self.by_length.items():
            t = np.zeros((4, 1 << 16), dtype=bool)
            for _, fp, _ in own:
                for b in range(4):
                    t[b, ((fp >> (16 * b)) & 0xFFFF) ^ ball] = True
            self.tables[length] = np.packbits(t, axis=1, bitorder="little")
        self.fps = {n: np.array([fp for _, fp, _ in own], dtype=np.uint64) for n, own in self.by_length.items()}

    def hits(self, s: np.ndarray, k: int) -> np.ndarray:
        """Positions whose shingle belongs to some item."""
        known = self.known[k]
        at = np.flatnonzero(self.maybe[k][(s >> np.uint64(44)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(known, s[at]), len(known) - 1)
        return at[known[pos] == s[at]]

    def match(self, h: np.ndarray) -> dict:
        """item_id -> best similarity of the items that this document holds."""
        found: dict = {}
        for k in self.known:
            s = shingle_hashes(h, k)
            if not len(s):
                continue
            hit = self.hits(s, k)
            if not len(hit):
                # Too short for a window of five words: one whole shingle can't equal an item's.
                continue
            widest = max((n for n in self.by_length if min(self.shingle, n) == k), default=0)
            # Regions of starts that can hold a hit; each is worked on by itself.
            cut = np.flatnonzero(np.diff(hit) > 2 * widest) + 1
            for part in np.split(hit, cut):
                lo, hi = max(0, int(part[0]) - widest), min(len(s), int(part[-1]) + widest)
                for a in range(lo, hi, 1 << 16):  # long regions in overlapping pieces
                    self._region(s, k, part, a, min(hi, a + (1 << 16) + widest), found)
        return found

    def _region(self, s, k, hit, lo, hi, found):
        own = s[lo:hi]
        sums = np.zeros((len(own) + 1, 64), dtype=np.int32)
        np.cumsum(bits_of(own), axis=0, out=sums[1:])
        mark = np.zeros(len(own) + 1, dtype=np.int32)
        near = hit[(hit >= lo) & (hit < hi)] - lo
        mark[near + 1] = 1
        mark = np.cumsum(mark)
        for length, items in self.by_length.items():
            if min(self.shingle, length) != k:
                continue
            width = min(length - k + 1, len(s))       # shingles of a window; short documents are one window
            if width > len(own):
                continue
            start = np.flatnonzero(mark[width:] > mark[:-width])
            if not len(start):
                continue
            fp = pack(sums[start + width] - sums[start])
            t, cand = self.tables[length], np.zeros(len(fp), dtype=bool)
            for b in range(4):
                v = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                cand |= ((t[b][v >> 3] >> (v & 7).astype(np.uint8)) & 1).astype(bool)
            cand = np.flatnonzero(cand)
            for c0 in range(0, len(cand), 65_536):
                c = cand[c0:c0 + 65_536]
                w, i = np.nonzero(np.bitwise_count(fp[c][:, None] ^ self.fps[length][None, :]) <= self.radius)
                for at, k_item in zip(start[c[w]].tolist(), i.tolist()):
                    item_id, _, weight = items[k_item]
                    if found.get(item_id, 0) == 1:
                        continue
                    sim = weighted_jaccard(Counter(own[at:at + width].tolist()), weight)
                    if sim >= self.threshold and sim > found.get(item_id, 0):
                        found[item_id] = sim


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8,
          radius: int = 15, block_items: int = BLOCK_ITEMS, keep: list[str] | None = None) -> DataFrame:
    """Every document row (``keep`` columns, default doc_id) with contaminated (boolean),
    item_ids (sorted) and similarity (of the best match; 0 without one)."""
    keep = list(keep or ["doc_id"])
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    made = f"ids array<{kind}>, best double"
    rows = docs.select(F.struct(*keep).alias("_row"), F.col("text").cast("string").alias("text"))
    n_blocks = max(1, -(-items.count() // block_items))
    if n_blocks == 1:
        out = per_text(rows, ["_row"], _matcher(_index(items, shingle, radius, threshold)), made, 8_000_000)
    else:
        texts = rows.select(F.xxhash64("text").alias("_h"), "text")
        found = [_found(texts, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b), made, shingle, radius, threshold)
                 for b in range(n_blocks)]
        every = found[0].sparkSession.read.schema(found[0].schema).parquet(*[f._llm_path for f in found])
        every = save(every.groupBy("_h").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.max("best").alias("best")), "leaks")
        for f in found:
            drop(f)
        out = rows.select("_row", F.xxhash64("text").alias("_h")).join(every, "_h", "left")
    ids = F.coalesce("ids", F.array().cast(f"array<{kind}>"))
    return out.select("_row.*", (F.size(ids) > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.array_compact(ids))).alias("item_ids"),
                      F.coalesce("best", F.lit(0.0)).alias("similarity"))


def _index(items: DataFrame, shingle: int, radius: int, threshold: float):
    """Broadcast index of one block of items."""
    return items.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], shingle, radius, threshold))


def _found(texts: DataFrame, items: DataFrame, made: str, shingle: int, radius: int, threshold: float) -> DataFrame:
    """(_h, ids, best) of the different texts that hold an item of the block, written."""
    index = _index(items, shingle, radius, threshold)
    hits = per_text(texts, ["_h"], _matcher(index), made, 8_000_000).where("size(ids) > 0")
    out = save(hits.dropDuplicates(["_h"]), "found")
    index.unpersist()
    return out


def _matcher(index):
    def make():
        seen: dict[str, int] = {}

        def work(texts):
            found = [index.value.match(word_hashes(WORD(t.lower()), seen)) if t and index.value.known else {} for t in texts]
            return {"ids": [list(m) for m in found], "best": [float(max(m.values(), default=0.0)) for m in found]}
        return work
    return make
