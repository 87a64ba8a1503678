"""Language-model scores from a weighted backoff automaton over word n-grams.

Model of order n (learned from the training rows, all of them): add-one unigrams
p(w) = (c(w) + 1) / (N + V + 1), and longer n-grams smoothed towards shorter ones with a
Dirichlet prior, p(w | u v) = (c(u v w) + k p(w | v)) / (c(u v) + k). As an automaton: a state
per context of at most n - 1 words seen in training (one for the start of a text, too), an arc
per seen n-gram that begins with the context, with weight log10 p(w | context), and a failure
arc to the context without its first word, with weight log10(k / (c(context) + k)). Failure
arcs are followed until an arc for the word is found; the last one leads to the root, whose
arcs are log10 p(w). A word never seen in training leads back to the root.

The counts grow with the corpus, so no task ever holds the whole model:

1. Texts are cut into batches of about ``batch_tokens`` tokens; a batch is written as its
   distinct words (64-bit hashes) and the sequence of local word numbers.
2. Every batch sends its distinct n-grams of every length up to the order, each once with its
   training count, to buckets of a hash range; a word in every text is one entry per batch. A
   batch sends one row per length and bucket that it has entries for, so never more rows than
   entries. A bucket adds up the counts and answers every batch for exactly the entries it
   asked for.
3. A batch with its answers builds the part of the automaton that its texts can reach and
   runs them through it from left to right: all texts of the batch advance one token at a
   time, carrying state and score.

Words are hashed to 64 bits and compared by 56 of them within a bucket; words that would
share a hash would share a count (none in tests).

Results: a null text is empty; an empty text has one token, the end; repeated rows keep
their rows; a text of any length is scored as a whole; without training rows every
probability is 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import id_remainder, save
from modelwatch.session import shuffle_partitions

BATCH_TOKENS, BUCKET_ENTRIES, PRIOR, ORDER = 1_000_000, 2_000_000, 4.0, 2
#: Names that no word can have, as words hold no space.
END, START = (xxhash.xxh64_intdigest(x) for x in (b" end", b" start"))
LOW = np.uint64((1 << 56) - 1)
BATCH_FIELDS = "batch long, doc_id array<long>, no_id array<boolean>, held array<boolean>, sizes array<int>, words binary, codes binary"


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def batches(docs: DataFrame, batch_tokens: int) -> DataFrame:
    """One row per batch of texts (docs: doc_id, held_out, text)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, k = TaskContext.get().partitionId() << 32, 0
        numbers, codes, ids, no_id, held, sizes, n = _Numbers(), [], [], [], [], [], 0

        def flush():
            words = np.array([END] + [xxhash.xxh64_intdigest(w) for w in list(numbers)[1:]], dtype="<u8")
            c = np.concatenate(codes)
            order = np.argsort(-np.bincount(c, minlength=len(words)), kind="stable")   # frequent words get small numbers
            rank = np.empty(len(order), dtype="<i4")
            rank[order] = np.arange(len(order))
            return pd.DataFrame({"batch": [first + k], "doc_id": [ids], "no_id": [no_id], "held": [held], "sizes": [sizes],
                                 "words": [words[order].tobytes()], "codes": [rank[c].tobytes()]})

        numbers[None]
        for pdf in frames:
            for i, none, h, t in zip(pdf["doc_id"], pdf["no_id"], pdf["held_out"], pdf["text"]):
                words = t.encode("utf-8", "replace").lower().split() if isinstance(t, str) else []
                own = np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))
                codes.append(np.append(own, np.int32(0)))
                ids.append(int(i))
                no_id.append(bool(none))
                held.append(bool(h))
                sizes.append(len(words) + 1)
                n += len(words) + 1
                if n >= batch_tokens:
                    yield flush()
                    k += 1
                    numbers, codes, ids, no_id, held, sizes, n = _Numbers(), [], [], [], [], [], 0
                    numbers[None]
        if ids:
            yield flush()
    return docs.mapInPandas(run, BATCH_FIELDS)


class Batch:
    """The distinct n-grams of one batch row, by length: ``grams[k]`` those of ``k + 1`` words.

    ``of[k][t]`` is the number of the one that ends at token ``t`` (-1 where the text is too
    short for one). A text begins with the start mark, once: it is a context of one word."""

    def __init__(self, r, order: int):
        self.words = np.frombuffer(bytes(r.words), dtype="<u8")
        self.codes = np.frombuffer(bytes(r.codes), dtype="<i4").astype(np.int64)
        self.sizes = np.asarray(r.sizes, dtype=np.int64)
        self.offset = np.cumsum(self.sizes) - self.sizes
        self.start = n = len(self.words)
        within = np.arange(len(self.codes)) - np.repeat(self.offset, self.sizes)
        self.of, self.prefix, self.last, self.hash = [self.codes], [None], [np.arange(n)], [self.words]
        known, before = np.append(self.words, np.uint64(START)), None
        for k in range(1, order):
            # The context of k words before each token; the start mark is the first of a text's.
            before = np.empty_like(self.codes)
            before[1:] = self.of[k - 1][:-1]
            if k == 1:
                before[within == 0] = n
            else:
                before[within < k - 1] = -1
            at = np.flatnonzero(before >= 0)
            keys, inv = np.unique(before[at] * (n + 1) + self.codes[at], return_inverse=True)
            of = np.full(len(self.codes), -1, dtype=np.int64)
            of[at] = inv
            self.of.append(of)
            self.prefix.append(keys // (n + 1))
            self.last.append(keys % (n + 1))
            a, b = (known if k == 1 else self.hash[k - 1])[self.prefix[k]], self.words[self.last[k]]
            h = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
            self.hash.append(h ^ (h >> np.uint64(32)))
        self.order = [np.argsort(x) for x in self.hash]

    def counts(self, held) -> list[np.ndarray]:
        """How often each n-gram occurs in the batch's training texts."""
        train = np.repeat(~np.asarray(held, dtype=bool), self.sizes)
        return [np.bincount(of[train & (of >= 0)], minlength=len(h)) for of, h in zip(self.of, self.hash)]

    def shorter(self, k: int) -> np.ndarray:
        """For each n-gram of ``k + 1`` words, the one without its first word."""
        out, at = np.empty(len(self.hash[k]), dtype=np.int64), np.flatnonzero(self.of[k] >= 0)
        out[self.of[k][at]] = self.of[k - 1][at]
        return out


def buckets_of(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges (of ``n``) that sorted hashes fall in, and where each begins."""
    bucket = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)) != 0)
    return bucket[first].astype(np.int64), np.append(first, len(h))


def entries(table: DataFrame, n_buckets: int, order: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                own = Batch(r, order)
                for kind, count in enumerate(own.counts(r.held)):
                    h, count = own.hash[kind][own.order[kind]], count[own.order[kind]].astype("<u4")
                    low = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                    bucket, edge = buckets_of(h, n_buckets)
                    edge = edge.tolist()
                    yield pd.DataFrame([(b, r.batch, kind, low[x:y].tobytes(), count[x:y].tobytes())
                                        for b, x, y in zip(bucket.tolist(), edge, edge[1:])],
                                       columns=["bucket", "batch", "kind", "hashes", "counts"])
    return table.mapInPandas(run, "bucket int, batch long, kind int, hashes binary, counts binary")


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of one bucket, cut back into the entries that each batch sent."""
    out = []
    for kind, part in pdf.groupby("kind"):
        size = [len(x) // 7 for x in part["hashes"]]
        raw = np.zeros((sum(size), 8), dtype=np.uint8)
        raw[:, :7] = np.frombuffer(b"".join(part["hashes"]), dtype=np.uint8).reshape(-1, 7)
        count = np.frombuffer(b"".join(part["counts"]), dtype="<u4")
        uniq, inv = np.unique(raw.view("<u8").ravel(), return_inverse=True)
        total = np.bincount(inv, weights=count, minlength=len(uniq)).astype("<u8")
        mine, at = total[inv], 0
        known, tokens = (int((total > 0).sum()), int(total.sum())) if kind == 0 else (0, 0)
        for b, n in zip(part["batch"], size):
            out.append((b, kind, int(part["bucket"].iloc[0]), mine[at:at + n].tobytes(), known, tokens))
            at, known, tokens = at + n, 0, 0
    return pd.DataFrame(out, columns=["batch", "kind", "bucket", "totals", "known", "tokens"])


class Automaton:
    """The arcs that one batch can reach. States are numbered: the words, the start, then the
    n-grams of two words and more that can be contexts, and last the root."""

    def __init__(self, own: Batch, totals: list[np.ndarray], tokens: int, known: int, prior: float):
        n, order = len(own.words), len(totals)
        end = int(np.flatnonzero(own.words == np.uint64(END))[0])
        p = (totals[0] + 1) / (tokens + known + 1)
        self.start, self.width = n, n + 1
        base = [0]                                     # first state of the contexts of k + 1 words
        for k in range(1, order - 1):
            base.append(n + 1 if k == 1 else base[-1] + len(own.hash[k - 1]))
        self.root = base[-1] + (len(own.hash[order - 2]) if order > 2 else n + 1)
        self.root_arc = np.log10(p)
        self.next = np.where(totals[0] > 0, np.arange(n), self.root) if order > 1 else np.full(n, self.root)
        # Every text starts once and ends once; any other context is followed as often as it is seen.
        seen = [np.append(totals[0], totals[0][end]), *totals[1:order - 1]] if order > 1 else []
        self.fail, self.link = np.zeros(self.root + 1), np.full(self.root + 1, self.root)
        for k, c in enumerate(seen):
            states = slice(base[k], base[k] + len(c))
            self.fail[states] = np.log10(prior / (c + prior))
            if k:
                self.link[states] = base[k - 1] + own.shorter(k)
        keys, arcs, targets, lower = [], [], [], p
        for k in range(1, order):
            # p of every n-gram of k + 1 words; where it is not seen, only as a step for the next length.
            context = np.asarray(seen[k - 1], dtype=np.float64)[own.prefix[k]]
            shorter = lower[own.last[k]] if k == 1 else lower[own.shorter(k)]
            lower = (totals[k] + prior * shorter) / (context + prior)
            at = np.flatnonzero(totals[k] > 0)
            keys.append((base[k - 1] + own.prefix[k][at]) * self.width + own.last[k][at])
            arcs.append(np.log10(lower[at]))
            targets.append(base[k] + at if k < order - 1 else (own.last[k] if k == 1 else base[k - 1] + own.shorter(k))[at])
        key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        by = np.argsort(key)
        self.key = np.append(key[by], -1)              # a last one that nothing asks for
        self.arc = np.append(np.concatenate(arcs)[by] if keys else [], 0.0)
        self.to = np.append(np.concatenate(targets)[by] if keys else [], self.root).astype(np.int64)

    def run(self, own: Batch) -> np.ndarray:
        """log10 probability of every text: one pass from left to right over all of them."""
        order = np.argsort(-own.sizes, kind="stable")
        size, at = own.sizes[order], own.offset[order]
        first = self.start if self.root > self.start else self.root
        state, score = np.full(len(order), first), np.zeros(len(order))
        alive = np.searchsorted(-size, -np.arange(int(size[0])), side="left")   # texts longer than t tokens
        arcs = self.key[:-1]
        for t, k in enumerate(alive.tolist()):
            word, open_ = own.codes[at[:k] + t], np.arange(k)
            while len(open_):
                s, w = state[open_], word[open_]
                key = s * self.width + w
                arc = np.searchsorted(arcs, key)
                hit = (self.key[arc] == key) & (s != self.root)
                done, rest = open_[hit], ~hit
                score[done] += self.arc[arc[hit]]
                state[done] = self.to[arc[hit]]
                at_root = rest & (s == self.root)
                i = open_[at_root]
                score[i] += self.root_arc[w[at_root]]
                state[i] = self.next[w[at_root]]
                failing = rest & ~at_root
                i = open_[failing]
                score[i] += self.fail[s[failing]]
                state[i] = self.link[s[failing]]
                open_ = i
        out = np.empty(len(order))
        out[order] = score
        return out


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, prior: float = PRIOR, batch_tokens: int = BATCH_TOKENS,
              bucket_entries: int = BUCKET_ENTRIES, order: int = ORDER) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo ``folds`` is ``held``), n_tokens, n_known,
    train_tokens, base_score (add-one unigrams), score (the automaton of n-grams of up to
    ``order`` words)."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), (id_remainder(folds) == held).alias("held_out"),
                      F.col("text").cast("string").alias("text"))
    table = save(batches(own, batch_tokens), "batches")
    size = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n_buckets = max(shuffle_partitions(spark), size // bucket_entries + 1)
    sent = entries(table, n_buckets, order).repartition(n_buckets, "bucket")
    answers = save(sent.groupBy("bucket").applyInPandas(
        answer, "batch long, kind int, bucket int, totals binary, known long, tokens long"), "answers")
    sums = answers.agg(F.sum("known"), F.sum("tokens")).first()
    known, tokens = sums[0] or 0, sums[1] or 0
    whole = answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("kind", "bucket", "totals"))).alias("answers"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                mine = Batch(r, order)
                totals = []
                for kind in range(order):
                    t = np.empty(len(mine.order[kind]), dtype=np.int64)
                    t[mine.order[kind]] = np.frombuffer(b"".join(bytes(x["totals"]) for x in r.answers if x["kind"] == kind), dtype="<u8")
                    totals.append(t)
                auto = Automaton(mine, totals, tokens, known, prior)
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(np.asarray(r.doc_id, dtype=np.int64), np.asarray(r.no_id, dtype=bool)), "held_out": list(r.held), "n_tokens": mine.sizes,
                    "n_known": np.add.reduceat((totals[0] > 0)[mine.codes].astype(np.int64), mine.offset), "train_tokens": tokens,
                    "base_score": np.add.reduceat(auto.root_arc[mine.codes], mine.offset), "score": auto.run(mine)})

    return table.join(whole, "batch").mapInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
