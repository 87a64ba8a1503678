"""Quality rules: counted base rules and a hashed n-gram log-likelihood ratio.

Words are runs of bytes that are not ASCII white space. Every single word and every pair of
neighbouring words of a text is an n-gram, hashed into one of ``2**bits`` buckets. Two
multinomials over the buckets are counted: one over all documents (raw), one over the
trusted documents (target), both with ``alpha`` added to every bucket. A text's score is the
mean of log p_target - log p_raw over its n-grams, so a long text counts like a short one. A
document is kept if it passes the base rules and its score is at least the cut: no draw, one
cut for all documents. A fifth of the trusted documents is left out of the target; the cut
lies a margin below the 0.5 % quantile of their scores, as scores of texts that the target
holds are higher, the more so the smaller the corpus.

One pass counts: each task adds up its buckets and hands on those that are not zero, so the
shuffle has at most one row per task and bucket. The table of ratios (``2**bits`` doubles)
is broadcast; further passes score the fifth and then all documents. All trusted documents
are read. Their ids are broadcast, too, up to ``BROADCAST_IDS`` of them, and texts are not
shuffled then; for more ids Spark picks the join.

Hashes are polynomial over a word's bytes, modulo 2**64, worked out for a whole chunk with
two running sums. Repeated windows are looked up by such hashes, and texts with a hit are
counted again exactly from the words themselves.

Results: a null text counts as empty; a text without words has score 0 and fails the base
rules; a row without ``doc_id`` is scored, but never trusted; repeated rows keep their rows,
each counting in the raw multinomial; if nothing is trusted every score is 0, and without a
trusted text to set the cut only the base rules decide; scores that tie with the cut pass;
an empty table gives an empty result; texts of any length are read as a whole; other columns
are ignored.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import crc32_sql, drop, id_remainder, save
from modelwatch.llm.fill_middle import byte_chunks, text_buffer

#: Buckets (log 2), added count.
BITS, ALPHA = 18, 1.0
#: Trusted ids that are broadcast at the most (about 60 bytes each).
BROADCAST_IDS = 2_000_000
#: One in so many trusted documents sets the cut: MARGIN below their LOWEST quantile.
FOLDS, LOWEST, MARGIN = 5, 0.005, 0.15
#: Base rules: fewest words, most percent of them in repeated windows.
MIN_WORDS, MOST_REPEATED = 20, 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Words of a repeated window, bytes of text worked on at a time.
WINDOW, CHUNK = 8, 2_000_000
#: Odd multipliers of the word hash, the pair hash, and the final spread over buckets.
BASE, PAIR, SPREAD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
BLANK = b" \t\n\x0b\x0c\r"


class Words:
    """The words of a chunk of texts, laid end to end with line breaks between: hash and row of each."""

    def __init__(self, raw: list[bytes], power: np.ndarray, inverse: np.ndarray):
        self.raw, self.rows = raw, len(raw)
        data = np.frombuffer(b"\n".join([b"", *raw, b""]), dtype=np.uint8)
        self.stop = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)        # position of the break after each text
        own = ~SPACE[data]
        self.own, self.data = own, data
        start, end = np.flatnonzero(own[1:] & ~own[:-1]) + 1, np.flatnonzero(own[:-1] & ~own[1:])
        # sum of byte * BASE**(end - i): a running sum of byte * BASE**-i, taken up by BASE**end
        run = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[:len(data)], dtype=np.uint64)
        self.hash = (run[end] - run[start - 1]) * power[end]
        self.row = np.searchsorted(self.stop, start)
        self.n = np.bincount(self.row, minlength=self.rows)

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask holds."""
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[np.concatenate([[0], self.stop])]
        return np.diff(run)

    def grams(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and row of every word and pair of neighbours."""
        same = self.row[1:] == self.row[:-1]
        pair = (self.hash[:-1] * np.uint64(PAIR) + self.hash[1:])[same]
        h = np.concatenate([self.hash, pair])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(SPREAD)
        return (h >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([self.row, self.row[1:][same]])

    def repeat_words(self, window: int) -> np.ndarray:
        """Words in windows that a text holds twice or more."""
        out, m = np.zeros(self.rows, dtype=np.int64), len(self.hash) - window + 1
        if m <= 0:
            return out
        h = np.zeros(m, dtype=np.uint64)
        for i in range(window):
            h = h * np.uint64(PAIR) + self.hash[i:i + m]
        whole = self.row[:m] == self.row[window - 1:]
        h, row = h[whole], self.row[:m][whole]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        for r in np.unique(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])]).tolist():
            out[r] = repeated(self.raw[r].split(), window)
        return out


def repeated(words: list[bytes], window: int) -> int:
    """Words in windows found twice or more, counted on the words themselves."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(ids, window)
    _, inv, n = np.unique(seen, axis=0, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[inv.ravel()] > 1)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


class Powers:
    """BASE**i and BASE**-i modulo 2**64 for positions of a chunk."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def words(self, raw: list[bytes]) -> Words:
        need = sum(map(len, raw)) + len(raw) + 1
        if need > len(self.power):
            self.power, self.inverse = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(need, x, dtype=np.uint64))])
                                        for x in (BASE, pow(BASE, -1, 1 << 64)))
        return Words(raw, self.power, self.inverse)


class Model:
    """Log ratio of every bucket, and the least score that passes (None: every score does)."""

    def __init__(self, ratio: np.ndarray, bits: int, cut: float | None):
        self.ratio, self.bits, self.cut = ratio, bits, cut


def text_chunks(batch: pa.RecordBatch, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with the bytes of their texts."""
    view, off = text_buffer(batch.column("_text"))
    for lo, hi in byte_chunks(off, size):
        cut = off[lo:hi + 1].tolist()
        yield batch.slice(lo, hi - lo), [bytes(view[a:b]) for a, b in zip(cut, cut[1:])]


def _texts(docs: DataFrame, ids: DataFrame, few: bool, how: str, *keep) -> DataFrame:
    """``_text`` of the rows, joined to trusted ``ids``, which are broadcast if they are few."""
    return docs.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(ids) if few else ids, "doc_id", how).select("_text", *keep)


def count_buckets(docs: DataFrame, target: DataFrame, bits: int, few: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all documents and of those in ``target`` (doc_id; ``few``: broadcast), by bucket."""
    marked = _texts(docs, target.withColumn("_good", F.lit(True)), few, "left", F.col("_good").isNotNull().alias("_good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = Powers(), np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            for own, raw in text_chunks(batch):
                bucket, row = powers.words(raw).grams(bits)
                good = own.column("_good").to_numpy(zero_copy_only=False)[row]
                total[0] += np.bincount(bucket, minlength=1 << bits)
                total[1] += np.bincount(bucket[good], minlength=1 << bits)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    # At most 2**bits rows reach the driver.
    written = save(marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket")
                   .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "buckets")
    sums, out = written.toPandas(), np.zeros((2, 1 << bits))
    drop(written)
    out[0, sums["bucket"]], out[1, sums["bucket"]] = sums["raw"], sums["target"]
    return out[0], out[1]


def fit(docs: DataFrame, trusted: DataFrame, bits: int = BITS, alpha: float = ALPHA) -> Model:
    """``trusted``: doc_id of trusted documents, all of which are read. A fifth of them (by a
    hash of the id) is not counted in the target but scored, and sets the cut."""
    ids = save(trusted.where("doc_id is not null").select("doc_id").distinct(), "trusted")
    few, apart = ids.count() <= BROADCAST_IDS, id_remainder(FOLDS) == 0
    raw, target = count_buckets(docs, ids.where(~apart), bits, few)
    if not target.sum():
        return Model(np.zeros(1 << bits), bits, None)
    ratio = np.log((target + alpha) / (target.sum() + alpha * len(target))) - np.log((raw + alpha) / (raw.sum() + alpha * len(raw)))
    model = Model(ratio, bits, None)
    scored = counted(_texts(docs.where(apart), ids.where(apart), few, "inner"), [], model, WINDOW)
    scores = save(scored.where(~base_failed(MIN_WORDS, MOST_REPEATED)).select("score"), "scores")
    low = quantile(scores, "score", LOWEST)
    drop(scores)
    model.cut = None if low is None else low - MARGIN
    return model


def quantile(df: DataFrame, col: str, share: float) -> float | None:
    """Exact, interpolated as ``percentile`` does it; of the sorted values only those up to the
    position are kept, and two reach the driver."""
    n = df.count()
    if not n:
        return None
    at = share * (n - 1)
    lower, upper = math.floor(at), math.ceil(at)
    found = [r[0] for r in df.select(col).orderBy(col).offset(lower).limit(upper - lower + 1).collect()]
    return found[0] if found[0] == found[-1] else (upper - at) * found[0] + (at - lower) * found[-1]


def counted(made: DataFrame, keep: list[str], model: Model, window: int) -> DataFrame:
    """``keep`` columns with the counts of the base rules and the score of ``_text``."""
    shared = made.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in made.select(*keep).schema] + [f"{c} long" for c in COUNTS] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table, bits = Powers(), shared.value.ratio, shared.value.bits
        for batch in batches:
            for own, raw in text_chunks(batch):
                words = powers.words(raw)
                bucket, row = words.grams(bits)
                n = np.bincount(row, minlength=len(raw))
                score = np.bincount(row, weights=table[bucket], minlength=len(raw)) / np.maximum(n, 1)
                lines = [[x for x in r.split(b"\n") if x.strip(BLANK)] for r in raw]
                cols = [words.n, words.per_row(words.own & ((words.data & 0xC0) != 0x80)), words.per_row(SYMBOL[words.data]),
                        np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64), words.repeat_words(window), score]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in keep], *map(pa.array, cols)], names=[*keep, *COUNTS, "score"])

    return made.mapInArrow(run, schema)


def base_failed(min_words: int, most_repeated: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def quality_rules(docs: DataFrame, trusted: DataFrame, keep: tuple = ("doc_id",), min_words: int = MIN_WORDS,
                  most_repeated: int = MOST_REPEATED, window: int = WINDOW, **options) -> DataFrame:
    """``keep`` columns of every row with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and score. ``options`` go to ``fit``.

    The base fails with fewer than ``min_words`` words, or more than ``most_repeated`` percent
    of them in repeated windows of ``window`` words.
    """
    model = fit(docs, trusted, **options)
    out = counted(docs.select(*keep, F.col("text").cast("string").alias("_text")), list(keep), model, window)
    verdict = F.lit(True) if model.cut is None else F.col("score") >= model.cut
    failed = base_failed(min_words, most_repeated)
    return out.select(*keep, *COUNTS, failed.alias("base_failed"), (~failed & verdict).alias("kept"), "score")


def quality_rules_sql(bits: int = BITS, alpha: float = ALPHA) -> str:
    """What the registered query returns for ``documents`` and ``labels``, as DuckDB SQL."""
    word, mod = r"[^\x20\x09-\x0D]+", 1 << 64
    byte = "CAST('0x' || substr(hex(word), i, 2) AS UHUGEINT) + 1"

    def bucket(h):
        return (f"CAST((CAST(xor(CAST({h} AS UBIGINT), CAST({h} // 4294967296 AS UBIGINT)) AS UHUGEINT) * {SPREAD}::UHUGEINT % {mod}::UHUGEINT)"
                f" // {1 << (64 - bits)} AS BIGINT)")

    return rf"""
WITH words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
               FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents)),
hashed AS (SELECT word, list_reduce(list_prepend(0::UHUGEINT, list_transform(range(1, len(hex(word)), 2), lambda i: {byte})),
                  lambda a, b: (a * {BASE}::UHUGEINT + b) % {mod}::UHUGEINT) AS h FROM (SELECT DISTINCT word FROM words)),
seq AS (SELECT doc_id, pos, word, h, lead(h) OVER w AS nxt, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS long,
               string_agg(word, ' ') OVER (w ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS run
        FROM words JOIN hashed USING (word) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (SELECT doc_id, {bucket('h')} AS bucket FROM seq UNION ALL
          SELECT doc_id, {bucket(f'((h * {PAIR}::UHUGEINT + nxt) % {mod}::UHUGEINT)')} FROM seq WHERE nxt IS NOT NULL),
twice AS (SELECT doc_id, pos, long = {WINDOW} AND count(*) FILTER (WHERE long = {WINDOW}) OVER (PARTITION BY doc_id, run) > 1 AS dup FROM seq),
repeats AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM (SELECT doc_id, bool_or(dup) OVER (
                PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM twice) GROUP BY doc_id),
trusted AS (SELECT DISTINCT doc_id, {crc32_sql('CAST(doc_id AS VARCHAR)')} % {FOLDS} = 0 AS apart FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
sums AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE NOT apart) AS target FROM grams LEFT JOIN trusted USING (doc_id) GROUP BY bucket),
total AS (SELECT sum(raw) + {alpha} * {1 << bits} AS r, sum(target) + {alpha} * {1 << bits} AS t, sum(target) AS seen FROM sums),
ratio AS (SELECT bucket, CASE WHEN seen > 0 THEN ln((target + {alpha}) / t) - ln((raw + {alpha}) / r) ELSE 0 END AS x FROM sums, total),
scores AS (SELECT doc_id, avg(x) AS score FROM grams JOIN ratio USING (bucket) GROUP BY doc_id),
lined AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM documents),
base AS (SELECT d.doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{word}')) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(coalesce(text, ''), '[ 	-
]', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(score, 0) AS score
         FROM documents d JOIN lined USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN scores USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base),
cut AS (SELECT quantile_cont(score, {LOWEST}) - {MARGIN} AS least FROM judged JOIN trusted USING (doc_id), total WHERE apart AND NOT base_failed AND seen > 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(score >= least, true) AS kept, round(score, 6) AS score FROM judged, cut"""
