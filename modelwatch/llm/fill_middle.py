"""Fill-in-the-middle transformation with a piece table.

A document is a list of descriptors (buffer, start, stop) over two buffers that never
change: the UTF-8 bytes of an Arrow batch, and the three sentinels. Cutting splits the
document's one descriptor at two unit borders; an arrangement permutes the three pieces and
sets a sentinel descriptor before each; the inverse permutation restores the order. Texts
are copied once, when the output column is gathered from the descriptors; the hashes stream
the descriptors without copying.

A unit is a run of ASCII letters or any other single code point. Unit borders of a whole
batch are found at once from its bytes: a byte opens a unit if it opens a code point and is
not a letter that follows a letter of the same text. Where to cut and which form to take
come from a hash of ``doc_id`` alone, so a recomputed task gives the same rows.

``restore`` reads only the output and the form. It finds the sentinels, which an arranged
text holds once each: a text that holds one itself stays plain, and two pieces can't form
one across a sentinel.

Results: a null text counts as empty; an empty text is plain; a null ``doc_id`` counts as an
empty key; repeated rows and ties give equal rows; an empty table gives an empty result; a
text of any length is cut as a whole (batches are cut up by bytes, one text at the least);
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
#: The pieces (0 prefix, 1 middle, 2 suffix) of a form in order, each after its sentinel.
FORMS = {"psm": (("P", 0), ("S", 2), ("M", 1)), "spm": (("S", 2), ("P", 0), ("M", 1))}
#: Bytes of text that one output batch is made from.
CHUNK = 8_000_000


def text_buffer(col: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (null: empty)."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    return memoryview(col.buffers()[2] or b""), off


def byte_chunks(off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes, one row at the least."""
    part = (off[:-1] - off[:1]) // max(1, size)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return ((lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo)


def unit_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte opens a unit, and whether it opens a code point."""
    head = (data & 0xC0) != 0x80
    letter = ((data | 0x20) - np.uint8(97)) < 26
    opens = head.copy()
    opens[1:] &= ~(letter[1:] & letter[:-1])
    first = off[:-1][off[:-1] < off[1:]]
    opens[first] = True
    return opens, head


def cut_points(data: np.ndarray, off: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> dict:
    """Units of every row, the bytes of its two cuts, and the code points before each."""
    opens, head = unit_starts(data, off)
    at = np.flatnonzero(opens)
    lo, hi = np.searchsorted(at, off[:-1]), np.searchsorted(at, off[1:])
    n = hi - lo
    k1, k2 = h1 % (n + 1), h2 % (n + 1)
    at = np.append(at, 0)                       # so that an end without a unit can be looked up, too
    cut = [np.where(k < n, at[np.minimum(lo + k, len(at) - 1)], off[1:]) for k in (np.minimum(k1, k2), np.maximum(k1, k2))]
    chars = np.concatenate([[0], np.cumsum(head, dtype=np.int64)])
    return {"n": n, "a": cut[0], "b": cut[1], "prefix": chars[cut[0]] - chars[off[:-1]], "middle": chars[cut[1]] - chars[cut[0]]}


def arrange(start: int, a: int, b: int, stop: int, form: str) -> list[tuple]:
    """Descriptors (buffer, start, stop) of a text cut at ``a`` and ``b``; buffer None is the text."""
    if form not in FORMS:
        return [(None, start, stop)]
    pieces = ((start, a), (a, b), (b, stop))
    return [d for mark, k in FORMS[form] for d in ((SENTINELS[mark], 0, len(SENTINELS[mark])), (None, *pieces[k]))]


def split_output(raw: bytes, start: int, stop: int, form: str) -> list[tuple]:
    """Descriptors of the restored text over an output's bytes."""
    if form not in FORMS:
        return [(None, start, stop)]
    marks = [(raw.index(SENTINELS[m], start, stop), k) for m, k in FORMS[form]]
    ends = [at for at, _ in marks[1:]] + [stop]
    pieces = {k: (None, at + 3, end) for (at, k), end in zip(marks, ends)}
    return [pieces[k] for k in (0, 1, 2)]


def streamed(view: memoryview, table: list[tuple]) -> str:
    h = hashlib.sha256()
    for buffer, lo, hi in table:
        h.update((view if buffer is None else buffer)[lo:hi])
    return h.hexdigest()


def gathered(view: memoryview, tables: list[list[tuple]]) -> pa.Array:
    """A string column of the documents that the descriptors stand for."""
    parts = [(view if buffer is None else buffer)[lo:hi] for table in tables for buffer, lo, hi in table]
    size = np.array([sum(hi - lo for _, lo, hi in table) for table in tables], dtype=np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(tables), pa.py_buffer(off.tobytes()), pa.py_buffer(b"".join(parts)))


def _draws(key: Column) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the key's SHA-256."""
    h = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", keep: tuple = ("doc_id",), seed: str = "1",
                   plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``keep`` columns with n (units), form (plain, psm, spm), prefix_chars, middle_chars (code
    points, null if plain), output (the arranged text) and output_sha256.

    ``seed`` and ``key`` decide cuts and form; ``plain_percent`` of the texts stay as they are,
    ``spm_percent`` of the others have the suffix first.
    """
    draws = _draws(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    made = docs.select(*keep, F.col("text").cast("string").alias("_text"), *draws)
    kept = made.columns[:-5]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema[:-5]] + [
        "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, every = text_buffer(batch.column("_text"))
            data = np.frombuffer(view, dtype=np.uint8)
            for lo, hi in byte_chunks(every, CHUNK):
                own = batch.slice(lo, hi - lo)
                h = [own.column(f"_h{i}").to_numpy() for i in (1, 2, 3, 4)]
                base, off = every[lo], every[lo:hi + 1] - every[lo]
                got = cut_points(data[base:every[hi]], off, h[0], h[1])
                part = view[base:every[hi]]
                raw = bytes(part)
                marked = [any(raw.find(m, s, e) >= 0 for m in SENTINELS.values()) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
                plain = (off[:-1] == off[1:]) | np.array(marked, dtype=bool) | (h[2] % 100 >= 100 - plain_percent)
                form = np.where(plain, "plain", np.where(h[3] % 100 < spm_percent, "spm", "psm"))
                tables = [arrange(*x) for x in zip(off[:-1].tolist(), got["a"].tolist(), got["b"].tolist(), off[1:].tolist(), form.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(c) for c in kept], pa.array(got["n"]), pa.array(form.tolist(), pa.string()),
                     pa.array(got["prefix"], mask=plain), pa.array(got["middle"], mask=plain),
                     gathered(part, tables).cast(pa.string()), pa.array([streamed(part, t) for t in tables], pa.string())],
                    names=[*kept, "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    return made.mapInArrow(run, schema)


def restore(arranged: DataFrame) -> DataFrame:
    """``arranged`` (output, form) with restored, the original text, and restored_sha256."""
    arranged = arranged.drop("restored", "restored_sha256")
    names = arranged.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arranged.schema) + ", restored string, restored_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, every = text_buffer(batch.column("output"))
            for lo, hi in byte_chunks(every, CHUNK):
                own, part = batch.slice(lo, hi - lo), view[every[lo]:every[hi]]
                raw, off = bytes(part), (every[lo:hi + 1] - every[lo]).tolist()
                tables = [split_output(raw, s, e, f) for s, e, f in zip(off, off[1:], own.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(c) for c in names], gathered(part, tables).cast(pa.string()),
                     pa.array([streamed(part, t) for t in tables], pa.string())],
                    names=[*names, "restored", "restored_sha256"])

    return arranged.mapInArrow(run, schema)


def fill_in_middle_sql() -> str:
    """What the registered query returns for the table ``documents``, as DuckDB SQL.

    The restored text is taken apart again at the sentinels of the output."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
k AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
             array_to_string(u[b + 1:n], '') AS suf FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                          ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p),
r AS (SELECT *, CASE form WHEN 'plain' THEN output
      WHEN 'psm' THEN substr(split_part(output, '<S>', 1), 4) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
      ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || substr(split_part(output, '<P>', 1), 4) END AS back FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(back) AS restored_sha256 FROM r"""
