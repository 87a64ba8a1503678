"""Shared pieces: written intermediate tables, the hold-out rule, batching, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.session import checkpoint_dir


def save(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage: later jobs read files every executor can reach, so a lost executor
    costs only its running tasks. The path is remembered for ``drop``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table written by ``save`` that nothing reads any more."""
    path, spark = getattr(df, "_llm_path", None), df.sparkSession
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def id_remainder(m: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``m`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string expression, as DuckDB SQL."""
    bit = "list_reduce([u, 1, 1, 1, 1, 1, 1, 1, 1], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))), "
            f"lambda a, b: {bit.replace('u,', 'xor(a, b),')}), 4294967295)")


#: Slots of ``slot_of``: so many that a share of rows has a cut above 0 at any size.
SLOTS = 1 << 62


def slot_of(*cols: str) -> Column:
    """A fixed pseudo-random slot 0 .. SLOTS - 1 of a row, for bounded samples."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def bounded(df: DataFrame, key: str, most: int, total: int | None = None) -> DataFrame:
    """About ``most`` rows of ``df`` at the most, picked by a hash of ``key``."""
    total = df.count() if total is None else total
    if total <= most:
        return df
    return df.where(slot_of(key) < int(most / total * SLOTS))


def chunks(frames: Iterator[pd.DataFrame], chars: int, col: str = "text") -> Iterator[pd.DataFrame]:
    """Cut incoming frames into runs of rows of about ``chars`` characters (one row at least)."""
    for pdf in frames:
        if not len(pdf):
            continue
        size = pdf[col].str.len().fillna(0).to_numpy(dtype=np.int64)
        part = np.cumsum(size) // max(1, chars)
        edges = np.flatnonzero(np.diff(part)) + 1
        lo = 0
        for hi in [*edges.tolist(), len(pdf)]:
            yield pdf.iloc[lo:hi]
            lo = hi


def release() -> None:
    """Hand memory that is free back to the system. A Python worker serves the tasks of one
    stage after another, and its allocators would keep the largest that any of them needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
    if trim is not None:
        trim(0)


def per_text(docs: DataFrame, keep: list, make: Callable, schema: str, chars: int = 4_000_000) -> DataFrame:
    """``keep`` columns of every row, with the columns that a text function computes.

    ``make()`` runs once per task and returns a function from a list of texts (None for
    null) to a dict of equally long columns named as in ``schema``. Only the text goes
    through Python, about ``chars`` characters at a time; what they give is handed on before
    the next are read.
    """
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for series in batches:
            for p in chunks(iter([pd.DataFrame({"text": series})]), chars):
                yield pd.DataFrame(work([t if isinstance(t, str) else None for t in p["text"]]))
            release()

    out = docs.select(*keep, run(F.col("text").cast("string")).alias("_made"))
    return out.select(*[c for c in out.columns if c != "_made"], "_made.*")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs (a[i], b[i]) for each of 0 .. n-1."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (u, v): root is the smallest node reachable.

    Alternating large-star / small-star rounds. Each round is two grouped minima (combined
    before the shuffle, so a node with very many edges is one row per task) joined back to
    the edges; each round's edges are written to the shared folder. Ends when a round
    changes nothing.
    """
    e = (edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = save(e, "edges")
    sign = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    last = tuple(e.agg(*sign).first())
    while last[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt = save(small, "edges")
        now = tuple(nxt.agg(*sign).first())
        drop(e)
        e = nxt
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
