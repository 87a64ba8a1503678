"""File evidence: digests of files, order-independent table fingerprints, checklists.

``file_digest`` hashes files of any size where they are read, a piece at a time
(``sources.byte_ranges``); a store that only Spark can open is read with the ``binaryFile``
source, one file a row, which ends at 2 GB. ``tree_digest`` hashes blocks of a file in
parallel and combines them, for files too long for one task. ``table_fingerprint`` replaces
whole-file hashes of output tables so evidence does not depend on how a table is split into
part files; ``file_state`` keeps it per file, so that an appended table hashes only what is
new and ``compare_states`` names the files that changed.
"""

from __future__ import annotations

import json
from typing import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.session import write_scratch
from modelwatch.sources.byte_ranges import ByteRangeSource, reaches

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def file_digest(spark: SparkSession, paths: str | Sequence[str], with_hash: bool = True) -> DataFrame:
    """(name, path, exists, size_bytes, mtime_epoch, mtime_iso, sha256) per file; a path or
    pattern that matches nothing gives one row with ``exists`` false and NULLs."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    there = [p for p in paths if _matches(spark, p)]
    absent = spark.createDataFrame([(p.rsplit("/", 1)[-1], p, False) for p in paths if p not in there],
                                   "name string, path string, exists boolean")
    ranged = [p for p in there if with_hash and reaches(p)]
    whole = [p for p in there if p not in ranged]
    found = byte_ranges(spark, ranged).select("path", F.col("modified").alias("modificationTime"), F.col("size").alias("length"), "sha256")
    if whole:
        binary = spark.read.format("binaryFile").load(whole)
        digest = F.sha2(F.col("content"), 256) if with_hash else F.lit(None).cast("string")
        found = found.unionByName(binary.select("path", "modificationTime", "length", digest.alias("sha256")))
    cols = [F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.lit(True).alias("exists"),
            F.col("length").alias("size_bytes"),
            F.unix_timestamp("modificationTime").alias("mtime_epoch"),
            F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), ISO_UTC).alias("mtime_iso")]
    return found.select(*cols, *(["sha256"] if with_hash else [])).unionByName(absent, allowMissingColumns=True)


def byte_ranges(spark: SparkSession, paths: Sequence[str], block_bytes: int = 0, partition_bytes: int = 128 << 20) -> DataFrame:
    """Hashed blocks of the files (``sources.byte_ranges``); ``block_bytes`` 0: whole files."""
    spark.dataSource.register(ByteRangeSource)
    return (spark.read.format("byte_ranges").option("paths", json.dumps(list(paths))).option("block_bytes", block_bytes)
            .option("partition_bytes", partition_bytes).load())


def tree_digest(spark: SparkSession, paths: str | Sequence[str], block_bytes: int = 64 << 20, fan: int = 1024,
                partition_bytes: int = 128 << 20) -> DataFrame:
    """(path, size_bytes, n_blocks, tree_sha256) per file: SHA-256 of every block, read in
    parallel; while more than one digest remains, every ``fan`` consecutive ones become the
    SHA-256 of their hex digits. A grouped aggregate a level, of ``fan`` digests at the most."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    blocks = byte_ranges(spark, paths, block_bytes, partition_bytes)
    level = write_scratch(blocks.select("path", "size", (F.col("offset") / block_bytes).cast("long").alias("i"), F.col("sha256").alias("d")), "blocks")
    left = level.agg(F.max("i")).first()[0] or 0
    sizes = level.groupBy("path", F.col("size").alias("size_bytes")).agg(F.count(F.lit(1)).alias("n_blocks"))
    while left:
        left //= fan
        runs = level.groupBy("path", "size", F.expr(f"i div {fan}").alias("i"), F.lit(1).alias("_")).agg(
            F.array_sort(F.collect_list(F.struct("i", "d"))).alias("run"), F.count(F.lit(1)).alias("n"), F.max("i").alias("last"))
        joined = F.sha2(F.array_join(F.transform("run", lambda x: x["d"]), "").cast("binary"), 256)
        # A file whose digest stands alone is done and stays as it is.
        alone = (F.col("last") == 0) & (F.col("i") == 0)
        level = runs.select("path", "size", "i", F.when(alone, F.get("run", F.lit(0))["d"]).otherwise(joined).alias("d"))
    return sizes.join(level.select("path", F.col("d").alias("tree_sha256")), "path")


def _matches(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def content_digest(df: DataFrame, col: str) -> DataFrame:
    """The other columns, with ``size_bytes`` and ``sha256`` of a text column's UTF-8 (NULL for NULL)."""
    return df.select(*[c for c in df.columns if c != col], F.octet_length(col).cast("long").alias("size_bytes"),
                     F.sha2(F.col(col).cast("binary"), 256).alias("sha256"))


def checklist_join(expected: DataFrame, files: DataFrame, name_col: str = "name") -> DataFrame:
    """Expected names left-joined to the files found: (name, present, size_bytes, sha256)."""
    keep = [c for c in ("size_bytes", "sha256") if c in files.columns]
    there = F.col("exists") if "exists" in files.columns else F.lit(True)
    f = files.select(F.col(name_col).alias("name"), there.alias("_there"), *keep)
    j = expected.select(F.col(name_col).alias("name")).join(f, "name", "left")
    return j.select("name", F.coalesce("_there", F.lit(False)).alias("present"), *keep)


def table_fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(rows, fingerprint): count and an order-independent sum, as text, of the first 60 bits
    of each row's SHA-256 over its cells as text (joined by the unit separator, NULL as the
    zero character; exact up to 2**43 rows). Same rows -> same fingerprint, whatever the
    partitioning or file layout."""
    hashed = df.select(row_hash(cols or df.columns).alias("h"))
    return hashed.agg(F.count(F.lit(1)).cast("long").alias("rows"), hash_sum("h").cast("string").alias("fingerprint"))


def row_hash(cols: Sequence[str]) -> Column:
    """The first 60 bits of a row's SHA-256 over its cells as text."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols]
    digest = F.sha2(F.concat_ws("\x1f", *cells).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_sum(h: str) -> Column:
    """Sum of row hashes as DECIMAL(38,0), from the sums of three parts of 20 bits: adding
    LONGs takes a fraction of the time that adding long decimals does."""
    low, parts = F.lit((1 << 20) - 1), (40, 20, 0)
    sums = [F.sum(F.shiftright(h, k).bitwiseAND(low)).cast("decimal(38,0)") * F.lit(1 << k).cast("decimal(13,0)") for k in parts]
    return (sums[0] + sums[1] + sums[2]).cast("decimal(38,0)")


def file_state(spark: SparkSession, path: str, known: DataFrame | None = None, cols: Sequence[str] | None = None,
               fmt: str = "parquet") -> DataFrame:
    """(file, size_bytes, modified, rows, fingerprint) per data file of the table at ``path``.

    ``known``: an earlier state of the table. Files that it holds with the same size and
    modification time are taken over; only the others are read. The fingerprints add up to
    ``table_fingerprint`` of the whole (``state_of``). Files without rows are not listed."""
    table = spark.read.format(fmt).load(path)
    names = cols or table.columns
    if known is None:
        return _hashed_files(table, names)
    # The listing alone: no content is read for it.
    meta = F.col("_metadata")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        meta["file_path"].alias("file"), meta["file_size"].alias("size_bytes"), meta["file_modification_time"].alias("modified"))
    same = known.join(there, ["file", "size_bytes", "modified"], "left_semi")
    new = [r["file"] for r in there.join(known, ["file", "size_bytes", "modified"], "left_anti").select("file").collect()]
    if not new:
        return same
    # Named files only: the rest of the table is neither opened nor filtered.
    fresh = spark.read.format(fmt).option("basePath", path).schema(table.schema).load([unquote(f) for f in new])
    return same.unionByName(_hashed_files(fresh, names))


def _hashed_files(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    meta = F.col("_metadata")
    rows = table.select(meta["file_path"].alias("file"), meta["file_size"].alias("size_bytes"),
                        meta["file_modification_time"].alias("modified"), row_hash(cols).alias("h"))
    return rows.groupBy("file", "size_bytes", "modified").agg(
        F.count(F.lit(1)).cast("long").alias("rows"), hash_sum("h").cast("string").alias("fingerprint"))


def state_of(state: DataFrame, *by: Column) -> DataFrame:
    """(by..., rows, fingerprint) of the table, or of parts of it by an expression over
    ``file``: as ``table_fingerprint`` gives it for the same rows."""
    return state.groupBy(*by).agg(F.sum("rows").cast("long").alias("rows"),
                                  F.sum(F.col("fingerprint").cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file (a policy, say) through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def compare_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change, rows_before, rows_after) of files that were ``added``, ``removed``,
    ``changed`` (other rows) or ``rewritten`` (the same rows in another file version)."""
    b = before.select("file", F.col("rows").alias("rows_before"), F.col("fingerprint").alias("_b"), F.struct("size_bytes", "modified").alias("_vb"))
    a = after.select("file", F.col("rows").alias("rows_after"), F.col("fingerprint").alias("_a"), F.struct("size_bytes", "modified").alias("_va"))
    j = b.join(a, "file", "full")
    change = (F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
              .when((F.col("_a") != F.col("_b")) | (F.col("rows_before") != F.col("rows_after")), "changed").when(F.col("_va") != F.col("_vb"), "rewritten"))
    return j.select("file", change.alias("change"), "rows_before", "rows_after").where("change is not null")
