"""Run history and audit summaries.

The history table holds the newest ``HISTORY_KEEP`` records of every model, one per record
key. ``append_history`` merges records into it and can be called again with the same ones,
from a retried batch or a replayed stream, without a change. "Last n" views and the merge use
``row_number() <= n`` per model; Spark plans it with a partial ``WindowGroupLimit`` before
the shuffle, so each task forwards at most n rows per model whatever the size of a model's
history. So the table is all the state there is: it is bounded, lies in shared storage, and
no task holds a model's rows beyond the n.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelwatch.functions.scalar import round6
from modelwatch.session import drop_scratch, write_scratch

HISTORY_KEEP = 200       # records kept per model (the reference's cap)
HISTORY_SHOW = 50        # newest records shown
FAIL_WINDOW = 100        # records looked at for recent failures
TOP_FEATURES_CAP = 25
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def history_record(runs: DataFrame, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """A history record per run: ts (UTC ISO text), status, auroc, ks_stat, min_auroc,
    min_ks, reasons. Status is the run's own gate status."""
    now_utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return runs.select(*run_cols, F.date_format(now_utc, ISO_UTC).alias("ts"),
                       F.upper(F.coalesce(F.col("status"), F.lit(""))).alias("status"),
                       "auroc", "ks_stat", "min_auroc", "min_ks",
                       F.coalesce(F.col("reasons"), F.array().cast("array<string>")).alias("reasons"))


def append_history(records: DataFrame, path: str, by: Sequence[str] = ("model",), ts: str = "ts",
                   key: Sequence[str] = ("run_id",), keep: int = HISTORY_KEEP, buckets: int = 64) -> None:
    """Merge records into the history table at ``path`` (Parquet); usable from ``foreachBatch``.

    The table keeps the newest ``keep`` records per ``by`` in the order of ``ts`` and ``key``.
    Records with the ``by`` and ``key`` of another are the same record: the one with the
    larger ``ts`` stays (then the one already stored). The table is partitioned by a hash of
    ``by`` into ``buckets`` folders; only those that the records touch are written again, each
    replaced as a whole, so a call that died half way is made good by the next with the same
    records. One writer at a time. Columns that a side lacks are NULL."""
    spark, by, key = records.sparkSession, list(by), list(key)
    new = records.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    if _is_table(spark, path):
        touched = [r[0] for r in new.select("bucket").distinct().collect()]        # ``buckets`` at the most
        stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    else:
        both = new.withColumn("_new", F.lit(1))
    newest = Window.partitionBy(*by).orderBy(F.desc(ts), *[F.desc(k) for k in key])
    one = Window.partitionBy(*by, *key).orderBy(F.desc(ts), "_new")
    # Copies of a record go first, within each side's newest; ties beyond ``keep`` can't push a record out.
    kept = both.withColumn("_copy", F.row_number().over(one)).where("_copy = 1").withColumn(
        "_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep).drop("_copy", "_rank", "_new")
    merged = write_scratch(kept, "history")
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    drop_scratch(merged)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The stored records."""
    return spark.read.parquet(path).drop("bucket")


def _is_table(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def history_last_n(history: DataFrame, n: int = HISTORY_KEEP, by: Sequence[str] = ("model",),
                   ts: str = "ts", tiebreak: str | None = None) -> DataFrame:
    """Newest ``n`` records per model, with ``recency`` 1 = newest."""
    order = [F.desc(ts)] + ([F.desc(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(*by).orderBy(*order)
    return history.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def fail_count_recent(history: DataFrame, n: int = FAIL_WINDOW, by: Sequence[str] = ("model",),
                      ts: str = "ts", tiebreak: str | None = None) -> DataFrame:
    """FAIL records among the newest ``n`` per model."""
    last = history_last_n(history, n, by, ts, tiebreak)
    return last.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("n_recent"),
        F.count_if(F.upper(F.coalesce(F.col("status"), F.lit(""))) == "FAIL").cast("long").alias("n_fail"))


def trust_audit_summary(perf: DataFrame, gate: DataFrame, fails: DataFrame, top: DataFrame,
                        run_cols: Sequence[str] = ("run_id",), top_k: int = TOP_FEATURES_CAP) -> DataFrame:
    """One record per run: entries evaluated, drift flags (recent FAILs), max KS
    (0 when absent), policy status (FAIL when absent), the ``top_k`` first features.

    ``top`` is a ranked feature table shared by the runs. ``fails`` holds the run columns
    (each run gets its own flags, 0 when absent), or else is one history that all runs
    share, whose FAILs are summed over its models."""
    feats = top.orderBy(F.desc("mean_abs_impact"), "name").limit(top_k) \
               .agg(F.sort_array(F.collect_list(F.struct(F.negative("mean_abs_impact").alias("k"), "name")))
                    .alias("f")).select(F.transform("f", lambda x: x["name"]).alias("top_features"))
    n_fail = F.coalesce(F.sum("n_fail"), F.lit(0)).cast("long").alias("drift_flags")
    g = gate.select(*run_cols, F.col("status").alias("_gs"))
    j = perf.join(g, list(run_cols), "left")
    if set(run_cols) <= set(fails.columns):
        j = j.join(fails.groupBy(*run_cols).agg(n_fail), list(run_cols), "left")
        flags = F.coalesce(F.col("drift_flags"), F.lit(0))
    else:
        flags = fails.agg(n_fail).select("drift_flags").scalar()
    return j.select(
        *run_cols,
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("entries_evaluated"),
        flags.cast("long").alias("drift_flags"),
        round6(F.coalesce(F.col("ks_stat"), F.lit(0.0))).alias("max_ks"),
        F.upper(F.coalesce(F.col("_gs"), F.lit("FAIL"))).alias("policy_status"),
        feats.select("top_features").scalar().alias("top_features"))
