"""Incremental monitoring with Structured Streaming.

Prediction files arriving in a folder are processed as micro-batches; each batch is
scored (``performance_metrics``), gated (``gate_basic``) and its history record is
added to the history table, the reference's per-run "validate, then append history"
step made incremental. Each batch overwrites only its own ``batch_id`` partition, so a
retried batch is idempotent; with the stream checkpoint in the shared checkpoint folder
(at a path derived from the history table) a restarted driver or a lost executor
resumes where it stopped without duplicate records.
"""

from __future__ import annotations

import hashlib
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modelwatch.operators.gate import gate_basic
from modelwatch.operators.metrics import performance_metrics
from modelwatch.session import checkpoint_dir


def batch_record(batch: DataFrame, batch_id: int, by: Sequence[str] = (), y: str = "y_true",
                 s: str = "y_score") -> DataFrame:
    """One history record per (batch, segment): metrics, gate status and reasons."""
    by = list(by)
    perf = performance_metrics(batch, y, s, by)
    j = gate_basic(perf, run_cols=perf.columns)     # metrics carried through, no join
    return j.select(F.lit(int(batch_id)).cast("long").alias("batch_id"), *by,
                    F.current_timestamp().alias("ts"), "n", "auroc", "ks_stat", "auprc", "log_loss",
                    "status", "reasons")


def monitor_stream(spark: SparkSession, source: str, schema: str, history_path: str,
                   by: Sequence[str] = (), files_per_batch: int | None = None,
                   checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the monitor over Parquet prediction files in ``source``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source)
    # Stable location per history table, so a restarted driver resumes the same stream.
    tag = hashlib.sha1(history_path.encode("utf-8")).hexdigest()[:16]
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/modelwatch-stream/{tag}"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        # Idempotent: a retried batch overwrites its own batch_id partition only.
        (batch_record(batch, batch_id, by).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(history_path))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
