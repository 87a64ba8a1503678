"""Scans and sinks: CSV (plain or gzip), typed CSV, prediction CSV, JSON reports,
run-log metric files, and Parquet / CSV / JSON sinks.

All readers are Spark DataSource reads run by the executors. Gzip files are not
splittable, so a gzip scan is repartitioned right after reading.
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.session import drop_scratch, shuffle_partitions, write_scratch

TS_COLUMNS = ("admittime", "charttime")
PREDICTION_SCHEMA = "y_true string, y_pred_prob string"
BOM = "﻿"


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system (works for shared stores, not just local)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    st = p.getFileSystem(conf).globStatus(p)
    return st is not None and len(st) > 0


def scan_csv_any(spark: SparkSession, base: str, schema: T.StructType | str | None = None,
                 header: bool = True) -> DataFrame:
    """Read ``base + '.gz'`` if present, else ``base``; error if neither exists."""
    gz = base + ".gz"
    reader = spark.read.option("header", header)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    if _exists(spark, gz):
        return reader.csv(gz).repartition(shuffle_partitions(spark))
    if _exists(spark, base):
        return reader.csv(base)
    raise FileNotFoundError(f"Missing: {gz} and {base}")


def scan_typed_csv(spark: SparkSession, path: str, ts_cols: Sequence[str] = TS_COLUMNS,
                   schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; the timestamp columns present are parsed (bad text -> NULL)."""
    r = spark.read.option("header", True)
    df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    return df.select(*[F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz").alias(c)
                       if c in ts_cols and not isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType))
                       else F.col(c) for c in df.columns])


def strip_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def scan_predictions(spark: SparkSession, path: str, y: str = "y_true", s: str = "y_pred_prob",
                     keep_rejects: bool = False, counts=None) -> DataFrame:
    """(y_true INT, y_score DOUBLE) from a prediction CSV; BOM stripped from the header;
    a row with an unparsable label or score is dropped whole (``keep_rejects`` keeps
    them with NULLs so they can be counted; ``counts``, a ``StepCounts``, counts them in the
    same scan)."""
    raw = strip_bom(spark.read.option("header", True).option("inferSchema", False).csv(path))
    out = raw.select(F.col(y).try_cast("int").alias("y_true"), F.col(s).try_cast("double").alias("y_score"))
    if counts:
        out = counts.on(out, "predictions", bad_label=F.col("y_true").isNull(), bad_score=F.col("y_score").isNull())
    if keep_rejects:
        return out
    return out.where(F.col("y_true").isNotNull() & F.col("y_score").isNotNull())


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc VARIANT, _corrupt): one JSON document per file, parsed once, of any shape. A
    malformed file has a NULL ``doc`` and its text in ``_corrupt``, so it is counted, not hidden."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", F.try_parse_json("value").alias("doc"))
    return raw.select("path", "doc", F.when(F.col("doc").isNull(), F.col("value")).alias("_corrupt"))


def scan_json_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Best-effort JSON read: the fields of ``schema`` from each file's document, ``_corrupt``
    and ``path``. A field that is absent or of another type is NULL by itself; the document's
    other fields stand."""
    sch = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return scan_json(spark, path).select(
        *[F.try_variant_get("doc", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in sch.fields], "_corrupt", "path")


def scan_run_log(spark: SparkSession, root: str, layout: str = "tracking") -> DataFrame:
    """Recorded runs as (run_id, metric, ts, value, step) from text lines 'ts value step'.

    ``tracking``: ``<root>/<experiment>/<run_id>/metrics/<metric>`` files (the tracking
    library's layout); ``partitioned``: ``<root>/exp_run=<exp>/<run>/metric=<m>/part-*``
    as written by Spark's ``partitionBy``."""
    if layout == "partitioned":
        raw = spark.read.text(root).select(F.col("exp_run"), F.col("metric"), "value")
        run = F.element_at(F.split("exp_run", "/"), -1)
        metric = F.col("metric")
    else:
        raw = spark.read.text(f"{root}/*/*/metrics/*").select(F.col("_metadata.file_path").alias("p"), "value")
        segs = F.split("p", "/")
        run, metric = F.element_at(segs, -3), F.element_at(segs, -1)
    parts = F.split(F.trim("value"), r"\s+")
    return raw.where(F.length(F.trim("value")) > 0).select(
        run.alias("run_id"), metric.alias("metric"),
        parts[0].try_cast("long").alias("ts"), parts[1].try_cast("double").alias("value"),
        parts[2].try_cast("long").alias("step"))


RUN_KINDS = ("metrics", "params", "tags")


def stream_run_log(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """Streaming read of recorded runs below ``<root>/<experiment>/<run_id>/<kind>/<name>``:
    (run_id, kind, name, ts, value, text, step). A metric's file has lines 'ts value step'; a
    param's or tag's file is its text. Only files not seen before are read."""
    reader = spark.readStream.schema("value string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.text(f"{root}/*/*/*/*", wholetext=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), "value")
    named = raw.select(F.element_at("p", -3).alias("run_id"), F.element_at("p", -2).alias("kind"), F.element_at("p", -1).alias("name"), "value")
    named = named.where(F.col("kind").isin(*RUN_KINDS))
    lines = F.when(F.col("kind") == "metrics", F.split(F.trim("value"), "\n")).otherwise(F.array("value"))
    each = named.select("run_id", "kind", "name", F.explode(lines).alias("line"))
    part, metric = F.split(F.trim("line"), r"\s+"), F.col("kind") == "metrics"
    number = (lambda i, kind: F.when(metric, F.get(part, F.lit(i)).try_cast(kind)))
    return each.where(~metric | (F.length(F.trim("line")) > 0)).select(
        "run_id", "kind", "name", number(0, "long").alias("ts"), number(1, "double").alias("value"),
        F.when(~metric, F.col("line")).alias("text"), number(2, "long").alias("step"))


def update_run_log(spark: SparkSession, root: str, path: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Bring the run table at ``path`` up to date with the files below ``root``, then stop.

    The file source remembers in ``checkpoint`` which files it has read; the state store keeps
    the keys (run, kind, name, step), so a run that is recorded again (retried, or copied to
    another experiment) is not doubled: its first record stays. A batch that is retried
    replaces its own ``batch_id`` folder."""
    runs = stream_run_log(spark, root, files_per_batch).dropDuplicates(["run_id", "kind", "name", "step"])

    def keep(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))

    query = runs.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def write_run_files(files: DataFrame, root: str) -> None:
    """Write (experiment, run_id, kind, name, text) rows as ``<root>/<experiment>/<run_id>/<kind>/<name>``,
    a file a row, by the tasks that hold them (local and mounted folders, and stores that
    ``pyarrow.fs`` knows)."""
    from modelwatch.sources.byte_ranges import locate

    def put(rows) -> None:
        system, base, _ = locate(root)
        for r in rows:
            folder = f"{base}/{r['experiment']}/{r['run_id']}/{r['kind']}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{r['name']}") as out:
                out.write(r["text"].encode("utf-8"))

    files.foreachPartition(put)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, kind, name, ts, value, text, step) of ``update_run_log``'s table."""
    return spark.read.parquet(path).drop("batch_id")


def list_runs(runs: DataFrame, limit: int = 5) -> DataFrame:
    """Distinct run ids, ordered, first ``limit`` (the run listing)."""
    return runs.select("run_id").distinct().orderBy("run_id").limit(limit)


def table_head(df: DataFrame, n: int = 5, order: Sequence[str] | None = None, max_cols: int = 20) -> DataFrame:
    """First ``n`` rows of the first ``max_cols`` columns in an explicit order."""
    cols = df.columns[:max_cols]
    return df.select(*cols).orderBy(*(order or cols[:1])).limit(n)


# ---------------------------------------------------------------- sinks
def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def sink_metrics_long(long: DataFrame, path: str) -> tuple[str, str]:
    """Metrics as (metric, value) rows: Parquet table and JSON lines side by side."""
    long.write.mode("overwrite").parquet(os.path.join(path, "parquet"))
    long.write.mode("overwrite").json(os.path.join(path, "json"))
    return os.path.join(path, "parquet"), os.path.join(path, "json")


def sink_run_log(df: DataFrame, path: str, kind: str, buckets: int = 64) -> str:
    """Add params, metrics, tags or artifacts of runs (run_id and any other columns) to
    ``<path>/run_<kind>``, in folders by a hash of the run.

    Runs in ``df`` replace what is stored of them, so a retried call changes nothing. Only the
    folders that hold such a run are written again. One writer at a time."""
    spark, out = df.sparkSession, os.path.join(path, f"run_{kind}")
    new = write_scratch(df.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))
                        .withColumn("run_date", F.to_date(F.current_timestamp())), "run-log")
    both = new
    if _exists(spark, out):
        touched = [r[0] for r in new.select("bucket").distinct().collect()]        # ``buckets`` at the most
        stored = spark.read.parquet(out).where(F.col("bucket").isin(touched))
        runs = new.select(F.col("run_id").alias("_run")).distinct()
        both = stored.join(runs, stored["run_id"].eqNullSafe(runs["_run"]), "left_anti").unionByName(new, allowMissingColumns=True)
    merged = write_scratch(both, "run-log")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
    for old in (new, merged):
        drop_scratch(old)
    return out


def sink_prep_manifest(spark: SparkSession, path: str, cfg: dict, scaler_table: DataFrame | None,
                       outputs: dict, stats: dict, inputs: dict[str, str] | None = None,
                       output_paths: dict[str, str] | None = None, provenance: dict | None = None) -> str:
    """Preparation manifest under ``path``:

    * ``scaler/``   fitted scaler parameters (one row per column),
    * ``outputs/``  one row per written table: name, rows, order-independent fingerprint,
    * ``stats/``    column profiles per split (``split``, ``when`` = pre / post),
    * ``files/``    one row per file of the ``inputs`` and ``output_paths`` (name -> path): role,
      name, file, size_bytes, sha256,
    * ``config/``   created_at (UTC), the configuration, input and output paths, provenance and
      notes as one JSON record.

    Fingerprints, digests and profiles are Spark jobs; nothing is gathered on the driver
    except the configuration that was passed in.
    """
    import json as _json
    from datetime import datetime, timezone
    from modelwatch.operators.evidence import file_digest, table_fingerprint

    if scaler_table is not None:
        scaler_table.write.mode("overwrite").json(os.path.join(path, "scaler"))
    fps = None
    for name, df in outputs.items():
        fp = table_fingerprint(df).select(F.lit(name).alias("name"), "rows", "fingerprint")
        fps = fp if fps is None else fps.unionByName(fp)
    if fps is not None:
        fps.write.mode("overwrite").json(os.path.join(path, "outputs"))
    st = None
    for (split, when), df in stats.items():
        part = df.select(F.lit(split).alias("split"), F.lit(when).alias("when"), "*")
        st = part if st is None else st.unionByName(part)
    if st is not None:
        st.write.mode("overwrite").json(os.path.join(path, "stats"))
    files = None
    for role, named in (("input", inputs or {}), ("output", output_paths or {})):
        for name, at in named.items():
            part = file_digest(spark, at).where("exists and name not like '.%' and name not like '\\_%'").select(
                F.lit(role).alias("role"), F.lit(name).alias("name"), F.col("name").alias("file"), "size_bytes", "sha256")
            files = part if files is None else files.unionByName(part)
    if files is not None:
        files.write.mode("overwrite").json(os.path.join(path, "files"))
    doc = {"created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "config": cfg, "inputs": inputs or {},
           "outputs": output_paths or {}, "provenance": provenance or {},
           "notes": ["Only numeric feature columns were changed.", "Values were clipped first, then scaled."]}
    spark.createDataFrame([(_json.dumps(doc, sort_keys=True),)], "value string").write.mode("overwrite") \
         .text(os.path.join(path, "config"))
    return path
