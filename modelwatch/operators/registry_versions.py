"""The policy registry as versions in time, and the version that judged a run.

A registry file lists policies (id, version, file of thresholds, owner, last review, notes,
schema version, active) and a history of earlier versions. Files are read by Spark, one row a
file (YAML or JSON; parsed a file at a time in tasks), so a registry may be a folder of many.
A version is in force from its review to the next review of the same policy; the earliest
also covers what came before it. A version without a threshold file of its own (the history
of the files names none) judges nothing: its checks are SKIP, and the run still says which
version it fell under.

``judge_runs`` joins runs to versions on the policy and the interval that holds the run's
time. It is an equi-join on the policy with the interval as a residual, so Spark broadcasts a
small registry and shuffles a large one. Runs outside any version, or of an unknown policy,
keep a row with NULL version and result SKIP.
"""

from __future__ import annotations

import json
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelwatch.operators.gate import check_specs

ENTRY = ("registry string, policy_id string, version string, file string, owner string, last_review date, notes string, "
         "schema_version int, active boolean, current boolean")
CHECKS = "file string, check string, metric string, op string, threshold double"


def parse_document(text: str) -> dict:
    """A YAML or JSON document as a dictionary; anything else, or a broken one, is empty."""
    try:
        out = json.loads(text)
    except ValueError:
        try:
            import yaml
            out = yaml.safe_load(text)
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML module on the executors; JSON does not") from e
        except yaml.YAMLError:
            out = None
    return out if isinstance(out, dict) else {}


def _files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")


def registry_entries(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per policy version in the registry files, with ``current`` false for history."""
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for pdf in frames:
            rows = []
            for name, text in zip(pdf["name"], pdf["value"]):
                doc = parse_document(text)
                for part, now in (("policies", True), ("history", False)):
                    for e in doc.get(part) or []:
                        if isinstance(e, dict) and e.get("id") is not None:
                            text_of = (lambda k: None if e.get(k) is None else str(e[k]))
                            day = pd.to_datetime(text_of("last_review"), errors="coerce")
                            schema = pd.to_numeric(text_of("schema_version"), errors="coerce")
                            rows.append((name, text_of("id"), text_of("version"), text_of("file"), text_of("owner"),
                                         None if pd.isna(day) else day.date(), text_of("notes"),
                                         None if pd.isna(schema) else int(schema), bool(e.get("active", now)) and now, now))
            yield pd.DataFrame(rows, columns=names).astype({"schema_version": "Int32"})

    return _files(spark, paths).mapInPandas(parse, ENTRY)


def policy_checks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, check, metric, op, threshold): the checks of every threshold file."""
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(name, *spec) for name, text in zip(pdf["name"], pdf["value"]) for spec in check_specs(parse_document(text))],
                               columns=["file", "check", "metric", "op", "threshold"])

    return _files(spark, paths).mapInPandas(parse, CHECKS)


def policy_versions(entries: DataFrame) -> DataFrame:
    """``entries`` with valid_from (NULL: since ever) and valid_to (NULL: until now; exclusive).

    Of two versions with the same review date the current one, then the larger version, counts."""
    in_time = Window.partitionBy("policy_id").orderBy("last_review")
    one = entries.withColumn("_n", F.row_number().over(
        Window.partitionBy("policy_id", "last_review").orderBy(F.desc("current"), F.desc("version")))).where("_n = 1").drop("_n")
    first = F.row_number().over(in_time) == 1
    return one.withColumn("valid_from", F.when(~first, F.col("last_review"))).withColumn("valid_to", F.lead("last_review").over(in_time))


def judge_runs(observed: DataFrame, versions: DataFrame, checks: DataFrame, run_cols: Sequence[str] = ("run_id",),
               ts: str = "ts", policy: str = "policy_id") -> DataFrame:
    """(run columns, policy_id, version, owner, check, value, op, threshold, result) per run and
    check of the version in force at ``ts``; one row with NULL check where none is."""
    runs = observed.withColumn("_day", F.to_date(ts)).withColumn("_policy", F.col(policy))
    v = versions.select(F.col("policy_id").alias("_id"), "version", "owner", "file", "valid_from", "valid_to")
    holds = ((F.col("_id") == F.col("_policy")) & (F.col("valid_from").isNull() | (F.col("_day") >= F.col("valid_from")))
             & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    own = runs.join(v, holds, "left").join(checks.withColumnRenamed("file", "_file"), F.col("file") == F.col("_file"), "left")
    metrics = [c for c in observed.columns if c not in (*run_cols, ts, policy)]
    value = F.lit(None).cast("double")
    for m in metrics:
        value = F.when(F.col("metric") == m, F.col(f"`{m}`").cast("double")).otherwise(value)
    # An absent attribution artifact is a value of 0, as in ``gate_checks``.
    value = F.when((F.col("metric") == "shap_artifact_present") & value.isNull(), 0.0).otherwise(value)
    t, ok = F.col("threshold"), F.lit(None).cast("boolean")
    for op, test in (("<", value < t), ("<=", value <= t), (">=", value >= t), ("==", value == t)):
        ok = F.when(F.col("op") == op, test).otherwise(ok)
    result = F.when(ok.isNull(), "SKIP").when(ok, "PASS").otherwise("FAIL")
    return own.select(*run_cols, F.col("_policy").alias("policy_id"), "version", "owner", "check", value.alias("value"), "op", "threshold", result.alias("result"))
