"""Cohort build: lab events -> first window after admission -> per-lab median -> wide.

    events --semi/inner join--> target items (label attached)
           --> drop NULL values, keep -1e6 < value < 1e6
           --> join admissions on (subject_id, hadm_id), admittime <= charttime <= admittime + window
           --> left join patients on subject_id
           --> exact median per (admission keys, label)        [distributed exact quantiles]
           --> pivot labels to columns (explicit list, one pass)
           --> left join earliest admittime per hadm_id as charttime
           --> canonical columns, gender NULL -> 'Unknown'
           --> split: global position < n // 2 -> baseline   [distributed row position]

Joins are plain equi-joins; Spark's size estimate and AQE's runtime sizes decide
broadcast vs sort-merge, and AQE splits skewed join keys. The 24 h (or any) window is
a residual predicate on the equi-join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.scalar import in_open_range
from modelwatch.operators.counts import StepCounts, null_key
from modelwatch.operators.prefix import exact_quantiles, row_position

# Fixed values of the reference: target lab labels and their short column names.
LAB_LABELS = {"WHITE BLOOD CELLS": "wbc", "LACTATE": "lactate", "CREATININE": "creatinine"}
COHORT_COLUMNS = ["subject_id", "hadm_id", "anchor_age", "gender", "admission_type",
                  "wbc", "lactate", "creatinine", "charttime", "anchor_year_group"]
EVENT_COLUMNS = ["subject_id", "hadm_id", "charttime", "itemid", "valuenum", "valueuom"]
INDEX_KEYS = ["subject_id", "hadm_id", "admission_type", "anchor_age", "anchor_year_group", "gender"]
DEFAULT_WINDOW = "24 hours"
DEFAULT_GENDER = "Unknown"


def item_lookup(items: DataFrame, labels: Sequence[str] = tuple(LAB_LABELS)) -> DataFrame:
    """(itemid, label) of items whose upper-cased label is a target; label upper-cased."""
    up = F.upper("label")
    return items.where(up.isin(list(labels))).select("itemid", up.alias("label")).distinct()


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail fast when a required lookup is empty (one-row probe, not a count)."""
    if not df.take(1):
        raise RuntimeError(f"No rows for {what}")
    return df


def semi_join_items(events: DataFrame, item_ids: DataFrame) -> DataFrame:
    """Membership filter on itemid (the reference's ``isin(lab_ids)``)."""
    return events.join(item_ids.select("itemid"), "itemid", "left_semi")


def scan_events_filtered(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Keep the event columns, target items only (label attached), non-null values in
    the open sanity range."""
    ev = events.select(*[c for c in EVENT_COLUMNS if c in events.columns])
    ev = ev.where(F.col("valuenum").isNotNull() & ~F.isnan("valuenum"))
    ev = ev.join(targets, "itemid")           # semi-join and label attach in one join
    return ev.where(in_open_range("valuenum"))


def join_events_admissions(labs: DataFrame, admissions: DataFrame, counts: StepCounts | None = None) -> DataFrame:
    """Inner join on (subject_id, hadm_id). Rows with a NULL key join nothing; ``counts`` takes
    their number on both sides and the rows joined, in the same pass."""
    adm = admissions.select("subject_id", "hadm_id", "admittime", "admission_type")
    if counts:
        missing = null_key("subject_id", "hadm_id")
        labs, adm = counts.on(labs, "events", null_keys=missing), counts.on(adm, "admissions", null_keys=missing)
    out = labs.join(adm, ["subject_id", "hadm_id"], "inner")
    return counts.on(out, "events_with_admission") if counts else out


def join_first_window(labs: DataFrame, admissions: DataFrame, window: str = DEFAULT_WINDOW,
                      counts: StepCounts | None = None) -> DataFrame:
    """``join_events_admissions`` with admittime <= charttime <= admittime + window."""
    out = join_events_admissions(labs, admissions, counts)
    lim = F.col("admittime") + F.expr(f"INTERVAL {window}")
    out = out.where((F.col("charttime") >= F.col("admittime")) & (F.col("charttime") <= lim))
    return counts.on(out, "events_in_window") if counts else out


def join_patients(labs: DataFrame, patients: DataFrame, counts: StepCounts | None = None) -> DataFrame:
    """Left join on subject_id. ``counts``: rows without a subject, and without a patient."""
    pat = patients.select("subject_id", "gender", "anchor_age", "anchor_year_group")
    if not counts:
        return labs.join(pat, "subject_id", "left")
    out = labs.join(pat.withColumn("_there", F.lit(True)), "subject_id", "left")
    out = counts.on(out, "events_with_patient", null_keys=null_key("subject_id"), no_patient=F.col("_there").isNull())
    return out.drop("_there")


def median_per_admission(labs: DataFrame, keys: Sequence[str] = (*INDEX_KEYS, "label")) -> DataFrame:
    """Exact median of ``valuenum`` per key tuple; rows with a NULL key are dropped
    (pandas ``groupby`` does the same)."""
    keys = list(keys)
    clean = labs.na.drop(subset=keys)
    return exact_quantiles(clean, "valuenum", [0.5], by=keys, names=["value"]).drop("n")


def pivot_labs(med: DataFrame, labels: dict = LAB_LABELS, index: Sequence[str] = INDEX_KEYS) -> DataFrame:
    """Long -> wide: one column per target label (mean in a cell), named by the short name.
    The explicit value list avoids a distinct pass and keeps empty labels as NULL columns."""
    return rename_labels(pivot_items(med, list(labels), index), labels)


def pivot_items(med: DataFrame, items: Sequence[str], index: Sequence[str] = INDEX_KEYS) -> DataFrame:
    return med.groupBy(*index).pivot("label", list(items)).agg(F.avg("value"))


def rename_labels(wide: DataFrame, labels: dict = LAB_LABELS) -> DataFrame:
    """Item label columns -> short names; other columns stay."""
    return wide.withColumnsRenamed(dict(labels))


def join_admit_time(wide: DataFrame, admissions: DataFrame) -> DataFrame:
    """Earliest admittime per hadm_id (a stable choice of 'first'), as ``charttime``."""
    return wide.join(dedupe_first(admissions), "hadm_id", "left")


def dedupe_first(admissions: DataFrame) -> DataFrame:
    """One row per hadm_id, with its earliest admittime as ``charttime``."""
    return admissions.groupBy("hadm_id").agg(F.min("admittime").alias("charttime"))


def canonical(wide: DataFrame, columns: Sequence[str] = COHORT_COLUMNS) -> DataFrame:
    cols = [c for c in columns if c in wide.columns]
    out = wide.select(*cols)
    if "gender" in cols:
        out = out.withColumn("gender", F.coalesce(F.col("gender"), F.lit(DEFAULT_GENDER)))
    return out


def split_half(df: DataFrame, order: Sequence[str] = ("subject_id", "hadm_id", "charttime")) -> DataFrame:
    """Add ``split``: the first n // 2 rows in ``order`` are 'baseline', the rest 'current'."""
    pos = row_position(df, list(order))
    half = F.floor(F.col("n_rows") / 2)
    return pos.withColumn("split", F.when(F.col("position") < half, "baseline").otherwise("current")) \
              .drop("n_rows")


def build_cohort(events: DataFrame, admissions: DataFrame, patients: DataFrame, items: DataFrame,
                 labels: dict = LAB_LABELS, window: str = DEFAULT_WINDOW,
                 check_items: bool = True) -> DataFrame:
    """The whole cohort with a ``split`` column and the 0-based ``position``."""
    targets = item_lookup(items, list(labels))
    if check_items:
        require_rows(targets, "target lab items")
    labs = scan_events_filtered(events, targets)
    labs = join_first_window(labs, admissions, window)
    labs = join_patients(labs, patients)
    wide = pivot_labs(median_per_admission(labs), labels)
    wide = canonical(join_admit_time(wide, admissions))
    return split_half(wide)


def sample_metadata(cohort: DataFrame) -> DataFrame:
    """Row counts per split, with the column list."""
    cols = [c for c in cohort.columns if c not in ("split", "position")]
    return cohort.groupBy("split").agg(F.count(F.lit(1)).cast("long").alias("rows")) \
                 .withColumn("columns", F.lit(",".join(cols)))


def union_chunks(spark, paths: Sequence[str] | None = None, frames: Sequence[DataFrame] | None = None) -> DataFrame:
    """Append filtered pieces: a multi-path read (one scan, files split across tasks) or a
    ``unionByName`` of frames (no shuffle)."""
    if paths:
        return spark.read.parquet(*paths)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
