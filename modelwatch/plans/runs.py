"""Per-run plans built from the operators: metrics, parity gap and attribution per run,
and the observed record per run that the gates read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.operators import attribution as A
from modelwatch.operators import drift as D
from modelwatch.operators import fairness as FA
from modelwatch.operators import metrics as M
from modelwatch.plans import fixtures as fx

TOPK = 25


def run_performance(spark, sf) -> DataFrame:
    """Metrics per run (a run = a prediction segment)."""
    m = M.performance_metrics(fx.predictions_unique(spark, sf), by=["segment"])
    return m.withColumnRenamed("segment", "run_id")


def run_parity(spark, sf) -> DataFrame:
    rates = FA.positive_rate_by_group(fx.fairness_frame(spark, sf), "gender", "label", by=["segment"])
    return FA.parity_gap(rates, by=["segment"]).withColumnRenamed("segment", "run_id")


def top_feature_table(spark, sf, topk: int = TOPK) -> DataFrame:
    return A.top_features(A.mean_abs_impact(fx.contributions(spark, sf)), topk)


def observed_metrics(spark, sf) -> DataFrame:
    """One record per run: drift (shared pair), performance, fairness gap, attribution."""
    perf = run_performance(spark, sf)
    b, c = fx.drift_pair_lineitem(spark, sf)
    dmax = D.drift_max(D.drift_by_feature(b, c, ignore_cols=fx.LINEITEM_ID_COLS))
    n_top = A.mean_abs_impact(fx.contributions(spark, sf)).agg(F.count(F.lit(1)).cast("long").alias("n"))
    fair = run_parity(spark, sf).select("run_id", "parity_gap", "n_groups")
    j = perf.join(fair, "run_id", "left")
    n = n_top.select("n").scalar()
    d = dmax.select(F.struct("max_psi", "max_ks")).scalar()       # one subquery for both values
    return j.select(
        "run_id", d["max_psi"].alias("max_psi"), d["max_ks"].alias("max_ks"),
        "auroc", "auprc", "log_loss", "ks_stat", "n", "accuracy_at_05", "parity_gap",
        F.col("n_groups").alias("n_fairness_slices"), (n > 0).alias("shap_artifact_present"),
        n.alias("top_features_detected"))
