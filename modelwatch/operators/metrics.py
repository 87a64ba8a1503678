"""Scored-prediction metrics, overall or per segment.

All rank-based metrics (AUROC, score KS, AUPRC, best-F1) come from ONE pre-aggregated
score table (one row per (segment, distinct score) with positive / negative counts) and
one distributed running total over it (``prefix.running_totals``). The row-by-row
rescans of the reference (O(n * distinct scores)) become one O(n log n) plan:

    predictions -> partial agg by (segment, score) -> shuffle -> running totals (bucketed
    window) -> partial agg by segment -> tiny shuffle -> one row per segment.

Formulas per score row with counts p (y = 1), n (y = 0), inclusive totals cp, cn and
class totals P, N:
    AUROC  = sum(p * (cn - n + n/2)) / (P * N)      (Mann-Whitney U, ties count half)
    KS     = max |cp/P - cn/N|                      (evaluated at tie-group ends)
    AUPRC  = sum(tp/(tp+fp) * p/P), tp = P-cp+p, fp = N-cn+n (thresholds = distinct scores)
    F1(t)  = 2tp / (tp + fp + P); best over {0, 1} U scores, ties -> closest to 0.5, then lower
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.scalar import LOG_LOSS_EPS, round6
from modelwatch.operators.prefix import running_totals

METRIC_COLUMNS = ["n", "n_samples", "positive_rate", "accuracy_at_05", "f1_at_05",
                  "best_f1_threshold", "best_f1", "auroc", "ks_stat", "auprc", "log_loss"]
BASIC_COLUMNS = ["n", "n_samples", "accuracy_at_05", "auroc", "ks_stat"]


def _label(y: str) -> Column:
    return F.col(y).try_cast("int")


def _score(s: str) -> Column:
    return F.col(s).try_cast("double")


def valid_prediction(y: str = "y_true", s: str = "y_score") -> Column:
    """Label in {0, 1} and a non-null, non-NaN score (other rows are dropped and counted)."""
    sc = _score(s)
    return _label(y).isin(0, 1) & sc.isNotNull() & ~F.isnan(sc)


def prediction_rejects(df: DataFrame, y: str = "y_true", s: str = "y_score",
                       by: Sequence[str] = ()) -> DataFrame:
    """Rows kept and dropped per segment (bad label, or NULL / NaN score)."""
    ok = valid_prediction(y, s)
    return df.groupBy(*by).agg(
        F.count_if(ok).cast("long").alias("n_kept"),
        F.count_if(~F.coalesce(ok, F.lit(False))).cast("long").alias("n_dropped"))


def score_table(df: DataFrame, y: str = "y_true", s: str = "y_score",
                by: Sequence[str] = ()) -> DataFrame:
    """One row per (segment, distinct score): p = count(y = 1), n = count(y = 0)."""
    yl = _label(y)
    return (df.where(valid_prediction(y, s))
              .groupBy(*by, _score(s).alias("score"))
              .agg(F.sum(F.when(yl == 1, 1).otherwise(0)).cast("long").alias("p"),
                   F.sum(F.when(yl == 0, 1).otherwise(0)).cast("long").alias("n")))


def ranked_scores(df: DataFrame, y: str = "y_true", s: str = "y_score",
                  by: Sequence[str] = (), n_parts: int | None = None) -> DataFrame:
    """Score table with running totals ``cum_p``, ``cum_n`` and totals ``tot_p``, ``tot_n``."""
    return running_totals(score_table(df, y, s, by), "score", ["p", "n"], by, n_parts=n_parts)


def _f1(tp: Column, fp: Column, P: Column) -> Column:
    """Closed form 2tp/(2tp+fp+fn) with fn = P - tp; 0.0 when tp = 0. Equal F1 values are
    bit-equal, so tie-breaks are exact."""
    return F.when(tp > 0, F.try_divide(F.lit(2.0) * tp, tp + fp + P)).otherwise(F.lit(0.0))


def _cand(neg_f1: Column, dist: Column, t: Column) -> Column:
    return F.struct(neg_f1.cast("double").alias("a"), dist.cast("double").alias("b"),
                    t.cast("double").alias("c"))


def raw_metrics(df: DataFrame, y: str = "y_true", s: str = "y_score", by: Sequence[str] = (),
                thr: float = 0.5, n_parts: int | None = None) -> DataFrame:
    """All metrics per segment, unrounded, plus the classification counts at ``thr``."""
    by = list(by)
    r = ranked_scores(df, y, s, by, n_parts)
    sc, p, n = F.col("score"), F.col("p"), F.col("n")
    cp, cn, P, N = F.col("cum_p"), F.col("cum_n"), F.col("tot_p"), F.col("tot_n")
    ge = sc >= F.lit(thr)
    clip = F.least(F.greatest(sc, F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    tp_row = P - cp + p
    fp_row = N - cn + n
    g = r.groupBy(*by).agg(
        F.max(P).alias("_P"), F.max(N).alias("_N"),
        F.sum(F.when(ge, p).otherwise(n)).alias("_correct"),
        F.sum(F.when(ge, p).otherwise(0)).alias("tp"),
        F.sum(F.when(ge, n).otherwise(0)).alias("fp"),
        F.sum(p * -F.ln(clip) + n * -F.ln(F.lit(1.0) - clip)).alias("_ll"),
        F.sum(p * ((cn - n).cast("double") + F.lit(0.5) * n)).alias("_U"),
        F.max(F.abs(F.try_divide(cp, P) - F.try_divide(cn, N))).alias("_ks"),
        F.sum(F.try_divide(tp_row, tp_row + fp_row) * F.try_divide(p, P)).alias("_auprc"),
        F.min(_cand(-_f1(tp_row, fp_row, P), F.abs(sc - F.lit(0.5)), sc)).alias("_best"),
        F.sum(F.when(sc >= 0.0, p).otherwise(0)).alias("_tp0"),
        F.sum(F.when(sc >= 0.0, n).otherwise(0)).alias("_fp0"),
        F.sum(F.when(sc >= 1.0, p).otherwise(0)).alias("_tp1"),
        F.sum(F.when(sc >= 1.0, n).otherwise(0)).alias("_fp1"),
    )
    Pg = F.coalesce(F.col("_P"), F.lit(0)).cast("long")
    Ng = F.coalesce(F.col("_N"), F.lit(0)).cast("long")
    ntot = Pg + Ng
    has = ntot > 0
    both = (Pg > 0) & (Ng > 0)
    tp = F.coalesce(F.col("tp"), F.lit(0)).cast("long")
    fp = F.coalesce(F.col("fp"), F.lit(0)).cast("long")
    best = F.least(F.col("_best"),
                   _cand(-_f1(F.col("_tp0"), F.col("_fp0"), Pg), F.lit(0.5), F.lit(0.0)),
                   _cand(-_f1(F.col("_tp1"), F.col("_fp1"), Pg), F.lit(0.5), F.lit(1.0)))
    return g.select(
        *by,
        ntot.alias("n"),
        Pg.alias("n_pos"),
        Ng.alias("n_neg"),
        tp.alias("tp"), fp.alias("fp"), (Pg - tp).alias("fn"),
        F.try_divide(Pg, ntot).alias("positive_rate"),
        F.try_divide(F.col("_correct"), ntot).alias("accuracy_at_05"),
        _f1(tp, fp, Pg).alias("f1_at_05"),
        F.when(has, best["c"]).alias("best_f1_threshold"),
        F.when(has, -best["a"]).alias("best_f1"),
        F.when(both, F.try_divide(F.col("_U"), Pg.cast("double") * Ng)).alias("auroc"),
        F.when(both, F.col("_ks")).alias("ks_stat"),
        F.when(has & (Pg > 0), F.col("_auprc")).alias("auprc"),
        F.when(has, F.try_divide(F.col("_ll"), ntot)).alias("log_loss"),
    )


def _rounded(m: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    out = []
    for c in cols:
        if c in ("n", "n_samples", "n_pos", "n_neg", "tp", "fp", "fn"):
            out.append(F.col("n" if c == "n_samples" else c).cast("long").alias(c))
        else:
            out.append(round6(c).alias(c))
    return m.select(*by, *out)


def performance_metrics(df: DataFrame, y: str = "y_true", s: str = "y_score",
                        by: Sequence[str] = (), thr: float = 0.5,
                        n_parts: int | None = None) -> DataFrame:
    """The 11-metric record per segment, rounded to 6 places at the output."""
    return _rounded(raw_metrics(df, y, s, by, thr, n_parts), by, METRIC_COLUMNS)


def basic_performance(df, y="y_true", s="y_score", by=(), thr=0.5, n_parts=None) -> DataFrame:
    """Short record: n, accuracy, AUROC, KS (NULLs when n = 0)."""
    return _rounded(raw_metrics(df, y, s, by, thr, n_parts), by, BASIC_COLUMNS)


def threshold_metrics(df: DataFrame, y: str = "y_true", s: str = "y_score", by: Sequence[str] = (),
                      thr: float = 0.5) -> DataFrame:
    """Counts at ``thr``, accuracy, F1 and log loss per segment, unrounded: one grouped
    aggregate over the rows, without ranks."""
    by = list(by)
    sc, pos = _score(s), _label(y) == 1
    hit = sc >= F.lit(thr)
    clip = F.least(F.greatest(sc, F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    g = df.where(valid_prediction(y, s)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("_P"),
        F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"),
        F.sum(-F.ln(F.when(pos, clip).otherwise(F.lit(1.0) - clip))).alias("_ll"))
    n, P, tp, fp = F.col("n"), F.col("_P"), F.col("tp"), F.col("fp")
    return g.select(*by, "n", "tp", "fp", (P - tp).alias("fn"),
                    F.try_divide(P, n).alias("positive_rate"),
                    F.try_divide(tp + (n - P - fp), n).alias("accuracy_at_05"),
                    _f1(tp, fp, P).alias("f1_at_05"),
                    F.try_divide(F.col("_ll"), n).alias("log_loss"))


def classification_counts(df, y="y_true", s="y_score", by=(), thr=0.5) -> DataFrame:
    return _rounded(threshold_metrics(df, y, s, by, thr), by, ["n", "positive_rate", "tp", "fp", "fn"])


def accuracy_at_threshold(df, y="y_true", s="y_score", by=(), thr=0.5) -> DataFrame:
    return _rounded(threshold_metrics(df, y, s, by, thr), by, ["n", "accuracy_at_05"])


def f1_at_threshold(df, y="y_true", s="y_score", by=(), thr=0.5) -> DataFrame:
    tp = F.col("tp")
    precision = F.coalesce(F.try_divide(tp, tp + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + F.col("fn")), F.lit(0.0))
    return threshold_metrics(df, y, s, by, thr).select(
        *by, "n", round6(precision).alias("precision_at_05"), round6(recall).alias("recall_at_05"),
        round6("f1_at_05").alias("f1_at_05"))


def auroc(df, y="y_true", s="y_score", by=()) -> DataFrame:
    return _rounded(raw_metrics(df, y, s, by), by, ["n", "auroc"])


def score_ks(df, y="y_true", s="y_score", by=()) -> DataFrame:
    return _rounded(raw_metrics(df, y, s, by), by, ["n", "ks_stat"])


def auprc(df, y="y_true", s="y_score", by=()) -> DataFrame:
    return _rounded(raw_metrics(df, y, s, by), by, ["n", "auprc"])


def log_loss(df, y="y_true", s="y_score", by=()) -> DataFrame:
    return _rounded(threshold_metrics(df, y, s, by), by, ["n", "log_loss"])


def best_f1(df, y="y_true", s="y_score", by=()) -> DataFrame:
    return _rounded(raw_metrics(df, y, s, by), by, ["n", "best_f1_threshold", "best_f1"])


def average_rank(df, y="y_true", s="y_score", by=()) -> DataFrame:
    """Average (tie-averaged, 1-based) rank of every distinct score per segment."""
    r = ranked_scores(df, y, s, by)
    ties = F.col("p") + F.col("n")
    return r.select(*by, "score", ties.alias("n_ties"),
                    (F.col("cum_p") + F.col("cum_n") - (ties - 1).cast("double") / 2).alias("avg_rank"))


def running_counts(df, y="y_true", s="y_score", by=()) -> DataFrame:
    """Running positives / negatives along ascending score, per segment."""
    r = ranked_scores(df, y, s, by)
    return r.select(*by, "score", "p", "n", "cum_p", "cum_n")


def distinct_scores(df, s="y_score", by=()) -> DataFrame:
    return df.where(F.col(s).isNotNull()).select(*by, F.col(s).alias("score")).distinct()


def metrics_long(metrics: DataFrame, by: Sequence[str] = (), run_col: str | None = None) -> DataFrame:
    """(segment..., metric, value) rows from a metrics record (``unpivot``)."""
    ids = list(by) + ([run_col] if run_col else [])
    vals = [c for c in metrics.columns if c not in ids]
    return metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in vals]).unpivot(
        ids, vals, "metric", "value")
