"""Per-feature drift between a baseline and a current table: PSI and two-sample KS.

No loop over columns and no job per column: both tables are unpivoted once to
(feature, value), tagged with their side, and pre-aggregated to one row per
(feature, distinct value) with counts ``nb`` (baseline) and ``nc`` (current). Then one
distributed running total (``prefix.running_totals``, one group per feature) gives:

* two-sample KS = max |cum_nb/Nb - cum_nc/Nc| over distinct values (exact),
* the baseline's exact p1 / p99 (NumPy ``linear`` percentiles) from cum_nb,
* PSI histograms: 10 bins between p1 and p99 of the baseline, bins [a, b), the last
  [a, b]; values outside are ignored; shares = count / max(in-range total, 1) clipped
  to [1e-6, 1] and not renormalised; PSI = sum((cur - base) * ln(cur / base)).

The per-feature side tables have one row per column of the input, a bound set by the
schema, so they are broadcast.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import drift_columns, infer_roles
from modelwatch.functions.scalar import clean_double, is_finite, np_lerp, round6
from modelwatch.operators.prefix import range_parts, running_totals

# Fixed values of the reference.
PSI_BINS = 10
PSI_LOW_Q, PSI_HIGH_Q = 0.01, 0.99
SHARE_FLOOR = 1e-6
DRIFT_FLAG_LEVEL = 0.10


def drift_long(df: DataFrame, cols: Sequence[str], side: str) -> DataFrame:
    """(feature, value, side) rows with finite values only (NULL, NaN and inf dropped)."""
    cols = list(cols)
    wide = df.select(*[clean_double(c).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "value")
    return long.where(is_finite("value")).withColumn("side", F.lit(side))


def value_counts(baseline: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per (feature, value): nb, nc. Map-side combined before the shuffle."""
    both = drift_long(baseline, cols, "b").unionByName(drift_long(current, cols, "c"))
    return both.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "b").cast("long").alias("nb"),
        F.count_if(F.col("side") == "c").cast("long").alias("nc"))


def _covers(start: Column, end: Column, pos: Column) -> Column:
    return (start <= pos) & (pos < end)


def _quantile_parts(q: float, name: str) -> list[Column]:
    n = F.col("tot_nb")
    start = F.col("cum_nb") - F.col("nb")
    h = (n - 1).cast("double") * F.lit(q)
    lo = F.floor(h)
    hi = F.least(lo + 1, n - 1)
    has = F.col("nb") > 0
    return [F.max(F.when(has & _covers(start, F.col("cum_nb"), lo), F.col("value"))).alias(f"_{name}_lo"),
            F.max(F.when(has & _covers(start, F.col("cum_nb"), hi), F.col("value"))).alias(f"_{name}_hi")]


def _quantile_value(q: float, name: str) -> Column:
    h = (F.col("n_base") - 1).cast("double") * F.lit(q)
    return np_lerp(F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), h - F.floor(h)).alias(name)


def feature_stats(counts: DataFrame, n_parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(value counts in range parts, per-feature stats: n_base, n_curr, ks, p1, p99)."""
    counts = range_parts(counts, ["feature", "value"], n_parts)
    r = running_totals(counts, "value", ["nb", "nc"], ["feature"])
    g = r.groupBy("feature").agg(
        F.max("tot_nb").alias("n_base"), F.max("tot_nc").alias("n_curr"),
        F.max(F.abs(F.try_divide("cum_nb", "tot_nb") - F.try_divide("cum_nc", "tot_nc"))).alias("ks"),
        *_quantile_parts(PSI_LOW_Q, "p1"), *_quantile_parts(PSI_HIGH_Q, "p99"))
    stats = (g.where((F.col("n_base") > 0) & (F.col("n_curr") > 0))
              .select("feature", "n_base", "n_curr", "ks",
                      _quantile_value(PSI_LOW_Q, "p1"), _quantile_value(PSI_HIGH_Q, "p99")))
    # One row per column, a bound set by the schema, read twice (PSI edges and the output):
    # taken once, as literals, instead of running the window and aggregate again.
    rows = [tuple(r) for r in stats.collect()]
    return counts, counts.sparkSession.createDataFrame(rows, stats.schema)


def _bin_expr(bins: int) -> Column:
    """1-based bin: 1 + number of inner edges <= value (edge i = p1 + i * step)."""
    step = (F.col("p99") - F.col("p1")) / F.lit(float(bins))
    b = F.lit(1)
    for i in range(1, bins):
        b = b + F.when(F.col("value") >= F.col("p1") + F.lit(float(i)) * step, 1).otherwise(0)
    return b


def _share(cnt: Column, tot: Column) -> Column:
    s = cnt / F.greatest(tot, F.lit(1)).cast("double")
    return F.least(F.greatest(s, F.lit(SHARE_FLOOR)), F.lit(1.0))


def psi_table(counts: DataFrame, stats: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """(feature, psi) from value counts and the baseline p1 / p99 edges."""
    e = counts.join(F.broadcast(stats.select("feature", "p1", "p99")), "feature")
    e = e.where((F.col("value") >= F.col("p1")) & (F.col("value") <= F.col("p99")))
    e = e.withColumn("_bin", _bin_expr(bins))
    aggs = []
    for k in range(1, bins + 1):
        aggs.append(F.sum(F.when(F.col("_bin") == k, F.col("nb")).otherwise(0)).alias(f"_b{k}"))
        aggs.append(F.sum(F.when(F.col("_bin") == k, F.col("nc")).otherwise(0)).alias(f"_c{k}"))
    h = e.groupBy("feature").agg(*aggs)
    tb = sum((F.col(f"_b{k}") for k in range(1, bins + 1)), F.lit(0))
    tc = sum((F.col(f"_c{k}") for k in range(1, bins + 1)), F.lit(0))
    terms = []
    for k in range(1, bins + 1):
        eb, ac = _share(F.col(f"_b{k}"), tb), _share(F.col(f"_c{k}"), tc)
        terms.append((ac - eb) * F.ln(ac / eb))
    psi = sum(terms[1:], terms[0])
    # Features whose baseline has no value inside [p1, p99] cannot happen (p1 and p99 are
    # baseline values), so every stats row gets a histogram row.
    return h.select("feature", F.when(F.isnan(psi) | (F.abs(psi) == float("inf")), 0.0)
                    .otherwise(psi).alias("psi"))


def drift_by_feature(baseline: DataFrame, current: DataFrame, ignore_cols=(),
                     cols: Sequence[str] | None = None, gate_variant: bool = False,
                     n_parts: int | None = None, rounded: bool = True, bins: int = PSI_BINS,
                     approx: bool = False) -> DataFrame:
    """(feature, psi, ks, drift_flag) for every comparable column with data on both sides.

    ``approx`` takes both from quantile sketches (``sketch_drift``, which also tells how far
    off they can be): no row per value is shuffled."""
    cols = list(cols) if cols is not None else drift_columns(baseline, current, ignore_cols, gate_variant)
    spark = baseline.sparkSession
    if not cols:
        return spark.createDataFrame([], "feature string, psi double, ks double, drift_flag boolean")
    if approx:
        j = _sketched(baseline, current, cols, bins)
    else:
        counts, stats = feature_stats(value_counts(baseline, current, cols), n_parts)
        j = psi_table(counts, stats, bins).join(F.broadcast(stats.select("feature", "ks")), "feature")
    flag = (F.col("psi") >= DRIFT_FLAG_LEVEL) | (F.col("ks") >= DRIFT_FLAG_LEVEL)
    out = j.select("feature", "psi", "ks", flag.alias("drift_flag"))
    if rounded:
        out = out.select("feature", round6("psi").alias("psi"), round6("ks").alias("ks"), "drift_flag")
    return out


def _sketched(baseline: DataFrame, current: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    from modelwatch.operators.sketch_drift import sketched_drift
    return sketched_drift(baseline, current, cols, bins)


def psi(baseline: DataFrame, current: DataFrame, cols: Sequence[str], bins: int = PSI_BINS, approx: bool = False) -> DataFrame:
    """(feature, psi) over ``bins`` bins; ``approx``: from quantile sketches."""
    if bins < 1:
        raise ValueError("bins must be 1 or more")
    if approx:
        table = _sketched(baseline, current, cols, bins)
    else:
        counts, stats = feature_stats(value_counts(baseline, current, cols))
        table = psi_table(counts, stats, bins)
    return table.select("feature", round6("psi").alias("psi"))


def ks_two_sample(baseline: DataFrame, current: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """(feature, ks); ``approx``: from quantile sketches."""
    if approx:
        return _sketched(baseline, current, cols, PSI_BINS).select("feature", round6("ks").alias("ks"))
    _, stats = feature_stats(value_counts(baseline, current, cols))
    return stats.select("feature", round6("ks").alias("ks"))


def psi_edges(baseline: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Baseline p1 / p99 per feature (the PSI bin range)."""
    _, stats = feature_stats(value_counts(baseline, current, cols))
    return stats.select("feature", F.col("n_base").cast("long").alias("n_base"),
                        round6("p1").alias("p1"), round6("p99").alias("p99"))


def drift_max(drift: DataFrame) -> DataFrame:
    """max_psi, max_ks over the per-feature table; NULLs when no column qualifies."""
    return drift.agg(F.max("psi").alias("max_psi"), F.max("ks").alias("max_ks"))


# ---------------------------------------------------------------- drift report
def categorical_psi(baseline: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, psi) over category shares; a category absent on one side has share 1e-6."""
    cols = list(cols)

    def longs(df, side):
        w = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
        return (w.unpivot([], cols, "feature", "category").where(F.col("category").isNotNull())
                 .withColumn("side", F.lit(side)))

    both = longs(baseline, "b").unionByName(longs(current, "c"))
    cnt = both.groupBy("feature", "category").agg(
        F.count_if(F.col("side") == "b").cast("long").alias("nb"),
        F.count_if(F.col("side") == "c").cast("long").alias("nc"))
    tot = cnt.groupBy("feature").agg(F.sum("nb").alias("tb"), F.sum("nc").alias("tc"))
    j = cnt.join(F.broadcast(tot), "feature")
    eb = _share(F.col("nb"), F.col("tb"))
    ac = _share(F.col("nc"), F.col("tc"))
    return (j.groupBy("feature").agg(F.sum((ac - eb) * F.ln(ac / eb)).alias("psi"),
                                     F.max("tb").alias("tb"), F.max("tc").alias("tc"))
             .where((F.col("tb") > 0) & (F.col("tc") > 0)).select("feature", "psi"))


def drift_report(baseline: DataFrame, current: DataFrame, target: str = "label",
                 ignore_cols=()) -> DataFrame:
    """Column-level drift for numeric (PSI + KS) and categorical (PSI of shares) columns.

    The roles come from the schema (``infer_roles``); a column drifts when PSI or KS
    reaches 0.10. This replaces a report library's HTML with a table; the statistics
    are a stated choice, not the library's.
    """
    roles = dict(infer_roles(baseline, target))
    cur = set(current.columns)
    ign = {c.lower() for c in ignore_cols}
    num = [c for c, r in roles.items() if r == "numeric" and c in cur and c.lower() not in ign]
    cat = [c for c, r in roles.items() if r == "categorical" and c in cur and c.lower() not in ign]
    spark = baseline.sparkSession
    parts = []
    if num:
        d = drift_by_feature(baseline, current, cols=num, rounded=False)
        parts.append(d.select("feature", F.lit("numeric").alias("kind"), "psi", "ks"))
    if cat:
        c = categorical_psi(baseline, current, cat)
        parts.append(c.select("feature", F.lit("categorical").alias("kind"), "psi",
                              F.lit(None).cast("double").alias("ks")))
    if not parts:
        return spark.createDataFrame([], "feature string, kind string, psi double, ks double, drift_flag boolean")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    flag = (F.col("psi") >= DRIFT_FLAG_LEVEL) | F.coalesce(F.col("ks") >= DRIFT_FLAG_LEVEL, F.lit(False))
    return out.select("feature", "kind", round6("psi").alias("psi"), round6("ks").alias("ks"),
                      flag.alias("drift_flag"))


def dataset_drift(report: DataFrame, share: float = 0.5) -> DataFrame:
    """Dataset-level summary: columns, drifted columns, share, and share >= ``share``."""
    return report.agg(F.count(F.lit(1)).cast("long").alias("n_columns"),
                      F.count_if("drift_flag").cast("long").alias("n_drifted")).select(
        "n_columns", "n_drifted",
        round6(F.try_divide("n_drifted", "n_columns")).alias("drift_share"),
        F.coalesce(F.try_divide("n_drifted", "n_columns") >= share, F.lit(False)).alias("dataset_drift"))
