"""PSI and two-sample KS from quantile sketches kept as aggregate state.

``column_sketches`` folds each column of a table (per day, say) into one KLL sketch: a few
tens of KB whatever the number of rows, combined before the only shuffle, so no row per value
is ever moved. Sketches are stored once (``sink_sketches``, one partition a day, written
anew on a retry) and merged for any pair of windows (``merge_sketches``); a day's rows are
read once, however often it is compared.

``drift_of_sketches`` takes ``grid`` + 1 evenly spaced quantiles of each sketch and gives each
feature's PSI and KS with limits:

* a sketch's rank is off by at most ``rank_error(k)`` of the rows (99 % confidence; 0 while
  all values fit in the sketch), and a value's share is known to 1 / ``grid`` besides;
* PSI edges move with the error of the baseline's p1 and p99, so every edge has an interval,
  every bin's share has one, and a bin's term (c - b) ln(c / b) is largest and smallest at
  corners of the two intervals (0 where they overlap). The sums are ``psi_low``, ``psi_high``;
* KS is the largest gap between the two step functions, off by the errors of both.

``decided`` says that the drift flag is the same at both ends of the limits. The exact path
(``drift.drift_by_feature``) stays the default; this one is for tables whose distinct values
are too many to shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.scalar import clean_double, is_finite
from modelwatch.operators.drift import DRIFT_FLAG_LEVEL, PSI_BINS, PSI_HIGH_Q, PSI_LOW_Q, SHARE_FLOOR

#: Size of a sketch, and quantiles taken from each.
SKETCH_K, GRID = 4096, 2048


def rank_error(k: int) -> float:
    """Two-sided normalised rank error of a KLL sketch of size ``k`` at 99 % confidence (the
    published fit for this sketch)."""
    return 2.446 / k ** 0.9433


def column_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """(by..., feature, n, sketch) of the finite values: one row per group and column."""
    cols = list(cols)
    wide = df.select(*by, *[F.when(is_finite(clean_double(c)), clean_double(c)).alias(c) for c in cols])
    long = wide.unpivot([F.col(b) for b in by], cols, "feature", "value").where("value is not null")
    return long.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), F.expr(f"kll_sketch_agg_double(value, {int(k)})").alias("sketch"))


def sink_sketches(sketches: DataFrame, path: str, by: Sequence[str]) -> str:
    """Store sketches by their group columns; groups written again replace themselves."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))
    return path


def merge_sketches(sketches: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(feature, n, sketch) over all groups of ``sketches``."""
    return sketches.groupBy("feature").agg(F.sum("n").alias("n"), F.expr(f"kll_merge_agg_double(sketch, {int(k)})").alias("sketch"))


def sketch_points(sketches: DataFrame, side: str, grid: int = GRID) -> DataFrame:
    """(feature, side, n, at, value): the ``grid`` + 1 evenly spaced quantiles of each sketch."""
    ranks = ", ".join(f"{i / grid!r}D" for i in range(grid + 1))
    at = F.posexplode(F.expr(f"kll_sketch_get_quantile_double(sketch, array({ranks}))")).alias("at", "value")
    return sketches.select("feature", F.lit(side).alias("side"), "n", at)


def _term(b: Column, c: Column) -> Column:
    return (c - b) * F.ln(c / b)


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(SHARE_FLOOR)), F.lit(1.0))


def _edges(points: DataFrame, k: int, grid: int) -> DataFrame:
    """Per feature: rows and rank error of both sides; the baseline's p1 and p99 as estimated
    (``mid``) and the ends of their intervals (``low``, ``high``; interpolation between two
    values moves them by one rank at the most)."""
    base, rank, v = F.col("side") == "b", F.col("at") / F.lit(float(grid)), F.col("value")
    error = (lambda n: F.when(n <= k, F.lit(0.0)).otherwise(F.lit(rank_error(k))))
    wide = error(F.col("n")) + F.lit(1.0) / F.col("n")
    cols = [F.max(F.when(base, F.col("n"))).alias("n_base"), F.max(F.when(~base, F.col("n"))).alias("n_curr")]
    for name, q in (("p1", PSI_LOW_Q), ("p99", PSI_HIGH_Q)):
        cols += [F.min(F.when(base & (rank >= q), v)).alias(f"{name}_mid"),
                 F.coalesce(F.max(F.when(base & (rank <= q - wide), v)), F.min(F.when(base, v))).alias(f"{name}_low"),
                 F.coalesce(F.min(F.when(base & (rank >= q + wide), v)), F.max(F.when(base, v))).alias(f"{name}_high")]
    e = points.groupBy("feature").agg(*cols).where("n_base is not null and n_curr is not null")
    return e.withColumn("error_b", error(F.col("n_base"))).withColumn("error_c", error(F.col("n_curr")))


def _ks(points: DataFrame, grid: int) -> DataFrame:
    """(feature, ks): the largest gap between the sides' shares of points up to a value. The
    window holds the points of one feature, 2 * (grid + 1) rows."""
    upto = Window.partitionBy("feature").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def share(side):
        n = F.count_if(F.col("side") == side).over(upto)
        return F.when(n == 0, 0.0).when(n > grid, 1.0).otherwise((n - 0.5) / F.lit(float(grid)))
    gap = points.select("feature", F.abs(share("b") - share("c")).alias("gap"))
    return gap.groupBy("feature").agg(F.max("gap").alias("ks"))


def drift_of_sketches(baseline: DataFrame, current: DataFrame, bins: int = PSI_BINS, k: int = SKETCH_K, grid: int = GRID) -> DataFrame:
    """(feature, n_base, n_curr, psi, psi_low, psi_high, ks, ks_low, ks_high, drift_flag,
    decided) of two sketch tables (feature, n, sketch) with data on both sides."""
    points = sketch_points(baseline, "b", grid).unionByName(sketch_points(current, "c", grid))
    edges = _edges(points, k, grid)
    rows = points.join(edges, "feature")
    counts = []
    for e in ("mid", "low", "high"):
        low, high = F.col(f"p1_{e}"), F.col(f"p99_{e}")
        for i in range(bins + 1):
            below = F.col("value") <= high if i == bins else F.col("value") < low + F.lit(float(i)) * ((high - low) / F.lit(float(bins)))
            counts += [F.count_if((F.col("side") == side) & below).alias(f"{side}_{e}_{i}") for side in "bc"]
    h = rows.groupBy(*edges.columns).agg(*counts)

    def shares(side: str, n: str) -> tuple[list, list, list]:
        """Estimate, least and largest share of each bin, of the rows in range."""
        g, off, zero, floor = F.lit(float(grid)), F.col(f"error_{side}"), F.lit(0.0), F.lit(1.0) / F.col(n)
        at = (lambda e, i, x: F.least(F.greatest((F.col(f"{side}_{e}_{i}") + F.lit(x)) / g, zero), F.lit(1.0)))
        mid = [at("mid", i, -0.5) for i in range(bins + 1)]
        least = [F.greatest(at("low", i, -1.0) - off, zero) for i in range(bins + 1)]
        most = [F.least(at("high", i, 0.0) + off, F.lit(1.0)) for i in range(bins + 1)]
        small, large = F.greatest(least[bins] - most[0], floor), F.greatest(most[bins] - least[0], floor)
        whole = F.greatest(mid[bins] - mid[0], floor)
        return ([_clip((mid[i + 1] - mid[i]) / whole) for i in range(bins)],
                [_clip(F.greatest(least[i + 1] - most[i], zero) / large) for i in range(bins)],
                [_clip(F.greatest(most[i + 1] - least[i], zero) / small) for i in range(bins)])

    (b, b0, b1), (c, c0, c1) = shares("b", "n_base"), shares("c", "n_curr")
    kept = [x.alias(f"{name}{i}") for name, xs in (("b", b), ("bl", b0), ("bh", b1), ("c", c), ("cl", c0), ("ch", c1)) for i, x in enumerate(xs)]
    h = h.select("feature", "n_base", "n_curr", "error_b", "error_c", *kept)
    col = (lambda name: [F.col(f"{name}{i}") for i in range(bins)])
    zero = F.lit(0.0)
    psi = sum((_term(x, y) for x, y in zip(col("b"), col("c"))), zero)
    psi_low = sum((F.when((x0 <= y1) & (y0 <= x1), zero).when(y0 > x1, _term(x1, y0)).otherwise(_term(x0, y1))
                   for x0, x1, y0, y1 in zip(col("bl"), col("bh"), col("cl"), col("ch"))), zero)
    psi_high = sum((F.greatest(_term(x0, y1), _term(x1, y0)) for x0, x1, y0, y1 in zip(col("bl"), col("bh"), col("cl"), col("ch"))), zero)
    off = F.col("error_b") + F.col("error_c") + F.lit(1.0 / grid)
    j = h.withColumns({"psi": psi, "psi_low": psi_low, "psi_high": psi_high}).join(_ks(points, grid), "feature")
    j = j.withColumn("ks_low", F.greatest(F.col("ks") - off, zero)).withColumn("ks_high", F.least(F.col("ks") + off, F.lit(1.0)))
    level = F.lit(DRIFT_FLAG_LEVEL)
    flag = (lambda x, y: (F.col(x) >= level) | (F.col(y) >= level))
    return j.select("feature", "n_base", "n_curr", "psi", "psi_low", "psi_high", "ks", "ks_low", "ks_high",
                    flag("psi", "ks").alias("drift_flag"), (flag("psi_low", "ks_low") == flag("psi_high", "ks_high")).alias("decided"))


def sketched_drift(baseline: DataFrame, current: DataFrame, cols: Sequence[str], bins: int = PSI_BINS, k: int = SKETCH_K) -> DataFrame:
    """``drift_of_sketches`` of two tables."""
    return drift_of_sketches(column_sketches(baseline, cols, k=k), column_sketches(current, cols, k=k), bins, k)
