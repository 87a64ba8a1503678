"""Distributed running totals over a global order, per group.

Spark has no scalable global running sum: a window without ``partitionBy`` moves every
row into one task. This operator gives the same result with bounded tasks, by one path
for all group sizes:

1. The caller pre-aggregates to one row per (group, key) with count columns, so a hot
   key (or a heavily tied score) is one row whatever its size (map-side combine).
2. ``range_parts`` range-partitions that table on (group, order key) into
   ``spark.sql.shuffle.partitions`` parts, stamps the part number and checkpoints it, so
   a recomputed task cannot move rows between parts. A small group stays whole in one
   part; a hot group is spread over as many parts as its share of the rows.
3. Totals per (group, part), one row each, give exclusive offsets and group totals by a
   window over those few rows.
4. The offsets go back in as head rows that sort first within (group, part); one window
   over (group, part) then gives the global inclusive running totals. No join, so NULL
   groups are groups like any other, and nothing is exchanged on the group alone but the
   (group, part) totals.

Everything after the checkpoint is lazy.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.scalar import np_lerp
from modelwatch.session import materialize, shuffle_partitions

PART = "_part"


def range_parts(df: DataFrame, keys: Sequence[str], n_parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned on ``keys`` and checkpointed, with the part number in
    ``_part``: parts are in key order, equal keys share a part."""
    n = int(n_parts or shuffle_partitions(df.sparkSession))
    return materialize(df.repartitionByRange(n, *keys).withColumn(PART, F.spark_partition_id()))


def running_totals(df: DataFrame, key: str, counts: Sequence[str], by: Sequence[str] = (),
                   n_parts: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running total in key order) and ``tot_<c>`` (group
    total) for every count column ``c`` (BIGINT).

    Ties in ``key`` are broken arbitrarily, so callers pre-aggregate to unique keys when
    ties matter. A caller that reads the table elsewhere too passes the result of
    ``range_parts(df, [*by, key])``, which is used as it stands.
    """
    by, counts = list(by), list(counts)
    parted = df if PART in df.columns else range_parts(df, [*by, key], n_parts)
    totals = parted.groupBy(*by, PART).agg(*[F.sum(c).cast("long").alias(c) for c in counts])
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    heads = totals.select(
        *by, PART, F.lit(0).alias("_row"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(c) for c in counts],
        *[F.sum(c).over(whole).cast("long").alias(f"tot_{c}") for c in counts])
    both = parted.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    w = (Window.partitionBy(*by, PART).orderBy("_row", key)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.select(
        *[c for c in parted.columns if c != PART], "_row",
        *[F.first(f"tot_{c}").over(w).alias(f"tot_{c}") for c in counts],
        *[F.sum(c).over(w).cast("long").alias(f"cum_{c}") for c in counts])
    return out.where("_row = 1").drop("_row")


def row_position(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
                 n_parts: int | None = None) -> DataFrame:
    """0-based position of every row in ``order`` (per group ``by``), plus ``n_rows``.

    The range runs over the FULL order key (bounds from a sample of all order columns),
    so a hot leading key (one subject with a third of the rows) is spread by its other
    order columns. Offsets as in ``running_totals``, with rows counted.
    """
    by, order = list(by), list(order)
    parted = range_parts(df, [*by, *order], n_parts)
    totals = parted.groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*by, PART, F.lit(0).alias("_row"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                          F.sum("_n").over(Window.partitionBy(*by)).alias("n_rows"))
    both = parted.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*by, PART).orderBy("_row", *order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.select(*[c for c in parted.columns if c != PART], "_row",
                      F.first("n_rows").over(run).alias("n_rows"),
                      # the head row is row 1, so the first data row has row_number 2
                      (F.row_number().over(w) - 2 + F.first("_before").over(run)).cast("long").alias("position"))
    return out.where("_row = 1").drop("_row")


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, n_parts: int | None = None,
                    weight: str | None = None, approx: bool = False,
                    approx_accuracy: int = 10000) -> DataFrame:
    """Exact quantiles per group, NumPy's ``linear`` method (``np.percentile`` default).

    Position h = (n-1)q; the result interpolates between the values at positions
    floor(h) and floor(h)+1. Values come from the distributed running counts, so no
    group is ever gathered into one task (unlike the ``percentile`` aggregate, which
    keeps every distinct value of a group in one buffer). NULLs are ignored.
    Returns one row per group: ``by`` columns, ``n`` and one column per quantile.

    ``approx=True`` is the scale option: one ``percentile_approx`` pass (rank error
    1 / ``approx_accuracy``, no checkpoint, no window); it returns observed values, not
    interpolated ones.
    """
    by = list(by)
    names = list(names or [f"q{i}" for i in range(len(qs))])
    if approx:
        x = F.col(value)
        g = df.where(x.isNotNull()).groupBy(*by).agg(
            (F.sum(F.col(weight)) if weight else F.count(F.lit(1))).cast("long").alias("n"),
            F.percentile_approx(x, [float(q) for q in qs], approx_accuracy).alias("_q"))
        return g.select(*by, "n", *[F.col("_q")[i].cast("double").alias(nm) for i, nm in enumerate(names)])
    cnt = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    pre = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
             .agg(cnt.cast("long").alias("_cnt")))
    r = running_totals(pre, value, ["_cnt"], by, n_parts=n_parts)
    n = F.col("tot__cnt")
    start = F.col("cum__cnt") - F.col("_cnt")
    aggs = []
    for i, q in enumerate(qs):
        h = (n - 1).cast("double") * F.lit(float(q))
        lo = F.floor(h)
        hi = F.least(lo + 1, n - 1)
        aggs.append(F.max(F.when((start <= lo) & (lo < F.col("cum__cnt")), F.col(value))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when((start <= hi) & (hi < F.col("cum__cnt")), F.col(value))).alias(f"_hi{i}"))
    g = r.groupBy(*by).agg(F.max(n).alias("n"), *aggs)
    outs = []
    for i, (q, nm) in enumerate(zip(qs, names)):
        h = (F.col("n") - 1).cast("double") * F.lit(float(q))
        t = h - F.floor(h)
        outs.append(np_lerp(F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double"), t).alias(nm))
    return g.select(*by, "n", *outs)
