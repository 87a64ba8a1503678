"""Column statistics of several splits from one written table of distinct values.

``ValueTable`` holds one row per (side, feature, value): ``n`` rows hold the value, ``m`` of
them belong to rows without a null in any of the columns (``m`` = ``n`` if incomplete rows
are not set apart). It is one grouped count, combined before its only shuffle, so a hot
value is one row per task; NULL is a value like any other. All statistics come from it,
without another shuffle on values and without reading the input again:

* counts, sums and extremes: one aggregate;
* exact order statistics: bins between the least and the largest candidate value are
  counted, the bin that holds the wanted position becomes the next bracket, until a bracket
  holds a single value. The first round bins on a logarithmic scale, so that far outliers
  don't fill one bin with the rest; the others bin evenly. A round is one aggregate of at
  most ``BINS`` rows per bracket;
* moments after a monotone map (clip): one aggregate with the map's bounds joined in.

The side tables that are joined in hold a few numbers per (side, column) or wanted
position, a bound set by the schema, so they are broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.scalar import clean_double, guarded_clip
from modelwatch.session import drop_scratch, write_scratch

BINS = 4096
#: Largest finite double: infinite values share its bracket, and are told apart in it.
MOST = 1.7976931348623157e308


@dataclass
class Summary:
    """Of one column of one side, weighted by ``n`` or ``m``."""
    n: int = 0              # values
    missing: int = 0
    mean: float | None = None
    low: float | None = None
    high: float | None = None
    below_zero: int = 0


def lerp(a: float | None, b: float | None, t: float) -> float | None:
    """Linear interpolation as ``np.percentile`` does it."""
    if a is None or b is None:
        return None
    if a == b:
        return a
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def at_quantile(n: int, q: float) -> tuple[int, int, float]:
    """Lower and upper position among ``n`` sorted values, and the share of the upper one."""
    h = (n - 1) * q
    lo = math.floor(h)
    return lo, min(lo + 1, n - 1), h - lo


def count_values(frames: dict[str, DataFrame], cols: Sequence[str], complete: bool) -> DataFrame:
    """(side, feature, value, n, m) of the frames, one shuffle. Values are counted under the
    number of their side and column, which makes short keys; the names come after."""
    cols, names, out = list(cols), [], None
    for side, df in frames.items():
        own = [str(len(names) + i) for i in range(len(cols))]
        names += [(side, c) for c in cols]
        wide = df.select(*[clean_double(c).alias(k) for c, k in zip(cols, own)])
        whole = F.lit(True)
        for k in own if complete else ():
            whole = whole & F.col(k).isNotNull()
        part = wide.withColumn("_whole", whole).unpivot(["_whole"], own, "_key", "value")
        out = part if out is None else out.unionByName(part)
    counts = out.groupBy("_key", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("_whole").alias("m"))
    side, feature = (F.get(F.array(*[F.lit(x[i]) for x in names]), F.col("_key").cast("int")) for i in (0, 1))
    return counts.select(side.alias("side"), feature.alias("feature"), "value", "n", "m")


class ValueTable:
    def __init__(self, frames: dict[str, DataFrame], cols: Sequence[str], complete: bool = False):
        self.sides, self.cols, self.complete = list(frames), list(cols), complete
        self.table = write_scratch(count_values(frames, cols, complete), "values")
        self.spark = self.table.sparkSession

    def __enter__(self) -> "ValueTable":
        return self

    def __exit__(self, *_) -> None:
        drop_scratch(self.table)

    def keys(self) -> Iterable[tuple[str, str]]:
        return ((s, c) for s in self.sides for c in self.cols)

    def summary(self) -> dict[tuple[str, str, str], Summary]:
        """Per (side, column, weight)."""
        v, aggs = F.col("value"), []
        for w in ("n", "m"):
            x = F.when(F.col(w) > 0, v)
            aggs += [F.sum(F.when(v.isNotNull(), F.col(w))).alias(f"n_{w}"), F.sum(F.when(v.isNull(), F.col(w))).alias(f"missing_{w}"),
                     F.sum(x * F.col(w)).alias(f"sum_{w}"), F.min(x).alias(f"low_{w}"), F.max(x).alias(f"high_{w}"),
                     F.sum(F.when(v < 0, F.col(w))).alias(f"below_{w}")]
        out = {(s, c, w): Summary() for s, c in self.keys() for w in ("n", "m")}
        for r in self.table.groupBy("side", "feature").agg(*aggs).collect():
            for w in ("n", "m"):
                n = r[f"n_{w}"] or 0
                out[r["side"], r["feature"], w] = Summary(n, r[f"missing_{w}"] or 0, r[f"sum_{w}"] / n if n else None,
                                                         r[f"low_{w}"], r[f"high_{w}"], r[f"below_{w}"] or 0)
        return out

    def order_stats(self, wanted: dict[tuple[str, str, str], set[int]], summary: dict, rounds: int | None = None) -> dict:
        """{(side, column, weight): {position: value}} for 0-based positions in sorted order.

        ``rounds`` ends the search early; the least value of the last bracket stands in,
        off by at most the bracket's width (a share of ``BINS``**-rounds of the range)."""
        found: dict = {k: {} for k in wanted}
        brackets = []                                    # (side, column, weight, low, high, rows before, positions)
        for key, positions in wanted.items():
            s = summary[key]
            positions = sorted(p for p in positions if 0 <= p < s.n)
            if positions and s.low == s.high:
                found[key].update(dict.fromkeys(positions, s.low))
            elif positions:
                brackets.append((*key, s.low, s.high, 0, positions))
        done = 0
        while brackets and (rounds is None or done < rounds):
            brackets = self._narrow(brackets, found, even=done > 0)
            done += 1
        for side, col, w, low, _, _, positions in brackets:
            found[side, col, w].update(dict.fromkeys(positions, low))
        return found

    def _narrow(self, brackets: list, found: dict, even: bool) -> list:
        given = [(i, *b) for i, b in enumerate(brackets)]
        small = self.spark.createDataFrame(given, "id int, side string, feature string, w string, low double, high double, "
                                                  "before long, positions array<long>")
        v, weight = F.col("value"), F.when(F.col("w") == "n", F.col("n")).otherwise(F.col("m"))
        rows = (self.table.join(F.broadcast(small.drop("before", "positions")), ["side", "feature"])
                .where((v >= F.col("low")) & (v <= F.col("high"))).withColumn("_n", weight).where("_n > 0"))
        bins = rows.groupBy("id", _bin(v, F.col("low"), F.col("high"), even).alias("bin")).agg(
            F.sum("_n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        bins = bins.join(F.broadcast(small.select("id", "before", "positions")), "id")
        so_far = Window.partitionBy("id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = bins.withColumn("upto", F.col("before") + F.sum("n").over(so_far))
        own = F.filter("positions", lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))
        hit = upto.withColumn("own", own).where(F.size("own") > 0)
        out = []
        for r in hit.select("id", "low", "high", "own", (F.col("upto") - F.col("n")).alias("start")).collect():
            side, col, w = brackets[r["id"]][:3]
            if r["low"] == r["high"]:
                found[side, col, w].update(dict.fromkeys(r["own"], r["low"]))
            else:
                out.append((side, col, w, r["low"], r["high"], r["start"], r["own"]))
        return out

    def moments(self, maps: dict[tuple[str, str, str], dict]) -> dict:
        """{(side, column, weight): {mean, var, below}} of values clipped to ``low`` .. ``high``
        (None: not clipped), about ``shift`` (a number near the mean); ``below``: values under
        ``fill``, counted before the clip. One pass for all."""
        given = [(*k, m.get("low"), m.get("high"), m["shift"], m.get("fill")) for k, m in maps.items() if m["shift"] is not None]
        if not given:
            return {}
        small = self.spark.createDataFrame(given, "side string, feature string, w string, low double, high double, shift double, fill double")
        rows = self.table.where("value is not null").join(F.broadcast(small), ["side", "feature"])
        weight = F.when(F.col("w") == "n", F.col("n")).otherwise(F.col("m"))
        x = F.when(F.col("low").isNull(), F.col("value")).otherwise(guarded_clip("value", F.col("low"), F.col("high"))) - F.col("shift")
        got = rows.groupBy("side", "feature", "w").agg(
            F.sum(weight).alias("n"), F.sum(x * weight).alias("s1"), F.sum(x * x * weight).alias("s2"),
            F.sum(F.when(F.col("value") < F.col("fill"), weight).otherwise(0)).alias("below"))
        return {(r["side"], r["feature"], r["w"]): {"n": r["n"], "s1": r["s1"], "s2": r["s2"], "below": r["below"]} for r in got.collect()}


def _bin(v: Column, low: Column, high: Column, even: bool) -> Column:
    """Bin of a value in its bracket, ascending with the value."""
    def scale(x):
        x = F.least(F.greatest(x, F.lit(-MOST)), F.lit(MOST))
        return x / 2 if even else F.signum(x) * F.log1p(F.abs(x))       # halves: a difference can't overflow
    width = scale(high) - scale(low)
    share = F.try_divide(scale(v) - scale(low), width)
    evenly = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
    return F.when(width > 0, evenly).otherwise((v > low).cast("int"))
