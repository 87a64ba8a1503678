"""The value table: order statistics and prepared columns against NumPy."""
import itertools
import math

import numpy as np
import pytest

from modelwatch.operators import prep as P
from modelwatch.operators import value_table as V

NAN, INF = float("nan"), float("inf")


def frame(spark, cols):
    names = list(cols)
    rows = [tuple(None if x is None else float(x) for x in r) for r in zip(*cols.values())]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "subject_id long, " + ", ".join(f"{c} double" for c in names))


@pytest.mark.parametrize("values", [
    [0.1, 1e300, -1e300, 5e-324, 0.0, 1.0, 1.0, 2.0, 1e-300, 3.0],
    [INF, -INF, V.MOST, -V.MOST, 0.0, 1.0, INF],
    list(np.random.default_rng(0).normal(size=3000)) + [1e12],
    [7.0] * 20,
    list(np.nextafter(1.0, 2) + np.arange(40) * 2.0 ** -52),
    [float(2 ** k) for k in range(-300, 300)],
])
def test_order_statistics(spark, values):
    df = frame(spark, {"x": values + [None, NAN]})
    with V.ValueTable({"a": df}, ["x"]) as t:
        known = t.summary()
        assert known["a", "x", "n"].n == len(values) and known["a", "x", "n"].missing == 2
        found = t.order_stats({("a", "x", "n"): set(range(0, len(values), max(1, len(values) // 25))) | {-1, len(values)}}, known)
    want = sorted(values)
    got = found["a", "x", "n"]
    assert got and all(got[k] == want[k] for k in got) and -1 not in got and len(values) not in got


def test_one_shuffle_on_values(spark):
    df = frame(spark, {"x": [1, 2, 2, None], "y": [0, 0, 1, 1]})
    plan = V.count_values({"a": df, "b": df}, ["x", "y"], True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    rows = {(r.side, r.feature, r.value): (r.n, r.m) for r in V.count_values({"a": df}, ["x", "y"], True).collect()}
    assert rows == {("a", "x", 1.0): (1, 1), ("a", "x", 2.0): (2, 2), ("a", "x", None): (1, 0),
                    ("a", "y", 0.0): (2, 2), ("a", "y", 1.0): (2, 1)}


def test_no_folder_stays(spark):
    import os
    df = frame(spark, {"x": [1, 2, 3]})
    with V.ValueTable({"a": df}, ["x"]) as t:
        path = t.table._scratch.replace("file:", "")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def plain_prep(base, cur, cfg):
    """NumPy: {side: (columns, profile after)}; NaN is missing."""
    sides = {"baseline": base, "current": cur}
    if cfg.impute == "drop":
        keep = {s: ~np.any([np.isnan(v) for v in d.values()], axis=0) for s, d in sides.items()}
        filled = {s: {c: v[keep[s]] for c, v in d.items()} for s, d in sides.items()}
    else:
        def fill_of(v):
            return 0.0 if cfg.impute == "zero" else (np.nanmedian(v) if (~np.isnan(v)).any() else np.nan)
        filled = {s: {c: np.where(np.isnan(v), fill_of(sides["baseline" if cfg.fit_on == "baseline" else s][c]), v) for c, v in d.items()}
                  for s, d in sides.items()}

    def bounds_of(v):
        v = v[~np.isnan(v)]
        if not len(v) or cfg.outliers == "none":
            return None
        if cfg.outliers == "iqr":
            q1, q3 = np.percentile(v, [25, 75])
            return q1 - cfg.iqr_mult * (q3 - q1), q3 + cfg.iqr_mult * (q3 - q1)
        sd = v.std()
        return None if v.min() == v.max() else (v.mean() - cfg.z_threshold * sd, v.mean() + cfg.z_threshold * sd)

    bounds = {s: {c: bounds_of(v) for c, v in d.items()} for s, d in filled.items()}
    if cfg.fit_on == "baseline":
        bounds["current"] = bounds["baseline"]
    clipped = {s: {c: v if bounds[s][c] is None else np.clip(v, *bounds[s][c]) for c, v in d.items()} for s, d in filled.items()}
    out = {}
    for s, d in clipped.items():
        out[s] = {}
        for c, v in d.items():
            b = clipped["baseline"][c]
            b = b[~np.isnan(b)]
            if cfg.scaler == "none":
                out[s][c] = v
            elif not len(b):
                out[s][c] = np.full(len(v), np.nan)
            else:
                center, scale = (b.mean(), b.std()) if cfg.scaler == "standard" else (b.min(), b.max() - b.min())
                out[s][c] = (v - center) / (scale if scale > 1e-12 else 1.0)
    return out


def tables(seed):
    rng = np.random.default_rng(seed)

    def one(n):
        x = rng.normal(50, 10, n)
        x[rng.random(n) < 0.2] = np.nan
        x[:2] = [900, -700]
        ties = rng.integers(0, 4, n).astype(float)
        ties[rng.random(n) < 0.3] = np.nan
        return {"x": x, "ties": ties, "const": np.where(rng.random(n) < 0.1, np.nan, 3.3), "neg": -rng.exponential(2, n) + (rng.random(n) < 0.5)}
    return one(61), one(40)


def frames_of(spark, base, cur):
    return tuple(frame(spark, {c: [None if math.isnan(x) else x for x in v] for c, v in d.items()}) for d in (base, cur))


def same(df, want):
    rows = sorted(df.collect(), key=lambda r: r.subject_id)
    for c, v in want.items():
        got = np.array([np.nan if r[c] is None else r[c] for r in rows])
        np.testing.assert_allclose(got, v, rtol=1e-9, atol=1e-9, err_msg=c)


CONFIGS = list(itertools.product(("drop", "zero", "median"), ("zscore", "iqr", "none"), ("standard", "minmax", "none"), ("own", "baseline")))


@pytest.mark.parametrize("impute,outliers,scaler,fit_on", CONFIGS[::7] + [("median", "iqr", "standard", "own"), ("median", "iqr", "standard", "baseline"), ("drop", "iqr", "minmax", "baseline")])
def test_prepared_columns_and_profiles(spark, impute, outliers, scaler, fit_on):
    base, cur = tables(7)
    cfg = P.PrepConfig(impute=impute, outliers=outliers, scaler=scaler, fit_on=fit_on, z_threshold=2.0)
    b, c = frames_of(spark, base, cur)
    bp, cp, _, bi, ci = P.prepare_pair(b, c, cfg)
    want = plain_prep(base, cur, cfg)
    for df, side, info, raw in ((bp, "baseline", bi, base), (cp, "current", ci, cur)):
        same(df, want[side])
        for stats, cols in ((info["post_stats"], want[side]), (info["pre_stats"], raw)):
            rows = {r.feature: r for r in stats().collect()}
            for name, v in cols.items():
                own = v[~np.isnan(v)]
                assert (rows[name]["count"], rows[name].missing) == (len(own), len(v) - len(own)), name
                if len(own):
                    got = [rows[name][k] for k in ("mean", "std", "min", "p50", "max")]
                    np.testing.assert_allclose(got, [own.mean(), own.std(), own.min(), np.median(own), own.max()], atol=2e-6, rtol=1e-6, err_msg=name)


def test_empty_and_all_null(spark):
    base = {"x": np.array([np.nan, np.nan]), "y": np.array([1.0, 2.0])}
    cur = {"x": np.array([1.0, np.nan]), "y": np.array([np.nan, np.nan])}
    for impute in ("zero", "median", "drop"):
        cfg = P.PrepConfig(impute=impute, outliers="iqr")
        b, c = frames_of(spark, base, cur)
        bp, cp, _, bi, ci = P.prepare_pair(b, c, cfg)
        want = plain_prep(base, cur, cfg)
        same(bp, want["baseline"])
        same(cp, want["current"])
        assert bi["post_stats"]().count() == ci["pre_stats"]().count() == 2
    none = b.where("false")
    assert P.prepare_pair(none, none, P.PrepConfig(impute="median"))[0].count() == 0
    only_ids = b.select("subject_id")
    assert P.prepare_pair(only_ids, only_ids)[0].count() == 2


def test_search_cut_short(spark):
    v = np.random.default_rng(1).exponential(100, 4000)
    df = frame(spark, {"x": v})
    got = P.column_quantiles_many({"a": df}, ["x"], [0.25, 0.5, 0.99], approx=True)["a"]["x"]
    np.testing.assert_allclose(got, np.percentile(v, [25, 50, 99]), rtol=1e-3)


def test_wrong_options(spark):
    df = frame(spark, {"x": [1, 2]})
    for bad in ({"impute": "mean"}, {"outliers": "no"}, {"scaler": "max"}, {"fit_on": "current"}):
        with pytest.raises(ValueError):
            P.prepare_pair(df, df, P.PrepConfig(**bad))
