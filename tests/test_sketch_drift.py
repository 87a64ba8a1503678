"""Sketched PSI and KS: limits hold the exact values, sketches merge, nothing per value is shuffled."""
import numpy as np
import pytest

from modelwatch.operators import drift as D
from modelwatch.operators import sketch_drift as S

from test_drift import numpy_ks, numpy_psi


def frame(spark, cols):
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame(cols))


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(3)
    n, m = 30_000, 22_000
    base = {"same": rng.normal(0, 1, n), "moved": rng.normal(0, 1, n), "ties": rng.integers(0, 11, n) / 100, "skew": rng.lognormal(0, 3, n),
            "const": np.full(n, 4.0), "neg": -rng.exponential(5, n)}
    cur = {"same": rng.normal(0, 1, m), "moved": rng.normal(0.4, 1.3, m), "ties": rng.integers(2, 12, m) / 100, "skew": rng.lognormal(0.05, 3, m),
           "const": np.full(m, 4.0), "neg": -rng.exponential(5.2, m)}
    return base, cur


@pytest.mark.parametrize("k", [200, 4096])
def test_exact_values_lie_in_the_limits(spark, sides, k):
    base, cur = sides
    rows = S.sketched_drift(frame(spark, base), frame(spark, cur), list(base), k=k).collect()
    assert len(rows) == len(base)
    for r in rows:
        psi, ks = numpy_psi(base[r.feature], cur[r.feature]), numpy_ks(base[r.feature], cur[r.feature])
        assert (r.n_base, r.n_curr) == (30_000, 22_000)
        assert r.psi_low - 1e-9 <= psi <= r.psi_high + 1e-9 and r.psi_low <= r.psi + 1e-9 and r.psi <= r.psi_high + 1e-9, r
        assert r.ks_low - 1e-9 <= ks <= r.ks_high + 1e-9, r
        assert not r.decided or r.drift_flag == (psi >= 0.1 or ks >= 0.1)
        if k == 4096:
            assert abs(r.ks - ks) < 0.006 and r.ks_high - r.ks_low < 0.01
            if r.feature != "ties":                 # values on the edges: one bin or the next
                assert abs(r.psi - psi) < 0.02
    assert {r.feature for r in rows if r.decided} >= ({"moved", "ties"} if k > 200 else set())


def test_small_tables_are_exact_to_the_grid(spark):
    rng = np.random.default_rng(1)
    b, c = rng.normal(size=700), rng.normal(0.3, 1, 500)
    r = S.sketched_drift(frame(spark, {"x": b}), frame(spark, {"x": c}), ["x"]).first()
    assert r.ks == pytest.approx(numpy_ks(b, c), abs=1 / S.GRID) and r.ks_high - r.ks_low < 2.1 / S.GRID
    assert r.psi_low <= numpy_psi(b, c) <= r.psi_high


def test_days_merge_and_a_retry_replaces(spark, sides, tmp_path):
    base, cur = sides
    days = frame(spark, {"x": np.concatenate([base["moved"], cur["moved"]]), "day": np.repeat(np.arange(26), 2000)})
    sketches = S.column_sketches(days, ["x"], by=["day"])
    path = S.sink_sketches(sketches, str(tmp_path / "s"), ["day"])
    S.sink_sketches(sketches.where("day in (3, 20)"), path, ["day"])      # the same days once more
    stored = spark.read.parquet(path)
    assert stored.count() == 26 and stored.agg({"n": "sum"}).first()[0] == 52_000
    for cut in (10, 15):
        r = S.drift_of_sketches(S.merge_sketches(stored.where(f"day < {cut}")), S.merge_sketches(stored.where(f"day >= {cut}"))).first()
        x = np.concatenate([base["moved"], cur["moved"]])
        b, c = x[:cut * 2000], x[cut * 2000:]
        assert r.ks_low <= numpy_ks(b, c) <= r.ks_high and r.psi_low <= numpy_psi(b, c) <= r.psi_high


def test_no_row_per_value_is_shuffled(spark, sides):
    base, _ = sides
    plan = S.column_sketches(frame(spark, base).repartition(3), list(base))._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll_sketch_agg_double" in plan and "hashpartitioning(value" not in plan and "feature#" in plan


def test_options_of_the_exact_functions(spark, sides):
    base, cur = sides
    b, c = frame(spark, {"x": base["moved"]}), frame(spark, {"x": cur["moved"]})
    for bins in (1, 7, 30):
        assert D.psi(b, c, ["x"], bins=bins).first().psi == pytest.approx(numpy_psi(base["moved"], cur["moved"], bins), abs=1e-6)
        assert D.psi(b, c, ["x"], bins=bins, approx=True).first().psi == pytest.approx(numpy_psi(base["moved"], cur["moved"], bins), abs=0.05)
    a, e = D.drift_by_feature(b, c, approx=True).first(), D.drift_by_feature(b, c).first()
    assert a.drift_flag == e.drift_flag and abs(a.ks - e.ks) < 0.006
    assert abs(D.ks_two_sample(b, c, ["x"], approx=True).first().ks - e.ks) < 0.006
    with pytest.raises(ValueError):
        D.psi(b, c, ["x"], bins=0)


def test_missing_and_empty(spark):
    b = spark.createDataFrame([(1.0, None), (float("nan"), None), (float("inf"), None), (2.0, None)], "x double, y double")
    r = S.sketched_drift(b, b, ["x", "y"]).collect()
    assert [(x.feature, x.n_base, x.ks) for x in r] == [("x", 2, 0.0)]
    assert S.sketched_drift(b.where("false"), b, ["x"]).count() == 0
