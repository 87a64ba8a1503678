"""Metrics: the reference's unit cases, hand-made edge cases and a brute-force check."""
import math
import random

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import metrics as M


def brute(y, s):
    """Row-by-row definitions (tie-averaged ranks, step KS at tie ends, AUPRC over distinct
    thresholds, best F1 over {0, 1} U scores with the closest-to-0.5 tie-break)."""
    n = len(y)
    P = sum(1 for v in y if v == 1)
    N = n - P
    order = sorted(range(n), key=lambda i: s[i])
    ranks, i = {}, 0
    while i < n:
        j = i
        while j + 1 < n and s[order[j + 1]] == s[order[i]]:
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + 1 + j + 1) / 2
        i = j + 1
    auroc = (sum(ranks[i] for i in range(n) if y[i] == 1) - P * (P + 1) / 2) / (P * N) if P and N else None
    ks = 0.0
    for t in sorted(set(s)):
        tpr = sum(1 for i in range(n) if y[i] == 1 and s[i] <= t) / P
        fpr = sum(1 for i in range(n) if y[i] == 0 and s[i] <= t) / N
        ks = max(ks, abs(tpr - fpr))
    area, prev = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(1 for i in range(n) if s[i] >= t and y[i] == 1)
        fp = sum(1 for i in range(n) if s[i] >= t and y[i] != 1)
        area += tp / (tp + fp) * max(0.0, tp / P - prev)
        prev = tp / P
    best, bt = -1.0, None
    for t in sorted(set([0.0, 1.0] + list(s))):
        tp = sum(1 for i in range(n) if s[i] >= t and y[i] == 1)
        fp = sum(1 for i in range(n) if s[i] >= t and y[i] == 0)
        f1 = 2 * tp / (2 * tp + fp + (P - tp)) if tp else 0.0
        if f1 > best or (f1 == best and abs(t - 0.5) < abs(bt - 0.5)):
            best, bt = f1, t
    ll = sum(-(yy * math.log(min(max(p, 1e-15), 1 - 1e-15)) + (1 - yy) * math.log(1 - min(max(p, 1e-15), 1 - 1e-15)))
             for yy, p in zip(y, s)) / n
    return dict(auroc=auroc, ks_stat=ks, auprc=area, best_f1=best, best_f1_threshold=bt, log_loss=ll)


def frame(spark, y, s, seg=None):
    seg = seg or ["a"] * len(y)
    return spark.createDataFrame(list(zip(seg, y, s)), "segment string, y_true int, y_score double")


def test_perfect_classifier(spark):
    m = M.performance_metrics(frame(spark, [0, 1, 0, 1], [0.01, 0.99, 0.02, 0.98])).collect()[0]
    assert m["auroc"] == 1.0 and m["auprc"] == 1.0 and m["f1_at_05"] == 1.0
    assert 0 < m["log_loss"] < 0.3
    assert 0.0 <= m["best_f1_threshold"] <= 1.0
    assert m["n"] == 4 and m["n_samples"] == 4


def test_cli_predictions(spark):
    m = M.basic_performance(frame(spark, [1, 0, 1, 0], [0.91, 0.12, 0.77, 0.05])).collect()[0]
    assert (m["auroc"], m["ks_stat"], m["accuracy_at_05"]) == (1.0, 1.0, 1.0)


@pytest.mark.parametrize("seed,distinct", [(1, 5), (2, 40), (3, 1000)])
def test_against_brute_force(spark, seed, distinct):
    rnd = random.Random(seed)
    y = [rnd.randint(0, 1) for _ in range(300)]
    s = [round(rnd.randint(0, distinct) / distinct, 6) for _ in range(300)]
    got = M.performance_metrics(frame(spark, y, s)).collect()[0]
    exp = brute(y, s)
    for k, v in exp.items():
        assert got[k] == pytest.approx(round(v, 6), abs=2e-6), k


def test_one_class_and_bad_rows(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.7), ("a", 2, 0.5), ("a", None, 0.1),
                                ("a", 0, float("nan")), ("b", 0, 0.3), ("b", 1, 0.8)],
                               "segment string, y_true int, y_score double")
    m = {r["segment"]: r for r in M.performance_metrics(df, by=["segment"]).collect()}
    assert m["a"]["n"] == 2 and m["a"]["auroc"] is None and m["a"]["ks_stat"] is None
    assert m["a"]["auprc"] == 1.0
    assert m["b"]["auroc"] == 1.0
    rej = {r["segment"]: r for r in M.prediction_rejects(df, by=["segment"]).collect()}
    assert rej["a"]["n_dropped"] == 3 and rej["b"]["n_dropped"] == 0


def test_empty_input(spark):
    m = M.performance_metrics(frame(spark, [], []).where("false")).collect()[0]
    assert m["n"] == 0 and m["f1_at_05"] == 0.0 and m["auroc"] is None and m["accuracy_at_05"] is None


def test_symmetry_and_partition_invariance(spark):
    rnd = random.Random(7)
    y = [rnd.randint(0, 1) for _ in range(500)]
    s = [rnd.random() for _ in range(500)]
    df = frame(spark, y, s)
    a = M.auroc(df).collect()[0]["auroc"]
    neg = M.auroc(df.withColumn("y_score", -F.col("y_score"))).collect()[0]["auroc"]
    assert a + neg == pytest.approx(1.0, abs=2e-6)
    b = M.auroc(df.repartition(13)).collect()[0]["auroc"]
    c = M.performance_metrics(df, n_parts=3).collect()[0]["auroc"]
    assert a == b == c


def test_no_single_partition_window(spark):
    df = frame(spark, [0, 1, 0, 1], [0.1, 0.9, 0.3, 0.7])
    import re
    plan = M.performance_metrics(df)._jdf.queryExecution().executedPlan().toString()
    specs = re.findall(r"Window \[.*?windowspecdefinition\((.*?)\)", plan)
    # windows over rows (ordered by score) are partitioned by part; the others run over the
    # totals, at most one row per part
    over_rows = [s for s in specs if "score" in s]
    assert over_rows and all(re.match(r"_part#\d+, _row", s) for s in over_rows)
    assert all(re.match(r"_part#\d+ ASC|specifiedwindowframe", s) for s in specs if "score" not in s)
    assert not re.search(r"Window \[[^\n]*\], \[\], \[", plan)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8)), min_size=2, max_size=60))
def test_metrics_property_against_brute_force(spark, pairs):
    y = [p[0] for p in pairs]
    s = [p[1] / 8 for p in pairs]
    got = M.performance_metrics(frame(spark, y, s), n_parts=4).collect()[0]
    if 0 < sum(y) < len(y):
        exp = brute(y, s)
        for k, v in exp.items():
            assert got[k] == pytest.approx(round(v, 6), abs=2e-6), k
    else:
        assert got["auroc"] is None and got["ks_stat"] is None
