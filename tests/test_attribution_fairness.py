"""Attribution ranking and fairness tables."""
import json

import numpy as np
import pytest

from modelwatch.operators import attribution as A
from modelwatch.operators import fairness as FA


def test_mean_abs_impact_ranking(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([0.5, 0.0],)], "contrib array<double>")
    top = A.top_features(A.mean_abs_impact(df, names=["f1", "f2"]), 2).collect()
    assert [(r["name"], r["mean_abs_impact"]) for r in top] == [("f2", 1.0), ("f1", 0.75)]
    empty = spark.createDataFrame([], "contrib array<double>")
    assert A.mean_abs_impact(empty).count() == 0


def test_normalize_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"features": [{"name": "x", "mean_abs_impact": 0.5},
                                                                {"feature": "y", "importance": "0.7"},
                                                                {"name": "z", "mean_abs_impact": "bad"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"name": "w", "mean_abs_impact": 0.1}]))
    (tmp_path / "c.json").write_text(json.dumps({"n_top_features": 3, "features": ["feat1", "featX"]}))
    (tmp_path / "d.json").write_text(json.dumps({"top_features": [{"column": "q", "mean_abs": 2}, {"mean_abs": 1}]}))
    got = {(r["name"], r["mean_abs_impact"]) for r in A.normalize_features(spark, str(tmp_path)).collect()}
    assert got == {("x", 0.5), ("y", 0.7), ("w", 0.1)}
    alt = {(r["name"], r["mean_abs_impact"]) for r in A.normalize_features_alt(spark, str(tmp_path)).collect()}
    assert ("q", 2.0) in alt and all(n is not None for n, _ in alt)


def test_fairness_tables(spark):
    rng = np.random.default_rng(0)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    g = rng.choice(["M", "F"], size=n)
    y = (x1 + 0.5 * x2 + rng.normal(scale=0.5, size=n) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), str(c), int(d)) for a, b, c, d in zip(x1, x2, g, y)],
                               "x1 double, x2 double, gender string, label int")
    rates = FA.positive_rate_by_group(df, "gender")
    assert {r["group"] for r in rates.collect()} == {"M", "F"}
    gap = FA.parity_gap(rates).collect()[0]
    assert 0 <= gap["parity_gap"] <= 1
    assert FA.positive_rate_by_group(df, "race").count() == 0
    t = {r["group"]: r for r in FA.train_score_audit(df, "gender", seed=42).collect()}
    assert t[FA.OVERALL]["n"] == t["M"]["n"] + t["F"]["n"]
    for r in t.values():
        for k in ("accuracy", "precision", "recall", "f1", "auc", "pos_rate"):
            assert r[k] is None or 0.0 <= r[k] <= 1.0
    assert t[FA.OVERALL]["auc"] > 0.8
    again = {r["group"]: r["auc"] for r in FA.train_score_audit(df, "gender", seed=42).collect()}
    assert again == {k: v["auc"] for k, v in t.items()}


def test_fairness_one_class_group(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.8), ("b", 0, 0.1), ("b", 1, 0.7)],
                               "gender string, label int, y_score double")
    t = {r["group"]: r for r in FA.fairness_by_group(df, "gender", "label", "y_score").collect()}
    assert t["a"]["auc"] is None and t["b"]["auc"] == 1.0 and t[FA.OVERALL]["n"] == 4


def test_one_bad_entry_costs_only_itself(spark, tmp_path):
    from modelwatch.operators import attribution as A
    (tmp_path / "a.json").write_text('{"features": ["bad", {"name": "x", "mean_abs_impact": 2}, {"name": "y", "importance": "0.5"}, 7, {"name": "z", "mean_abs_impact": "no"}]}')
    got = {(r["name"], r["mean_abs_impact"]) for r in A.normalize_features(spark, str(tmp_path)).collect()}
    assert got == {("x", 2.0), ("y", 0.5)}


def test_overall_row_keeps_rows_without_group(spark):
    from modelwatch.operators import fairness as FA
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.8), (None, 0, 0.2), (None, 1, 0.7)], "g string, label int, y_score double")
    n = {r["group"]: r["n"] for r in FA.fairness_by_group(df, "g").collect()}
    assert n == {"a": 2, "b": 1, FA.OVERALL: 5}


def test_split_is_stratified_on_few_distinct_rows(spark):
    df = spark.range(1000).selectExpr("1.0D AS x", "CASE WHEN id % 5 < 2 THEN 1 ELSE 0 END AS label")
    got = {(r["label"], r["_train"]): r["count"] for r in FA.split_train_test(df).groupBy("label", "_train").count().collect()}
    assert got == {(0, True): 420, (0, False): 180, (1, True): 280, (1, False): 120}


def test_split_by_key_does_not_depend_on_the_layout(spark):
    df = spark.range(500).selectExpr("id", "id % 2 AS label")
    one = FA.split_train_test(df, key_cols=["id"]).where("_train").select("id").collect()
    two = FA.split_train_test(df.repartition(7), key_cols=["id"]).where("_train").select("id").collect()
    assert {r["id"] for r in one} == {r["id"] for r in two} and len(one) == 350
