"""The shared core: running totals, exact quantiles and row positions, on skewed data."""
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modelwatch.operators.prefix import exact_quantiles, row_position, running_totals


def test_running_totals_hot_group_and_tiny_buckets(spark):
    rng = np.random.default_rng(3)
    # group 'hot' holds 90 % of the keys; keys are unique per group after pre-aggregation
    pdf = pd.DataFrame({"g": ["hot"] * 900 + ["a"] * 60 + ["b"] * 40,
                        "k": np.concatenate([rng.permutation(900), rng.permutation(60), rng.permutation(40)]).astype(float),
                        "c": rng.integers(1, 5, 1000)})
    df = spark.createDataFrame(pdf).withColumn("c", F.col("c").cast("long"))
    for nb in (2, 16, 64):
        got = running_totals(df, "k", ["c"], ["g"], n_parts=nb).toPandas().sort_values(["g", "k"])
        exp = pdf.sort_values(["g", "k"]).assign(cum=lambda d: d.groupby("g")["c"].cumsum())
        assert (got["cum_c"].to_numpy() == exp["cum"].to_numpy()).all()
        assert (got.groupby("g")["tot_c"].first() == pdf.groupby("g")["c"].sum()).all()


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(size=500), np.full(300, 2.5), rng.integers(0, 5, 200)])  # heavy ties
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "v", qs).collect()[0]
    for i, q in enumerate(qs):
        assert got[f"q{i}"] == pytest.approx(np.percentile(vals, q * 100), abs=1e-12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=40),
       st.sampled_from([0.01, 0.1, 0.5, 0.9, 0.99]))
def test_exact_quantile_property(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, "v", [q], n_parts=4).collect()[0]["q0"]
    assert got == pytest.approx(np.percentile(np.array(values, dtype=float), q * 100), abs=1e-12)


def test_row_position_with_hot_leading_key(spark):
    # one subject owns 95 % of the rows; positions must still be a permutation in order
    df = spark.range(0, 2000).selectExpr("CASE WHEN id % 20 = 0 THEN id ELSE 7 END AS subject_id",
                                         "id AS hadm_id")
    pos = row_position(df, ["subject_id", "hadm_id"], n_parts=8).toPandas()
    pos = pos.sort_values("position")
    assert pos["position"].tolist() == list(range(2000))
    keys = list(zip(pos["subject_id"], pos["hadm_id"]))
    assert keys == sorted(keys)
    assert (pos["n_rows"] == 2000).all()


def test_running_totals_many_tiny_groups_one_hot_group_and_a_null_group(spark):
    rng = np.random.default_rng(11)
    n_small = 100_000
    tiny = spark.range(n_small * 2).selectExpr("cast(id % 100000 as string) AS g", "cast(id as double) AS k", "1L AS c")
    c = rng.integers(1, 4, 4000)
    hot = spark.createDataFrame(pd.DataFrame({"g": "hot", "k": rng.permutation(4000).astype(float), "c": c}))
    null = spark.createDataFrame([(None, 2.0, 5), (None, 1.0, 7)], "g string, k double, c long")
    df = tiny.unionByName(hot).unionByName(null).repartition(5)
    got = running_totals(df, "k", ["c"], ["g"], n_parts=16).toPandas()
    exp = df.toPandas().sort_values(["g", "k"])
    exp["cum"] = exp.groupby("g", dropna=False)["c"].cumsum()
    exp["tot"] = exp.groupby("g", dropna=False)["c"].transform("sum")
    got = got.sort_values(["g", "k"])
    assert len(got) == len(exp) == n_small * 2 + 4002
    assert (got["cum_c"].to_numpy() == exp["cum"].to_numpy()).all()
    assert (got["tot_c"].to_numpy() == exp["tot"].to_numpy()).all()
    q = exact_quantiles(df, "k", [0.5], by=["g"], n_parts=16).where("g = 'hot' OR g = '7'").toPandas().set_index("g")
    assert q.loc["hot", "q0"] == np.percentile(np.arange(4000.0), 50) and q.loc["7", "q0"] == 50007.0


def test_row_position_per_group_splits_equal_rows_exactly(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS r")
    pos = row_position(df, ["r"], by=["g"], n_parts=7).toPandas()
    assert (pos["n_rows"] == 500).all()
    assert sorted(pos.loc[pos["g"] == 1, "position"]) == list(range(500))


def test_approx_quantiles_option(spark):
    vals = np.arange(10001, dtype=float)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = exact_quantiles(df, "v", [0.25, 0.5], approx=True).collect()[0]
    assert got["n"] == 10001
    assert abs(got["q0"] - 2500) <= 10001 / 10000 + 1 and abs(got["q1"] - 5000) <= 10001 / 10000 + 1
