"""Counts taken by the joins themselves: right, and without another scan."""
import pytest

from modelwatch.operators import cohort as CO
from modelwatch.operators.counts import StepCounts, counting_session
from modelwatch.session import write_scratch
from modelwatch.sources import files as S


@pytest.fixture
def user(spark):
    return spark


@pytest.fixture
def spark(spark):
    return counting_session(spark)


def test_the_users_session_keeps_working(user):
    """Counting in a session of its own leaves MLlib in the user's alone."""
    from modelwatch.operators import fairness as FA
    from modelwatch.plans.registry import QUERIES
    assert QUERIES["join_counts"](user, "/root/testdata/sf0.001").count() == 12
    df = user.range(200).selectExpr("cast(id % 7 as double) a", "cast(id % 2 as int) label", "if(id % 3 = 0, 'x', 'y') gender")
    assert FA.train_score_audit(df, "gender").count() == 3


def test_joins_count_what_they_drop(spark):
    labs = spark.createDataFrame([(1, 10, 5, 7), (1, None, 5, 7), (None, 10, 5, 7), (2, 20, 900, 7), (3, 30, 1, 7), (4, 40, 6, 7)],
                                 "subject_id int, hadm_id int, h int, itemid int").selectExpr(
        "subject_id", "hadm_id", "timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,h) charttime", "itemid")
    adm = spark.createDataFrame([(1, 10, "a"), (2, 20, "a"), (None, 50, "a"), (4, 40, "b")], "subject_id int, hadm_id int, admission_type string").selectExpr(
        "*", "timestamp_ntz'2020-01-01' admittime")
    pat = spark.createDataFrame([(1, "F", 30, "x")], "subject_id int, gender string, anchor_age int, anchor_year_group string")
    counts = StepCounts()
    out = write_scratch(CO.join_patients(CO.join_first_window(labs, adm, "24 hours", counts), pat, counts), "t")
    assert sorted((r.subject_id, r.gender) for r in out.collect()) == [(1, "F"), (4, None)]
    want = [("events", "rows", 6), ("events", "null_keys", 2), ("admissions", "rows", 4), ("admissions", "null_keys", 1),
            ("events_with_admission", "rows", 3), ("events_in_window", "rows", 2), ("events_with_patient", "rows", 2),
            ("events_with_patient", "null_keys", 0), ("events_with_patient", "no_patient", 1)]
    assert counts.rows() == want and [tuple(r) for r in counts.table(spark).collect()] == want
    plain = CO.join_patients(CO.join_first_window(labs, adm), pat)
    assert plain.columns == out.columns and plain.count() == 2


def test_one_scan_in_the_plan(spark):
    sf = "/root/testdata/sf0.001"
    from modelwatch.plans import fixtures as fx
    counts = StepCounts()
    j = CO.join_first_window(fx.lab_events(spark, sf), fx.admissions(spark, sf), "90 days", counts)
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 4 and sum("lineitem.parquet" in line for line in plan.split("\n")) == 1


def test_an_empty_side(spark):
    counts = StepCounts()
    none = spark.createDataFrame([], "subject_id int, hadm_id int, charttime timestamp_ntz, itemid int")
    adm = spark.createDataFrame([], "subject_id int, hadm_id int, admittime timestamp_ntz, admission_type string")
    assert write_scratch(CO.join_first_window(none, adm, "1 day", counts), "t").count() == 0
    assert {v for _, _, v in counts.rows()} == {0}


def test_scan_counts_bad_rows(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("﻿y_true,y_pred_prob\n1,0.5\nx,0.5\n0,high\n,\n1.0,0.2\n", encoding="utf-8")
    counts = StepCounts()
    assert write_scratch(S.scan_predictions(spark, str(path), counts=counts), "t").count() == 1
    assert counts.rows() == [("predictions", "rows", 5), ("predictions", "bad_label", 3), ("predictions", "bad_score", 2)]
