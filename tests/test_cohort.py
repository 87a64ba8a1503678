"""Cohort build on hand-made frames: window edges, null gender, missing lab column, split."""
import datetime as dt

from modelwatch.operators import cohort as CO


def test_build_cohort(spark):
    t0 = dt.datetime(2020, 1, 1, 8, 0)
    h = dt.timedelta(hours=1)
    events = spark.createDataFrame([
        (1, 10, t0, 100, 5.0, "u"), (1, 10, t0 + 24 * h, 100, 7.0, "u"),       # both edges are inside
        (1, 10, t0 + 25 * h, 100, 99.0, "u"), (1, 10, t0 - h, 100, 99.0, "u"),  # outside the window
        (1, 10, t0 + h, 200, 2.5, "u"), (1, 10, t0 + h, 300, None, "u"),        # NULL value dropped
        (2, 20, t0, 100, 3.0, "u"), (2, 20, t0, 100, 2e6, "u"),                 # out of range dropped
        (3, 30, t0, 999, 1.0, "u"),                                             # not a target item
        (4, 40, t0, 100, 4.0, "u"),                                             # patient with NULL gender
    ], "subject_id long, hadm_id long, charttime timestamp_ntz, itemid long, valuenum double, valueuom string")
    adm = spark.createDataFrame([(1, 10, t0, "URGENT"), (2, 20, t0, "ELECTIVE"), (3, 30, t0, "ELECTIVE"),
                                 (2, 20, t0 + h, "ELECTIVE"), (4, 40, t0, "URGENT")],
                                "subject_id long, hadm_id long, admittime timestamp_ntz, admission_type string")
    pat = spark.createDataFrame([(1, "F", 60, "2017"), (2, "M", 40, "2014"), (4, None, 30, "2011")],
                                "subject_id long, gender string, anchor_age int, anchor_year_group string")
    items = spark.createDataFrame([(100, "White Blood Cells"), (200, "LACTATE"), (300, "Creatinine"),
                                   (999, "Other")], "itemid long, label string")
    c = CO.build_cohort(events, adm.where("admittime = timestamp_ntz'2020-01-01 08:00:00'"), pat, items)
    out = {r["hadm_id"]: r for r in c.collect()}
    assert out[10]["wbc"] == 6.0 and out[10]["lactate"] == 2.5 and out[10]["creatinine"] is None
    assert out[20]["gender"] == "M" and out[20]["wbc"] == 3.0
    assert 40 not in out and 30 not in out      # NULL grouping key dropped (as pandas groupby); no target item
    assert set(c.columns) >= set(CO.COHORT_COLUMNS)
    assert [out[10]["split"], out[20]["split"]] == ["baseline", "current"]
    first = {r["hadm_id"]: r["charttime"] for r in CO.join_admit_time(c.select("hadm_id"), adm).collect()}
    assert first[20] == t0


def test_split_half_positions(spark):
    df = spark.range(0, 101).selectExpr("id % 7 AS subject_id", "id AS hadm_id", "id AS charttime")
    s = CO.split_half(df)
    got = sorted((r["position"], r["subject_id"], r["hadm_id"]) for r in s.collect())
    assert [g[0] for g in got] == list(range(101))
    assert [(g[1], g[2]) for g in got] == sorted((g[1], g[2]) for g in got)
    assert s.where("split = 'baseline'").count() == 50
