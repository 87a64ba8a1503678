"""Plan checks: column pruning and filter pushdown reach the Parquet scan; per-feature
drift tables are broadcast."""
import re

from conftest import SF001


def _plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_cohort_scan_is_pruned_and_filtered(spark):
    from modelwatch.plans.registry import QUERIES
    plan = _plan(QUERIES["join_first_24h"](spark, SF001))
    assert "FileScan parquet [l_orderkey,l_partkey,l_extendedprice,l_shipdate]" in plan
    scan = [l for l in plan.splitlines() if "FileScan parquet [l_orderkey" in l][0]
    assert "PushedFilters: [IsNotNull(l_extendedprice)" in scan and "GreaterThan(l_extendedprice" in scan


def test_drift_split_filter_is_pushed(spark):
    from modelwatch.plans import fixtures as fx
    b, _ = fx.drift_pair_lineitem(spark, SF001)
    plan = _plan(b.select("l_quantity"))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan
    assert "ReadSchema: struct<l_quantity:double" in plan


def test_drift_feature_tables_are_broadcast(spark):
    from modelwatch.operators import drift as D
    from modelwatch.plans import fixtures as fx
    b, c = fx.drift_pair_lineitem(spark, SF001)
    plan = _plan(D.drift_by_feature(b, c, cols=fx.DRIFT_LINEITEM_COLS))
    assert "BroadcastHashJoin [feature], [feature]" in plan
    assert "SortMergeJoin" not in plan


def _exchange_keys(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", _plan(df))


def test_running_totals_never_move_rows_on_the_segment_alone(spark):
    """Rows are exchanged on (segment, part). On the segment alone only the totals per
    (segment, part) move: one exchange for the offsets."""
    from modelwatch.operators import metrics as M
    df = spark.range(1000).selectExpr("id % 3 AS segment", "id % 2 AS y_true", "id / 1000 AS y_score")
    keys = _exchange_keys(M.running_counts(df, by=["segment"]))
    assert keys.count("segment") == 1 and keys.count("segment, _part") == 2


def test_threshold_metrics_are_one_aggregate(spark):
    from modelwatch.operators import metrics as M
    df = spark.range(100).selectExpr("id % 2 AS y_true", "id / 100 AS y_score")
    for f in (M.accuracy_at_threshold, M.f1_at_threshold, M.classification_counts, M.log_loss):
        plan = _plan(f(df))
        assert "Window" not in plan and "Scan ExistingRDD" not in plan and plan.count("Exchange") == 1
