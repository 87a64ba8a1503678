"""Query registry: one entry per operator of the inventory, each with its SQL twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator on stand-in inputs
formed from the driver's tables (whole tables, no row caps). ``ORACLE[name]`` is the
same computation in plain SQL for DuckDB. Operators that SQL cannot express (model
training, hashing of files) have no oracle entry.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelwatch.plans import fixtures as fx
from modelwatch.operators import registry_versions as RV
from modelwatch.operators.counts import StepCounts, counting_session
from modelwatch.session import drop_scratch, materialize, write_scratch
from modelwatch.plans import oracle as osql
from modelwatch.operators import metrics as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _scratch(spark, name: str) -> str:
    from modelwatch.session import scratch_path
    return scratch_path(spark, name)


def both_splits(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """The rows of both splits, with a ``split`` column."""
    return baseline.withColumn("split", F.lit("baseline")).unionByName(current.withColumn("split", F.lit("current")))


def both_sql(baseline: str, current: str) -> str:
    return (f"SELECT 'baseline' AS split, * FROM ({baseline}) b_ UNION ALL "
            f"SELECT 'current' AS split, * FROM ({current}) c_")


# ------------------------------------------------------------------ 2.4 metrics
SEG = ["segment"]


@register("performance_metrics", osql.metrics_sql(fx.PREDICTIONS_TIES_SQL))
def q_performance_metrics(spark, sf):
    return M.performance_metrics(fx.predictions_ties(spark, sf))


@register("performance_metrics_by_segment", osql.metrics_sql(fx.PREDICTIONS_UNIQUE_SQL, SEG))
def q_performance_metrics_by_segment(spark, sf):
    return M.performance_metrics(fx.predictions_unique(spark, sf), by=SEG)


@register("performance_metrics_text", osql.metrics_sql(fx.PREDICTIONS_TEXT_SQL, SEG))
def q_performance_metrics_text(spark, sf):
    return M.performance_metrics(fx.predictions_text(spark, sf), by=SEG)


@register("basic_performance", osql.metrics_sql(fx.PREDICTIONS_UNIQUE_SQL, (), M.BASIC_COLUMNS))
def q_basic_performance(spark, sf):
    return M.basic_performance(fx.predictions_unique(spark, sf))


@register("classification_counts",
          osql.metrics_sql(fx.PREDICTIONS_TIES_SQL, SEG, ["n", "positive_rate", "tp", "fp", "fn"]))
def q_classification_counts(spark, sf):
    return M.classification_counts(fx.predictions_ties(spark, sf), by=SEG)


@register("accuracy_at_threshold", osql.metrics_sql(fx.PREDICTIONS_UNIQUE_SQL, SEG, ["n", "accuracy_at_05"]))
def q_accuracy(spark, sf):
    return M.accuracy_at_threshold(fx.predictions_unique(spark, sf), by=SEG)


@register("f1_at_threshold", osql.metrics_sql(
    fx.PREDICTIONS_UNIQUE_SQL, SEG, ["n", "precision_at_05", "recall_at_05", "f1_at_05"]))
def q_f1(spark, sf):
    return M.f1_at_threshold(fx.predictions_unique(spark, sf), by=SEG)


@register("log_loss", osql.metrics_sql(fx.PREDICTIONS_UNIQUE_SQL, SEG, ["n", "log_loss"]))
def q_log_loss(spark, sf):
    return M.log_loss(fx.predictions_unique(spark, sf), by=SEG)


@register("auroc", osql.metrics_sql(fx.PREDICTIONS_UNIQUE_SQL, (), ["n", "auroc"]))
def q_auroc(spark, sf):
    return M.auroc(fx.predictions_unique(spark, sf))


@register("auprc", osql.metrics_sql(fx.PREDICTIONS_UNIQUE_SQL, SEG, ["n", "auprc"]))
def q_auprc(spark, sf):
    return M.auprc(fx.predictions_unique(spark, sf), by=SEG)


@register("score_ks", osql.metrics_sql(fx.PREDICTIONS_TIES_SQL, (), ["n", "ks_stat"]))
def q_score_ks(spark, sf):
    return M.score_ks(fx.predictions_ties(spark, sf))


@register("best_f1", osql.metrics_sql(fx.PREDICTIONS_TIES_SQL, SEG, ["n", "best_f1_threshold", "best_f1"]))
def q_best_f1(spark, sf):
    return M.best_f1(fx.predictions_ties(spark, sf), by=SEG)


@register("average_rank", osql.average_rank_sql(fx.PREDICTIONS_UNIQUE_SQL, SEG))
def q_average_rank(spark, sf):
    return M.average_rank(fx.predictions_unique(spark, sf), by=SEG)


@register("running_counts", osql.running_counts_sql(fx.PREDICTIONS_TIES_SQL, SEG))
def q_running_counts(spark, sf):
    return M.running_counts(fx.predictions_ties(spark, sf), by=SEG)


@register("distinct_scores", f"SELECT DISTINCT segment, y_score AS score FROM ({fx.PREDICTIONS_TIES_SQL}) t")
def q_distinct_scores(spark, sf):
    return M.distinct_scores(fx.predictions_ties(spark, sf), by=SEG)


# ------------------------------------------------------------------ drift (2.4, 2.2)
from modelwatch.operators import drift as D  # noqa: E402
from modelwatch.operators import sketch_drift as SD  # noqa: E402
from modelwatch.functions import columns as C  # noqa: E402
from modelwatch.operators import schema_tables as ST  # noqa: E402

_B_SQL, _C_SQL = fx.drift_lineitem_sql("baseline"), fx.drift_lineitem_sql("current")
_C_SHIFT_SQL = fx.drift_lineitem_sql("current", shift_quantity=1.2)


def _pair_b(spark, sf):
    return fx.drift_pair_lineitem(spark, sf)


@register("drift_by_feature", osql.drift_sql(_B_SQL, _C_SQL, fx.DRIFT_LINEITEM_COLS))
def q_drift_by_feature(spark, sf):
    b, c = _pair_b(spark, sf)
    return D.drift_by_feature(b, c, ignore_cols=fx.LINEITEM_ID_COLS)


@register("drift_by_feature_shifted", osql.drift_sql(_B_SQL, _C_SHIFT_SQL, fx.DRIFT_LINEITEM_COLS))
def q_drift_shifted(spark, sf):
    b, c = fx.drift_pair_lineitem(spark, sf, shift_quantity=1.2)
    return D.drift_by_feature(b, c, ignore_cols=fx.LINEITEM_ID_COLS)


@register("drift_max", osql.drift_sql(_B_SQL, _C_SQL, fx.DRIFT_LINEITEM_COLS, "max"))
def q_drift_max(spark, sf):
    b, c = _pair_b(spark, sf)
    return D.drift_max(D.drift_by_feature(b, c, ignore_cols=fx.LINEITEM_ID_COLS))


@register("psi", osql.drift_sql(fx.DRIFT_EVENTS_BASE_SQL, fx.DRIFT_EVENTS_CURR_SQL, fx.DRIFT_EVENTS_COLS, "psi"))
def q_psi(spark, sf):
    b, c = fx.drift_pair_events(spark, sf)
    return D.psi(b, c, fx.DRIFT_EVENTS_COLS)


@register("psi_bins", osql.drift_sql(_B_SQL, _C_SHIFT_SQL, fx.DRIFT_LINEITEM_COLS, "psi", bins=25))
def q_psi_bins(spark, sf):
    b, c = fx.drift_pair_lineitem(spark, sf, shift_quantity=1.2)
    return D.psi(b, c, fx.DRIFT_LINEITEM_COLS, bins=25)


def _within(sketched: DataFrame, exact: DataFrame) -> DataFrame:
    """Sketched drift beside the exact values: whether they lie in the limits."""
    e = exact.select("feature", F.col("psi").alias("_psi"), F.col("ks").alias("_ks"), F.col("drift_flag").alias("_flag"))
    slack = 1e-9
    return sketched.join(e, "feature").select(
        "feature", "n_base", "n_curr", ((F.col("_psi") >= F.col("psi_low") - slack) & (F.col("_psi") <= F.col("psi_high") + slack)).alias("psi_within"),
        ((F.col("_ks") >= F.col("ks_low") - slack) & (F.col("_ks") <= F.col("ks_high") + slack)).alias("ks_within"),
        F.when(F.col("decided"), F.col("drift_flag")).otherwise(F.col("_flag")).alias("drift_flag"))


@register("drift_sketched", osql.drift_sql(_B_SQL, _C_SHIFT_SQL, fx.DRIFT_LINEITEM_COLS, "sketched"))
def q_drift_sketched(spark, sf):
    b, c = fx.drift_pair_lineitem(spark, sf, shift_quantity=1.2)
    return _within(SD.sketched_drift(b, c, fx.DRIFT_LINEITEM_COLS),
                   D.drift_by_feature(b, c, cols=fx.DRIFT_LINEITEM_COLS, rounded=False))


@register("drift_windows", osql.drift_sql(fx.DRIFT_EVENTS_BASE_SQL, fx.DRIFT_EVENTS_CURR_SQL, fx.DRIFT_EVENTS_COLS, "sketched"))
def q_drift_windows(spark, sf):
    """A sketch a day, stored; two windows of days merged and compared."""
    events = fx.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    path = SD.sink_sketches(SD.column_sketches(events, fx.DRIFT_EVENTS_COLS, by=["day"]), _scratch(spark, "sketches"), ["day"])
    stored, split = spark.read.parquet(path), F.col("day") < F.lit(fx.EVENTS_SPLIT_TS).cast("date")
    merged = SD.drift_of_sketches(SD.merge_sketches(stored.where(split)), SD.merge_sketches(stored.where(~split)))
    return _within(merged, D.drift_by_feature(*fx.drift_pair_events(spark, sf), cols=fx.DRIFT_EVENTS_COLS, rounded=False))


@register("ks_two_sample", osql.drift_sql(_B_SQL, _C_SQL, fx.DRIFT_LINEITEM_COLS, "ks"))
def q_ks_two_sample(spark, sf):
    b, c = _pair_b(spark, sf)
    return D.ks_two_sample(b, c, fx.DRIFT_LINEITEM_COLS)


@register("psi_edges", osql.drift_sql(_B_SQL, _C_SQL, fx.DRIFT_LINEITEM_COLS, "edges"))
def q_psi_edges(spark, sf):
    b, c = _pair_b(spark, sf)
    return D.psi_edges(b, c, fx.DRIFT_LINEITEM_COLS)


_REPORT_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"] + fx.DRIFT_LINEITEM_COLS
_REPORT_CAT = ["l_returnflag", "l_linestatus", "l_shipdate"]


@register("drift_report", osql.drift_report_sql(_B_SQL, _C_SHIFT_SQL, _REPORT_NUM, _REPORT_CAT))
def q_drift_report(spark, sf):
    b, c = fx.drift_pair_lineitem(spark, sf, shift_quantity=1.2)
    return D.drift_report(b, c)


@register("dataset_drift", osql.drift_report_sql(_B_SQL, _C_SHIFT_SQL, _REPORT_NUM, _REPORT_CAT, summary=True))
def q_dataset_drift(spark, sf):
    b, c = fx.drift_pair_lineitem(spark, sf, shift_quantity=1.2)
    return D.dataset_drift(D.drift_report(b, c))


# Column pickers: the picked columns with their finite-value counts on each side.
@register("drift_columns", ST.drift_columns_sql(_B_SQL, _C_SQL, fx.DRIFT_LINEITEM_COLS))
def q_drift_columns(spark, sf):
    b, c = _pair_b(spark, sf)
    return ST.drift_columns_table(b, c, ignore_cols=fx.LINEITEM_ID_COLS)


@register("common_columns", ST.common_columns_sql(_B_SQL, _C_SQL, ST.LINEITEM_ALL))
def q_common_columns(spark, sf):
    b, c = _pair_b(spark, sf)
    return ST.common_columns_table(b, c)


@register("finite_filter", both_sql(*[ST.finite_counts_sql(side, ["value", "user_id"])
                                      for side in (fx.DRIFT_EVENTS_BASE_SQL, fx.DRIFT_EVENTS_CURR_SQL)]))
def q_finite_filter(spark, sf):
    return both_splits(*[ST.finite_counts(side, ["value", "user_id"]) for side in fx.drift_pair_events(spark, sf)])


@register("infer_roles", both_sql(ST.roles_sql(_B_SQL, ST.LINEITEM_ROLES), ST.roles_sql(_C_SQL, ST.LINEITEM_ROLES)))
def q_infer_roles(spark, sf):
    return both_splits(*[ST.roles_table(side) for side in _pair_b(spark, sf)])


# ------------------------------------------------------------------ prep (2.2, 2.4)
from modelwatch.functions.scalar import round6  # noqa: E402
from modelwatch.operators import prep as P  # noqa: E402
from modelwatch.operators import cohort as CO  # noqa: E402


def rounded(df: DataFrame, cols) -> DataFrame:
    """Cast the given numeric columns to double and round to 6 places (both sides do)."""
    cols = set(cols)
    return df.select(*[round6(F.col(c).cast("double")).alias(c) if c in cols else F.col(c) for c in df.columns])


PREP_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
PREP_OTHER = ["l_returnflag", "l_linestatus", "l_shipdate"]
_PB_SQL = fx.drift_lineitem_sql("baseline", null_quantity=True)
_PC_SQL = fx.drift_lineitem_sql("current", null_quantity=True)


def _prep_pair(spark, sf):
    return fx.drift_pair_lineitem(spark, sf, null_quantity=True)


def _prep_frames(spark, sf):
    return dict(zip(("baseline", "current"), _prep_pair(spark, sf)))


def _both_rounded(frames):
    return both_splits(rounded(frames["baseline"], PREP_NUM), rounded(frames["current"], PREP_NUM))


def _impute_q(strategy):
    def q(spark, sf):
        return _both_rounded(P.impute_many(_prep_frames(spark, sf), PREP_NUM, strategy))
    return q


def _impute_sql(src, strategy):
    return (f"WITH {osql._impute_sql(src, PREP_NUM, PREP_OTHER, strategy, 'b1')} "
            f"SELECT {osql.round_cols(PREP_NUM + PREP_OTHER, set(PREP_NUM)).replace('round(', 'round(CAST(').replace(', 6)', ' AS DOUBLE), 6)')} FROM b1")


for _s in ("drop", "zero", "median"):
    register(f"impute_{_s}", both_sql(_impute_sql(_PB_SQL, _s), _impute_sql(_PC_SQL, _s)))(_impute_q(_s))


def _clip_q(method):
    def q(spark, sf):
        frames = P.impute_many(_prep_frames(spark, sf), PREP_NUM, "drop")
        bounds = P.clip_bounds_many(frames, PREP_NUM, method)
        return _both_rounded({side: P.apply_clip(df, bounds[side]) for side, df in frames.items()})
    return q


def _clip_sql(src, method):
    return (f"WITH {osql._impute_sql(src, PREP_NUM, PREP_OTHER, 'drop', 'b1')}, "
            f"{osql._clip_sql('b1', PREP_NUM, PREP_OTHER, method, 'b2')} "
            f"SELECT {osql.round_cols(PREP_NUM + PREP_OTHER, set(PREP_NUM))} FROM b2")


register("clip_zscore", both_sql(_clip_sql(_PB_SQL, "zscore"), _clip_sql(_PC_SQL, "zscore")))(_clip_q("zscore"))
register("clip_iqr", both_sql(_clip_sql(_PB_SQL, "iqr"), _clip_sql(_PC_SQL, "iqr")))(_clip_q("iqr"))


def _prepare_q(**options):
    def q(spark, sf):
        bp, cp, _, _, _ = P.prepare_pair(*_prep_pair(spark, sf), P.PrepConfig(**options))
        return _both_rounded({"baseline": bp, "current": cp})
    return q


def _prepare_sql(what="frame", **options):
    return both_sql(*[osql.prep_sql(_PB_SQL, _PC_SQL, PREP_NUM, PREP_OTHER, side=side, what=what, **options)
                      for side in ("baseline", "current")])


for _s in ("standard", "minmax", "none"):
    register(f"scale_{_s}", _prepare_sql(scaler=_s))(_prepare_q(scaler=_s))
register("prepare", _prepare_sql(impute="median", outliers="iqr"))(_prepare_q(impute="median", outliers="iqr"))


@register("column_profile", both_sql(*[f"WITH b AS ({src}) {osql.profile_sql('b', PREP_NUM)}" for src in (_PB_SQL, _PC_SQL)]))
def q_column_profile(spark, sf):
    return P.column_profile_many(_prep_frames(spark, sf), PREP_NUM).withColumnRenamed("side", "split")


@register("column_profile_after", _prepare_sql("profile"))
def q_column_profile_after(spark, sf):
    _, _, _, bi, ci = P.prepare_pair(*_prep_pair(spark, sf))
    return both_splits(bi["post_stats"](), ci["post_stats"]())


_SCALER_SQL = (f"WITH {osql._impute_sql(_PB_SQL, PREP_NUM, PREP_OTHER, 'drop', 'b1')}, "
               f"{osql._clip_sql('b1', PREP_NUM, PREP_OTHER, 'zscore', 'b2')} "
               + " UNION ALL ".join(
                   f"SELECT '{c}' AS feature, 'standard' AS kind, round(avg({c}), 6) AS center, "
                   f"round(CASE WHEN stddev_pop({c}) < {osql.TINY} THEN 1.0 ELSE stddev_pop({c}) END, 6) AS scale "
                   f"FROM b2" for c in PREP_NUM))


@register("scaler_params", _SCALER_SQL)
def q_scaler_params(spark, sf):
    b, c = _prep_pair(spark, sf)
    _, _, scaler, _, _ = P.prepare_pair(b, c)
    t = scaler.to_dataframe(spark)
    return t.select("feature", "kind", round6("center").alias("center"), round6("scale").alias("scale"))


@register("split_columns", both_sql(ST.split_columns_sql(_PB_SQL, [], PREP_NUM), ST.split_columns_sql(_PC_SQL, [], PREP_NUM)))
def q_split_columns(spark, sf):
    return both_splits(*[ST.split_columns_table(side, *C.split_columns(side)) for side in _prep_pair(spark, sf)])


# ------------------------------------------------------------------ cohort (2.1, 2.3, 2.4, 2.5, 2.6)
_T = fx.COHORT_TARGETS
_COHORT_CTES = osql.cohort_ctes(fx.LAB_EVENTS_SQL, fx.ADMISSIONS_SQL, fx.PATIENTS_SQL, fx.LAB_ITEMS_SQL,
                                _T, "365 DAY")
_LABS = list(_T.values())


def _cohort(spark, sf):
    return CO.build_cohort(fx.lab_events(spark, sf), fx.admissions(spark, sf), fx.patients(spark, sf),
                           fx.lab_items(spark, sf), labels=_T, window=fx.COHORT_WINDOW)


@register("build_cohort", f"WITH {_COHORT_CTES} SELECT * EXCLUDE ({', '.join(_LABS)}), "
                          + ", ".join(f"round({c}, 6) AS {c}" for c in _LABS) + " FROM cohort")
def q_build_cohort(spark, sf):
    return rounded(_cohort(spark, sf), _LABS)


@register("split_half", f"WITH {_COHORT_CTES} SELECT subject_id, hadm_id, position, split FROM cohort")
def q_split_half(spark, sf):
    return _cohort(spark, sf).select("subject_id", "hadm_id", "position", "split")


@register("sample_metadata", f"WITH {_COHORT_CTES} SELECT split, CAST(COUNT(*) AS BIGINT) AS rows, "
                             f"'{','.join(CO.COHORT_COLUMNS)}' AS columns FROM cohort GROUP BY split")
def q_sample_metadata(spark, sf):
    return CO.sample_metadata(_cohort(spark, sf))


@register("row_counts", f"WITH {_COHORT_CTES} SELECT split, CAST(COUNT(*) AS BIGINT) AS rows FROM cohort GROUP BY split")
def q_row_counts(spark, sf):
    return CO.sample_metadata(_cohort(spark, sf)).select("split", "rows")


@register("sort_cohort", f"WITH {_COHORT_CTES} SELECT subject_id, hadm_id, charttime, position, position AS place, true AS in_order FROM cohort")
def q_sort_cohort(spark, sf):
    """The cohort sorted; ``place`` is where a row came out: its part of the sort, read back in
    order, and its row there. ``in_order``: no row before it in its part sorts after it."""
    keys = ["subject_id", "hadm_id", "charttime"]
    out = _cohort(spark, sf).select(*keys, "position").orderBy(*keys)
    # Rows of the sorted parts are numbered as they stand; the parts' sizes give the offsets.
    parted = write_scratch(out.withColumn("id", F.monotonically_increasing_id()), "sorted")
    part, at = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = parted.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))   # a row a part
    placed = parted.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    upto = Window.partitionBy("part").orderBy("id")
    row = F.struct(*keys)
    return placed.select(*keys, "position", (F.col("before") + at).alias("place"),
                         F.coalesce(F.lag(row).over(upto) <= row, F.lit(True)).alias("in_order"))


@register("derive_label", f"WITH {_COHORT_CTES} SELECT subject_id, hadm_id, round(lactate, 6) AS lactate, "
                          f"CASE WHEN coalesce(lactate, 0) >= 2.0 THEN 1 ELSE 0 END AS label FROM cohort")
def q_derive_label(spark, sf):
    from modelwatch.functions.scalar import derive_label
    c = _cohort(spark, sf)
    return rounded(c.select("subject_id", "hadm_id", "lactate", derive_label("lactate").alias("label")), ["lactate"])


def _labs_in_window(spark, sf, window=fx.COHORT_WINDOW):
    targets = CO.item_lookup(fx.lab_items(spark, sf), list(_T))
    labs = CO.scan_events_filtered(fx.lab_events(spark, sf), targets)
    return CO.join_first_window(labs, fx.admissions(spark, sf), window)


@register("item_lookup", f"WITH {_COHORT_CTES} SELECT itemid, label FROM t")
def q_item_lookup(spark, sf):
    return CO.item_lookup(fx.lab_items(spark, sf), list(_T))


@register("semi_join_items", f"WITH {_COHORT_CTES} SELECT e.subject_id, e.hadm_id, e.itemid, e.valuenum "
                             f"FROM ({fx.LAB_EVENTS_SQL}) e WHERE e.itemid IN (SELECT itemid FROM t)")
def q_semi_join_items(spark, sf):
    ids = CO.item_lookup(fx.lab_items(spark, sf), list(_T))
    return CO.semi_join_items(fx.lab_events(spark, sf), ids).select("subject_id", "hadm_id", "itemid", "valuenum")


@register("scan_events_filtered", f"WITH {_COHORT_CTES} SELECT subject_id, hadm_id, charttime, itemid, valuenum, label FROM labs")
def q_scan_events_filtered(spark, sf):
    targets = CO.item_lookup(fx.lab_items(spark, sf), list(_T))
    return CO.scan_events_filtered(fx.lab_events(spark, sf), targets) \
             .select("subject_id", "hadm_id", "charttime", "itemid", "valuenum", "label")


@register("join_item_labels", f"WITH {_COHORT_CTES} SELECT label, CAST(COUNT(*) AS BIGINT) AS rows, "
                              f"round(avg(valuenum), 6) AS mean_value FROM labs GROUP BY label")
def q_join_item_labels(spark, sf):
    targets = CO.item_lookup(fx.lab_items(spark, sf), list(_T))
    labs = CO.scan_events_filtered(fx.lab_events(spark, sf), targets)
    return labs.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("rows"),
                                     round6(F.avg("valuenum")).alias("mean_value"))


@register("range_filter", f"SELECT CAST(COUNT(*) AS BIGINT) AS kept FROM ({fx.LAB_EVENTS_SQL}) e "
                          f"WHERE valuenum > -1e6 AND valuenum < 1e6")
def q_range_filter(spark, sf):
    from modelwatch.functions.scalar import in_open_range
    return fx.lab_events(spark, sf).where(in_open_range("valuenum")).agg(F.count(F.lit(1)).cast("long").alias("kept"))


@register("join_events_admissions",
          f"WITH {_COHORT_CTES} SELECT labs.subject_id, labs.hadm_id, labs.charttime, labs.itemid, adm.admittime "
          f"FROM labs JOIN adm ON labs.subject_id = adm.subject_id AND labs.hadm_id = adm.hadm_id")
def q_join_events_admissions(spark, sf):
    targets = CO.item_lookup(fx.lab_items(spark, sf), list(_T))
    labs = CO.scan_events_filtered(fx.lab_events(spark, sf), targets)
    return CO.join_events_admissions(labs, fx.admissions(spark, sf)).select("subject_id", "hadm_id", "charttime", "itemid", "admittime")


_GAPS_SQL = ("gaps AS (SELECT CASE WHEN o_custkey % 13 <> 0 THEN o_custkey END AS subject_id, CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey END AS hadm_id, "
             "l_shipdate AS charttime FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
             "adm AS (SELECT o_custkey AS subject_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS hadm_id, o_orderdate AS admittime FROM orders), "
             "pat AS (SELECT c_custkey AS subject_id FROM customer WHERE c_custkey % 5 <> 0), "
             "j AS (SELECT * FROM gaps JOIN adm USING (subject_id, hadm_id)), "
             "w AS (SELECT * FROM j WHERE charttime >= admittime AND charttime <= admittime + INTERVAL 90 DAY)")


@register("join_counts", f"WITH {_GAPS_SQL} SELECT 'events' AS step, 'rows' AS count, CAST(count(*) AS BIGINT) AS value FROM gaps "
          "UNION ALL SELECT 'events', 'null_keys', count(*) FILTER (WHERE subject_id IS NULL OR hadm_id IS NULL) FROM gaps "
          "UNION ALL SELECT 'admissions', 'rows', count(*) FROM adm UNION ALL SELECT 'admissions', 'null_keys', count(*) FILTER (WHERE hadm_id IS NULL) FROM adm "
          "UNION ALL SELECT 'events_with_admission', 'rows', count(*) FROM j UNION ALL SELECT 'events_in_window', 'rows', count(*) FROM w "
          "UNION ALL SELECT 'events_with_patient', 'rows', count(*) FROM w UNION ALL SELECT 'events_with_patient', 'null_keys', count(*) FILTER (WHERE subject_id IS NULL) FROM w "
          "UNION ALL SELECT 'events_with_patient', 'no_patient', count(*) FILTER (WHERE subject_id NOT IN (SELECT subject_id FROM pat)) FROM w "
          "UNION ALL SELECT 'predictions', 'rows', count(*) FROM lineitem "
          "UNION ALL SELECT 'predictions', 'bad_label', count(*) FILTER (WHERE l_linenumber = 3) FROM lineitem "
          "UNION ALL SELECT 'predictions', 'bad_score', count(*) FILTER (WHERE l_linenumber IN (3, 5)) FROM lineitem")
def q_join_counts(spark, sf):
    """Rows without keys, partners or valid values, counted by the joins and the scan themselves."""
    user, spark = spark, counting_session(spark)
    gap = (lambda c, m: F.when(F.col(c) % m != 0, F.col(c)).alias(c))
    labs = fx.lab_events(spark, sf).select(gap("subject_id", 13), gap("hadm_id", 7), "charttime", "itemid")
    adm = fx.admissions(spark, sf).withColumn("hadm_id", gap("hadm_id", 11))
    counts = StepCounts()
    j = CO.join_patients(CO.join_first_window(labs, adm, "90 days", counts), fx.patients(spark, sf).where("subject_id % 5 <> 0"), counts)
    drop_scratch(write_scratch(j, "events"))
    path, n = _scratch(spark, "predictions"), F.col("l_linenumber")
    fx.table(spark, sf, "lineitem").select(
        F.when(n == 3, "n/a").otherwise("1").alias("y_true"), F.when(n.isin(3, 5), "high").otherwise("0.5").alias("y_pred_prob")).write.option("header", True).csv(path)
    drop_scratch(write_scratch(S.scan_predictions(spark, path, counts=counts), "scored"))
    EV.remove(spark, path)
    return counts.table(user)


@register("join_first_24h", f"WITH {_COHORT_CTES} SELECT subject_id, hadm_id, charttime, itemid, label, admittime FROM j")
def q_join_first_24h(spark, sf):
    return _labs_in_window(spark, sf).select("subject_id", "hadm_id", "charttime", "itemid", "label", "admittime")


@register("join_patients", f"WITH {_COHORT_CTES} SELECT subject_id, hadm_id, itemid, gender, anchor_age FROM jp")
def q_join_patients(spark, sf):
    return CO.join_patients(_labs_in_window(spark, sf), fx.patients(spark, sf)) \
             .select("subject_id", "hadm_id", "itemid", "gender", "anchor_age")


@register("median_per_admission", f"WITH {_COHORT_CTES} SELECT subject_id, hadm_id, admission_type, anchor_age, "
                                  f"anchor_year_group, gender, label, round(value, 6) AS value FROM med")
def q_median_per_admission(spark, sf):
    labs = CO.join_patients(_labs_in_window(spark, sf), fx.patients(spark, sf))
    return rounded(CO.median_per_admission(labs), ["value"])


@register("pivot_labs", f"WITH {_COHORT_CTES} SELECT subject_id, hadm_id, admission_type, anchor_age, "
                        f"anchor_year_group, gender, " + ", ".join(f"round({c}, 6) AS {c}" for c in _LABS) + " FROM wide")
def q_pivot_labs(spark, sf):
    labs = CO.join_patients(_labs_in_window(spark, sf), fx.patients(spark, sf))
    return rounded(CO.pivot_labs(CO.median_per_admission(labs), _T), _LABS)


@register("rename_labels", f"WITH {_COHORT_CTES} " + " UNION ALL ".join(
    f"SELECT subject_id, hadm_id, '{c}' AS lab, round({c}, 6) AS value FROM wide" for c in _LABS))
def q_rename_labels(spark, sf):
    """Columns under the item labels, renamed to the short names and listed by name."""
    labs = CO.join_patients(_labs_in_window(spark, sf), fx.patients(spark, sf))
    wide = CO.rename_labels(CO.pivot_items(CO.median_per_admission(labs), list(_T)), _T)
    return rounded(wide.select("subject_id", "hadm_id", *_LABS), _LABS).unpivot(["subject_id", "hadm_id"], _LABS, "lab", "value")


@register("join_admit_time", f"WITH {_COHORT_CTES} SELECT subject_id, hadm_id, charttime, "
                             + ", ".join(f"round({c}, 6) AS {c}" for c in _LABS) + " FROM cw")
def q_join_admit_time(spark, sf):
    labs = CO.join_patients(_labs_in_window(spark, sf), fx.patients(spark, sf))
    wide = CO.join_admit_time(CO.pivot_labs(CO.median_per_admission(labs), _T), fx.admissions(spark, sf))
    return rounded(wide.select("subject_id", "hadm_id", "charttime", *_LABS), _LABS)


@register("dedupe_first", f"SELECT hadm_id, min(charttime) AS charttime FROM ({fx.LAB_EVENTS_SQL}) e GROUP BY hadm_id")
def q_dedupe_first(spark, sf):
    """Earliest of several rows per admission (here: the lab events' times)."""
    return CO.dedupe_first(fx.lab_events(spark, sf).select("hadm_id", F.col("charttime").alias("admittime")))


# ------------------------------------------------------------------ fairness (2.4, 2.9)
from modelwatch.operators import fairness as FA  # noqa: E402
from modelwatch.operators import attribution as A  # noqa: E402
from modelwatch.operators import gate as G  # noqa: E402
from modelwatch.operators import history as H  # noqa: E402
from modelwatch.plans import runs as PL  # noqa: E402

_RATES_SQL = (f"SELECT segment, 'positive_rate' AS metric, CAST(gender AS VARCHAR) AS \"group\", "
              f"round(avg(CASE WHEN TRY_CAST(label AS DOUBLE) = 1 THEN 1.0 ELSE 0.0 END), 6) AS value "
              f"FROM ({fx.FAIRNESS_FRAME_SQL}) f WHERE gender IS NOT NULL GROUP BY segment, gender")
_PARITY_SQL = (f"SELECT segment AS run_id, CAST(COUNT(*) AS BIGINT) AS n_groups, "
               f"round(max(value) - min(value), 6) AS parity_gap, "
               f"round(CASE WHEN max(value) = 0 THEN NULL ELSE min(value) / max(value) END, 6) AS parity_ratio "
               f"FROM ({_RATES_SQL}) r GROUP BY segment")


@register("positive_rate_by_group", _RATES_SQL)
def q_positive_rate(spark, sf):
    return FA.positive_rate_by_group(fx.fairness_frame(spark, sf), "gender", "label", by=["segment"])


@register("parity_gap", _PARITY_SQL)
def q_parity_gap(spark, sf):
    return PL.run_parity(spark, sf)


_FAIR_SRC = f"SELECT CAST(gender AS VARCHAR) AS segment, label AS y_true, y_score FROM ({fx.FAIRNESS_FRAME_SQL}) f"
_FAIR_ALL = (f"SELECT segment, y_true, y_score FROM ({_FAIR_SRC}) a UNION ALL "
             f"SELECT '{FA.OVERALL}' AS segment, y_true, y_score FROM ({_FAIR_SRC}) b")
_FAIR_SQL = (f"SELECT segment AS \"group\", n, accuracy_at_05 AS accuracy, precision_at_05 AS precision, "
             f"recall_at_05 AS recall, f1_at_05 AS f1, auroc AS auc, "
             f"round(CAST(tp + fp AS DOUBLE) / n, 6) AS pos_rate FROM ("
             + osql.metrics_sql(_FAIR_ALL, ["segment"], ["n", "accuracy_at_05", "precision_at_05", "recall_at_05",
                                                        "f1_at_05", "auroc", "tp", "fp"]) + ") m")


@register("fairness_by_group", _FAIR_SQL)
def q_fairness_by_group(spark, sf):
    return FA.fairness_by_group(fx.fairness_frame(spark, sf), "gender", "label", "y_score")


_SLICES_SQL = (f"SELECT \"group\" AS slice, accuracy, precision, recall, f1, auc FROM ({_FAIR_SQL}) s")


@register("fairness_slices", _SLICES_SQL)
def q_fairness_slices(spark, sf):
    return FA.fairness_slices(FA.fairness_by_group(fx.fairness_frame(spark, sf), "gender", "label", "y_score"))


@register("pick_group_column", f"SELECT 'gender' AS group_column, CAST(COUNT(DISTINCT gender) AS BIGINT) AS n_groups "
                               f"FROM ({fx.FAIRNESS_FRAME_SQL}) f")
def q_pick_group_column(spark, sf):
    df = fx.fairness_frame(spark, sf)
    g = C.pick_group_column(df, None)
    return df.agg(F.lit(g).alias("group_column"), F.countDistinct(g).cast("long").alias("n_groups"))


@register("train_test_split", f"""WITH f AS ({fx.FAIRNESS_FRAME_SQL}), n AS (SELECT label, count(*) AS n FROM f GROUP BY label)
SELECT label, CAST(round(n * 0.7) AS BIGINT) AS n_train, CAST(n - round(n * 0.7) AS BIGINT) AS n_test FROM n""")
def q_train_test_split(spark, sf):
    split = FA.split_train_test(fx.fairness_frame(spark, sf), "label", seed=42)
    return split.groupBy("label").agg(F.count_if("_train").cast("long").alias("n_train"),
                                      F.count_if(~F.col("_train")).cast("long").alias("n_test"))


_TEST_ROWS_SQL = (f"SELECT CAST(sum(n) - sum(round(n * CAST(0.7 AS DOUBLE))) AS BIGINT) FROM (SELECT label, count(*) AS n FROM "
                  f"({fx.FAIRNESS_FRAME_SQL}) f WHERE label IS NOT NULL GROUP BY label) l")


@register("train_score_totals", f"SELECT ({_TEST_ROWS_SQL}) AS overall_n, ({_TEST_ROWS_SQL}) AS groups_n, "
                                f"(SELECT count(DISTINCT gender) FROM ({fx.FAIRNESS_FRAME_SQL}) f) AS n_groups, true AS in_range")
def q_train_score_totals(spark, sf):
    """What must hold of the audit whatever the model: the sizes of the scored part, and every
    measure between 0 and 1."""
    t = materialize(FA.train_score_audit(fx.fairness_frame(spark, sf).drop("y_score", "segment"), "gender", "label", seed=42))
    whole = F.col("group") == FA.OVERALL
    fair = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1", "auc", "pos_rate"):
        fair = fair & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return t.agg(F.sum(F.when(whole, F.col("n"))).alias("overall_n"), F.sum(F.when(~whole, F.col("n"))).alias("groups_n"),
                 F.count_if(~whole).alias("n_groups"), F.every(fair).alias("in_range"))


@register("train_score_audit")
def q_train_score_audit(spark, sf):
    df = fx.fairness_frame(spark, sf).drop("y_score", "segment")
    return FA.train_score_audit(df, "gender", "label", seed=42)


# ------------------------------------------------------------------ attribution (2.4, 2.6, 2.8)
_IMPACT_SQL = ("SELECT 'f' || CAST(pos AS VARCHAR) AS name, m AS mean_abs_impact, CAST(pos AS INTEGER) AS pos FROM ("
               "SELECT pos - 1 AS pos, avg(abs(CAST(v AS DOUBLE))) AS m FROM ("
               "SELECT UNNEST(embedding) AS v, UNNEST(range(1, len(embedding) + 1)) AS pos FROM embeddings) u "
               "GROUP BY pos) x")
_TOP_SQL = (f"SELECT name, round(mean_abs_impact, 6) AS mean_abs_impact, pos FROM ({_IMPACT_SQL}) i "
            f"ORDER BY mean_abs_impact DESC, pos LIMIT 25")


@register("mean_abs_impact", f"SELECT name, round(mean_abs_impact, 6) AS mean_abs_impact, pos FROM ({_IMPACT_SQL}) i")
def q_mean_abs_impact(spark, sf):
    m = A.mean_abs_impact(fx.contributions(spark, sf))
    return m.select("name", round6("mean_abs_impact").alias("mean_abs_impact"), "pos")


@register("top_features", _TOP_SQL)
def q_top_features(spark, sf):
    return PL.top_feature_table(spark, sf)


@register("top_features_named", f"SELECT name, round(mean_abs_impact, 6) AS mean_abs_impact FROM ({_IMPACT_SQL}) i "
                                f"ORDER BY mean_abs_impact DESC, name LIMIT 25")
def q_top_features_named(spark, sf):
    return A.top_features_named(A.mean_abs_impact(fx.contributions(spark, sf)))


@register("normalize_features", f"SELECT name, mean_abs_impact FROM ({_TOP_SQL}) t")
def q_normalize_features(spark, sf):
    path = _scratch(spark, "top_features")
    A.write_top_features(PL.top_feature_table(spark, sf), path)
    return A.normalize_features(spark, path).select("name", "mean_abs_impact")


@register("normalize_features_alt", f"SELECT name, mean_abs_impact FROM ({_TOP_SQL}) t")
def q_normalize_features_alt(spark, sf):
    path = _scratch(spark, "top_features_alt")
    t = PL.top_feature_table(spark, sf)
    # The alternative key names: {"top_features": [{"column": ..., "mean_abs": ...}]}
    t.agg(F.collect_list(F.struct(F.col("name").alias("column"), F.col("mean_abs_impact").alias("mean_abs")))
          .alias("top_features")).coalesce(1).write.mode("overwrite").json(path)
    return A.normalize_features_alt(spark, path).select("name", "mean_abs_impact")


# ------------------------------------------------------------------ gates (2.3, 2.8)
_PERF_RUN_SQL = (f"SELECT segment AS run_id, * EXCLUDE (segment) FROM "
                 f"({osql.metrics_sql(fx.PREDICTIONS_UNIQUE_SQL, ['segment'])}) p")
_DMAX_SQL = osql.drift_sql(_B_SQL, _C_SQL, fx.DRIFT_LINEITEM_COLS, "max")
_OBS_SQL = (f"WITH perf AS ({_PERF_RUN_SQL}), dm AS (SELECT * FROM ({_DMAX_SQL}) d), par AS ({_PARITY_SQL}), "
            f"topf AS (SELECT COUNT(*) AS n FROM ({_IMPACT_SQL}) t) "
            f"SELECT perf.run_id, dm.max_psi, dm.max_ks, perf.auroc, perf.auprc, perf.log_loss, perf.ks_stat, perf.n, "
            f"perf.accuracy_at_05, par.parity_gap, par.n_groups AS n_fairness_slices, topf.n > 0 AS shap_artifact_present, "
            f"CAST(topf.n AS BIGINT) AS top_features_detected "
            f"FROM perf CROSS JOIN dm CROSS JOIN topf LEFT JOIN par ON perf.run_id = par.run_id")


@register("observed_metrics", _OBS_SQL)
def q_observed_metrics(spark, sf):
    return PL.observed_metrics(spark, sf)


def _checks_sql(obs_sql: str) -> str:
    parts = []
    for name, metric, op, thr in G.check_specs(G.DEFAULT_POLICY):
        v = f"CAST({metric} AS DOUBLE)"
        sop = "=" if op == "==" else op
        parts.append(f"SELECT run_id, '{name}' AS name, {v} AS value, '{op}' AS op, CAST({thr} AS DOUBLE) AS threshold, "
                     f"CASE WHEN {v} IS NULL THEN 'SKIP' WHEN {v} {sop} {thr} THEN 'PASS' ELSE 'FAIL' END AS result "
                     f"FROM obs")
    return (f"WITH obs AS ({obs_sql}), c AS ({' UNION ALL '.join(parts)}), "
            f"st AS (SELECT run_id, CASE WHEN SUM(CASE WHEN result = 'FAIL' THEN 1 ELSE 0 END) > 0 THEN 'FAIL' "
            f"ELSE 'PASS' END AS status FROM c GROUP BY run_id) "
            f"SELECT c.run_id, st.status, name, value, op, threshold, result FROM c JOIN st ON c.run_id = st.run_id")


_CHECKS_SQL = _checks_sql(_OBS_SQL)


@register("gate_checks", _CHECKS_SQL)
def q_gate_checks(spark, sf):
    return G.gate_checks(PL.observed_metrics(spark, sf))


@register("join_policy", f"WITH ch AS ({_CHECKS_SQL}) SELECT run_id, name AS \"check\", value, threshold FROM ch")
def q_join_policy(spark, sf):
    obs = PL.observed_metrics(spark, sf)
    long = obs.select("run_id", *[F.col(c).cast("double") for c in G.OBSERVED_COLUMNS]).unpivot(
        ["run_id"], G.OBSERVED_COLUMNS, "metric", "value")
    pol = G.policy_table(spark)          # a handful of rows from the configuration
    return long.join(F.broadcast(pol), "metric").select("run_id", "check", "value", "threshold")


_BASIC_GATE_SQL = (f"SELECT run_id, CASE WHEN auroc IS NULL OR auroc < 0.7 OR (ks_stat IS NOT NULL AND ks_stat < 0.1) "
                   f"THEN 'FAIL' ELSE 'PASS' END AS status, CAST(0.7 AS DOUBLE) AS min_auroc, CAST(0.1 AS DOUBLE) AS min_ks, "
                   f"list_filter([CASE WHEN auroc IS NULL OR auroc < 0.7 THEN 'auroc<0.7' END, "
                   f"CASE WHEN ks_stat IS NOT NULL AND ks_stat < 0.1 THEN 'ks<0.1' END], lambda x: x IS NOT NULL) AS reasons, "
                   f"ks_stat AS max_ks FROM ({_PERF_RUN_SQL}) p")


@register("gate_basic", _BASIC_GATE_SQL)
def q_gate_basic(spark, sf):
    return G.gate_basic(PL.run_performance(spark, sf))


@register("gate_required",
          f"SELECT run_id, CASE WHEN len(r) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, r AS reasons FROM ("
          f"SELECT run_id, list_filter(["
          f"CASE WHEN auroc IS NULL THEN 'AUROC missing' WHEN auroc < 0.7 THEN 'AUROC ' || CAST(auroc AS VARCHAR) || ' < min_auroc 0.7' END, "
          f"CASE WHEN ks_stat IS NULL THEN 'KS missing' WHEN ks_stat < 0.1 THEN 'KS ' || CAST(ks_stat AS VARCHAR) || ' < min_ks 0.1' END"
          f"], lambda x: x IS NOT NULL) AS r FROM ({_PERF_RUN_SQL}) p) q")
def q_gate_required(spark, sf):
    return G.gate_required(PL.run_performance(spark, sf))


@register("gate_fallback", f"SELECT run_id, CASE WHEN coalesce(auroc, 0) >= 0.7 AND coalesce(ks_stat, 0) >= 0.1 "
                           f"THEN 'PASS' ELSE 'FAIL' END AS status, ks_stat AS max_ks FROM ({_PERF_RUN_SQL}) p")
def q_gate_fallback(spark, sf):
    return G.gate_fallback(PL.run_performance(spark, sf))


@register("gate_status_normalize", f"SELECT run_id, CASE WHEN lower(status) IN ('pass', 'passed', 'success') "
                                   f"THEN 'pass' ELSE 'fail' END AS gate FROM ({_BASIC_GATE_SQL}) g")
def q_gate_status_normalize(spark, sf):
    g = G.gate_basic(PL.run_performance(spark, sf))
    return g.select("run_id", G.gate_status_normalize(g).alias("gate"))


@register("live_validation",
          f"SELECT p.run_id, g.status, p.n, p.accuracy_at_05, p.auroc, p.ks_stat, "
          f"CASE WHEN g.status = 'PASS' THEN 'pass' ELSE 'fail' END AS gate_status, g.min_auroc, g.min_ks, g.reasons AS gate_reasons "
          f"FROM ({_PERF_RUN_SQL}) p LEFT JOIN ({_BASIC_GATE_SQL}) g ON p.run_id = g.run_id")
def q_live_validation(spark, sf):
    perf = PL.run_performance(spark, sf)
    lv = G.live_validation(perf, G.gate_basic(perf))
    return lv.select("run_id", "status", "performance.*", F.col("gate.status").alias("gate_status"), "gate.policy.*",
                     F.col("gate.reasons").alias("gate_reasons"))


def _audit_sql(kind: str) -> str:
    rules = {
        "performance": ["CASE WHEN auroc IS NOT NULL AND auroc < 0.75 THEN printf('AUROC %.3f < min_auroc %.3f', auroc, 0.75) END",
                        "CASE WHEN auprc IS NOT NULL AND auprc < 0.2 THEN printf('AUPRC %.3f < min_auprc %.3f', auprc, 0.2) END"],
        "drift": ["CASE WHEN max_psi IS NOT NULL AND max_psi > 0.2 THEN printf('PSI %.3f > psi_fail %.3f', max_psi, 0.2) END",
                  "CASE WHEN max_ks IS NOT NULL AND max_ks > 0.2 THEN printf('KS %.3f > ks_fail %.3f', max_ks, 0.2) END"],
        "fairness": ["CASE WHEN parity_gap IS NOT NULL AND abs(parity_gap) > 0.05 THEN printf('parity_gap %.3f exceeds %.3f', parity_gap, 0.05) END"],
        "explainability": ["CASE WHEN NOT coalesce(shap_artifact_present, false) THEN 'SHAP artifact required but missing' END",
                           "CASE WHEN top_features_detected < 2 THEN 'top_features_count ' || CAST(top_features_detected AS VARCHAR) || ' < required 2' END"],
    }[kind]
    return (f"SELECT run_id, list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL) AS violations FROM ({_OBS_SQL}) o")


_AUDIT_SECTIONS = {"performance": "performance", "drift": "drift", "fairness": "fairness",
                   "explainability": "explainability"}


def _audit_obs(spark, sf):
    o = PL.observed_metrics(spark, sf)
    return o.select("run_id", "auroc", "auprc", F.col("max_psi").alias("psi"), F.col("max_ks").alias("ks"),
                    "parity_gap", "shap_artifact_present", F.col("top_features_detected").alias("top_features_count"))


def _audit_q(kind):
    def q(spark, sf):
        pol = {kind: G.DEFAULT_POLICY[kind]}
        return G.audit_violations(_audit_obs(spark, sf), pol)
    return q


for _k, _name in (("performance", "audit_performance"), ("drift", "audit_drift"),
                  ("fairness", "audit_fairness_gap"), ("explainability", "audit_explainability")):
    register(_name, _audit_sql(_k))(_audit_q(_k))

_ALL_VIOL_SQL = (f"SELECT a.run_id, list_concat(list_concat(a.violations, b.violations), list_concat(c.violations, d.violations)) "
                 f"AS violations FROM ({_audit_sql('performance')}) a JOIN ({_audit_sql('drift')}) b USING (run_id) "
                 f"JOIN ({_audit_sql('fairness')}) c USING (run_id) JOIN ({_audit_sql('explainability')}) d USING (run_id)")


@register("audit_result", f"SELECT run_id, CASE WHEN len(violations) = 0 THEN 'PASS' ELSE 'SOFT-FAIL' END AS result, "
                          f"CAST(len(violations) AS INTEGER) AS n_violations, violations FROM ({_ALL_VIOL_SQL}) v")
def q_audit_result(spark, sf):
    return G.audit_result(G.audit_violations(_audit_obs(spark, sf)))


_YEAR_PERF_SQL = osql.metrics_sql("SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(l_returnflag = 'R' AS INTEGER) AS y_true, "
                                  "l_extendedprice / 105000.0 AS y_score FROM lineitem", ["yr"], ["n", "auroc", "auprc", "ks_stat"])


def _year_performance(spark, sf):
    """Metrics of a run per ship year."""
    preds = fx.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("yr"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
                                                   (F.col("l_extendedprice") / 105000.0).alias("y_score"))
    return M.performance_metrics(preds, by=["yr"]).select("yr", "n", "auroc", "auprc", "ks_stat")


@register("audit_roster", f"""
WITH perf AS ({_YEAR_PERF_SQL}), live AS (SELECT * FROM perf WHERE yr % 4 <> 3), gate AS (SELECT yr FROM perf WHERE yr % 3 <> 0),
roster AS (SELECT DISTINCT year(o_orderdate) AS yr FROM orders WHERE year(o_orderdate) <> 1994 UNION SELECT 2001),
runs AS (SELECT yr FROM roster UNION SELECT yr FROM live UNION SELECT yr FROM gate),
a AS (SELECT yr, yr IN (SELECT yr FROM roster) AS expected, yr IN (SELECT yr FROM live) AS live, yr IN (SELECT yr FROM gate) AS gate FROM runs),
v AS (SELECT yr, list_filter([CASE WHEN auroc < 0.75 THEN printf('AUROC %.3f < min_auroc %.3f', auroc, 0.75) END,
                              CASE WHEN auprc < 0.2 THEN printf('AUPRC %.3f < min_auprc %.3f', auprc, 0.2) END], lambda x: x IS NOT NULL) AS violations FROM live),
r AS (SELECT a.yr, expected, live, gate, violations, CAST(NOT live AS INTEGER) * 2 + CAST(NOT gate AS INTEGER) AS risk FROM a LEFT JOIN v ON a.yr = v.yr)
SELECT CAST(yr AS INTEGER) AS yr, expected, live AS found, CASE WHEN NOT live THEN 'SKIPPED' WHEN len(violations) = 0 THEN 'PASS' ELSE 'SOFT-FAIL' END AS result,
       CAST(coalesce(len(violations), 0) AS INTEGER) AS n_violations, violations, list_filter([CASE WHEN NOT live THEN 'live' END, CASE WHEN NOT gate THEN 'gate' END],
       lambda x: x IS NOT NULL) AS missing, CAST(risk AS INTEGER) AS risk_score, CASE WHEN risk <= 1 THEN 'LOW' WHEN risk = 2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM r""")
def q_audit_roster(spark, sf):
    """Expected: the order years but one, and one to come. Found: the ship years; some lack
    their live record, some the gate's."""
    perf = write_scratch(_year_performance(spark, sf), "runs")
    years = fx.table(spark, sf, "orders").select(F.year("o_orderdate").alias("yr")).where("yr <> 1994").distinct()
    roster = years.union(spark.range(2001, 2002).select(F.col("id").cast("int")))
    live = perf.where("yr % 4 <> 3")
    violations = G.audit_violations(live, {"performance": G.DEFAULT_POLICY["performance"]}, run_cols=["yr"])
    return G.audit_roster(roster, {"live": live, "gate": perf.where("yr % 3 <> 0")}, violations, run_cols=["yr"])


_REGISTRY = {"registry_version": 1, "policies": [
    {"id": "default", "file": "policy-2.json", "version": "1.1.0", "owner": "monitoring", "last_review": "1996-03-01", "notes": "in force", "schema_version": 1, "active": True},
    {"id": "other", "file": "policy-2.json", "version": "0.1.0", "last_review": "1990-01-01", "active": False}],
    "history": [{"id": "default", "version": "1.0.0", "file": "policy-1.json", "owner": "monitoring", "last_review": "1994-07-15"},
                {"id": "default", "version": "0.9.0", "last_review": "1993-01-01", "notes": "no thresholds kept"}]}
_MONTHS_SQL = "SELECT strftime(ts, '%Y-%m') AS run_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts FROM (SELECT DISTINCT date_trunc('month', l_shipdate) AS ts FROM lineitem) m"
_MONTH_PERF_SQL = osql.metrics_sql("SELECT strftime(l_shipdate, '%Y-%m') AS run_id, CAST(l_returnflag = 'R' AS INTEGER) AS y_true, "
                                   "l_extendedprice / 105000.0 AS y_score FROM lineitem", ["run_id"], ["auroc", "auprc"])


def _versions_sql() -> str:
    checks = []
    for file, policy in (("policy-1.json", {"performance": {"min_auroc": 0.49, "min_auprc": 0.1}}), ("policy-2.json", G.DEFAULT_POLICY)):
        checks += [f"('{file}', '{c}', '{m}', '{op}', {t}::DOUBLE)" for c, m, op, t in G.check_specs(policy)]
    return f"""
WITH v(version, owner, file, lo, hi) AS (VALUES ('0.9.0', NULL, NULL, DATE '0001-01-01', DATE '1994-07-15'),
  ('1.0.0', 'monitoring', 'policy-1.json', DATE '1994-07-15', DATE '1996-03-01'), ('1.1.0', 'monitoring', 'policy-2.json', DATE '1996-03-01', DATE '9999-01-01')),
c(file, "check", metric, op, threshold) AS (VALUES {', '.join(checks)}),
o AS (SELECT m.run_id, m.ts, p.auroc, p.auprc FROM ({_MONTHS_SQL}) m JOIN ({_MONTH_PERF_SQL}) p ON m.run_id = p.run_id),
j AS (SELECT run_id, version, owner, "check", op, threshold, CASE metric WHEN 'auroc' THEN auroc WHEN 'auprc' THEN auprc
      WHEN 'shap_artifact_present' THEN 0.0 END AS value FROM o JOIN v ON CAST(ts AS DATE) >= lo AND CAST(ts AS DATE) < hi LEFT JOIN c ON v.file = c.file)
SELECT run_id, 'default' AS policy_id, version, owner, "check", value, op, threshold,
       CASE WHEN value IS NULL OR threshold IS NULL THEN 'SKIP' WHEN (CASE op WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold
            WHEN '>=' THEN value >= threshold ELSE value = threshold END) THEN 'PASS' ELSE 'FAIL' END AS result FROM j"""


@register("policy_versions", _versions_sql())
def q_policy_versions(spark, sf):
    """A run per ship month, judged by the registry's version in force in that month."""
    import json
    path = _scratch(spark, "policies")
    for name, doc in (("registry", _REGISTRY), ("policy-1", {"performance": {"min_auroc": 0.49, "min_auprc": 0.1}}), ("policy-2", G.DEFAULT_POLICY)):
        EV.put_text(spark, f"{path}/{name}.json", json.dumps(doc))
    li = fx.table(spark, sf, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM").alias("run_id")
    perf = M.performance_metrics(li.select(month, (F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_extendedprice") / 105000.0).alias("y_score")),
                                 by=["run_id"]).select("run_id", "auroc", "auprc")
    runs = perf.withColumn("ts", F.to_timestamp(F.concat("run_id", F.lit("-01")))).withColumn("policy_id", F.lit("default"))
    versions = RV.policy_versions(RV.registry_entries(spark, f"{path}/registry.json"))
    return RV.judge_runs(runs, versions, RV.policy_checks(spark, f"{path}/policy-*.json"))


@register("threshold_table",
          f"SELECT run_id, metric, actual, threshold, status FROM ("
          f"SELECT run_id, 'AUROC' AS metric, auroc AS actual, CAST(0.7 AS DOUBLE) AS threshold, "
          f"CASE WHEN auroc IS NULL THEN '—' WHEN auroc < 0.7 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({_OBS_SQL}) a "
          f"UNION ALL SELECT run_id, 'KS Statistic', ks_stat, CAST(0.1 AS DOUBLE), "
          f"CASE WHEN ks_stat IS NULL THEN '—' WHEN ks_stat < 0.1 THEN 'FAIL' ELSE 'PASS' END FROM ({_OBS_SQL}) b "
          f"UNION ALL SELECT run_id, 'Max PSI', max_psi, CAST(0.2 AS DOUBLE), "
          f"CASE WHEN max_psi IS NULL THEN '—' WHEN max_psi > 0.2 THEN 'FAIL' WHEN max_psi > 0.1 THEN 'WARN' "
          f"ELSE 'PASS' END FROM ({_OBS_SQL}) c) t")
def q_threshold_table(spark, sf):
    return G.threshold_table(PL.observed_metrics(spark, sf))


_RISK_SQL = (f"WITH ch AS ({_CHECKS_SQL}), st AS (SELECT DISTINCT run_id, status FROM ch), o AS ({_OBS_SQL}), "
             f"r AS (SELECT o.run_id, upper(coalesce(st.status, '')) AS policy_gate, "
             f"(o.auroc IS NOT NULL AND o.ks_stat IS NOT NULL) AS performance_present, "
             f"coalesce(o.n_fairness_slices > 0, false) AS fairness_present, "
             f"coalesce(o.top_features_detected > 0, false) AS explainability_present FROM o LEFT JOIN st ON o.run_id = st.run_id), "
             f"s AS (SELECT *, (CASE WHEN policy_gate <> 'PASS' THEN 2 ELSE 0 END) + (CASE WHEN performance_present THEN 0 ELSE 1 END) "
             f"+ (CASE WHEN fairness_present THEN 0 ELSE 1 END) + (CASE WHEN explainability_present THEN 0 ELSE 1 END) AS risk_score FROM r) "
             f"SELECT *, CASE WHEN risk_score <= 1 THEN 'LOW' WHEN risk_score = 2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM s")


@register("risk_score", _RISK_SQL)
def q_risk_score(spark, sf):
    obs = PL.observed_metrics(spark, sf)
    st = G.gate_status(G.gate_checks(obs)).withColumnRenamed("status", "gate_status")
    runs = obs.join(st, "run_id", "left").withColumnRenamed("top_features_detected", "n_top_features")
    return G.risk_score(runs)


@register("policy_registry",
          f"WITH ch AS ({_CHECKS_SQL}) SELECT 'default' AS policy_id, '1.0.0' AS version, true AS active, "
          f"run_id, name AS \"check\", threshold, result FROM ch")
def q_policy_registry(spark, sf):
    registry = {"policies": [{"id": "default", "file": "policy.yaml", "version": "1.0.0", "active": True}]}
    reg = G.policy_registry(spark, registry, {"policy.yaml": G.DEFAULT_POLICY})
    checks = G.gate_checks(PL.observed_metrics(spark, sf))
    return F.broadcast(reg).join(checks, reg["check"] == checks["name"]).select(
        "policy_id", "version", "active", "run_id", F.col("check"), reg["threshold"], "result")


# ------------------------------------------------------------------ history (2.4, 2.5, 2.7)
_HIST_LAST_SQL = ("SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) "
                  "AS INTEGER) AS recency FROM ({src}) h) x WHERE recency <= {n}")


def _hist(spark, sf):
    return fx.history_records(spark, sf)


@register("history_last_n", _HIST_LAST_SQL.format(src=fx.HISTORY_SQL, n=H.HISTORY_KEEP))
def q_history_last_n(spark, sf):
    return H.history_last_n(_hist(spark, sf), H.HISTORY_KEEP, tiebreak="event_id")


@register("history_show", _HIST_LAST_SQL.format(src=fx.HISTORY_SQL, n=H.HISTORY_SHOW))
def q_history_show(spark, sf):
    return H.history_last_n(_hist(spark, sf), H.HISTORY_SHOW, tiebreak="event_id")


_FAILS_SQL = (f"SELECT model, CAST(COUNT(*) AS BIGINT) AS n_recent, "
              f"CAST(SUM(CASE WHEN upper(status) = 'FAIL' THEN 1 ELSE 0 END) AS BIGINT) AS n_fail FROM ("
              f"{_HIST_LAST_SQL.format(src=fx.HISTORY_SQL, n=H.FAIL_WINDOW)}) l GROUP BY model")


@register("fail_count_recent", _FAILS_SQL)
def q_fail_count_recent(spark, sf):
    return H.fail_count_recent(_hist(spark, sf), H.FAIL_WINDOW, tiebreak="event_id")


@register("append_history", _HIST_LAST_SQL.format(src=fx.HISTORY_SQL, n=H.HISTORY_KEEP))
def q_append_history(spark, sf):
    """Two appends (from the 16th, then all: the first ones arrive again) to a history table;
    the table as it is stored, with each record's place."""
    path = _scratch(spark, "history")
    recs = _hist(spark, sf)
    cut = F.col("ts") >= F.lit(fx.EVENTS_SPLIT_TS).cast("timestamp_ntz")
    H.append_history(recs.where(cut), path, key=["event_id"])
    H.append_history(recs, path, key=["event_id"])
    newest = Window.partitionBy("model").orderBy(F.desc("ts"), F.desc("event_id"))
    return H.read_history(spark, path).withColumn("recency", F.row_number().over(newest))


_GATE_RUN_SQL = f"SELECT DISTINCT run_id, status FROM ({_CHECKS_SQL}) c"
_TOP_NAMES_SQL = (f"SELECT list(name ORDER BY mean_abs_impact DESC, name) AS top_features FROM ("
                  f"SELECT * FROM ({_TOP_SQL}) t ORDER BY mean_abs_impact DESC, name LIMIT 25) t2")


@register("trust_audit_summary",
          f"SELECT p.run_id, CAST(coalesce(p.n, 0) AS BIGINT) AS entries_evaluated, "
          f"(SELECT CAST(coalesce(SUM(n_fail), 0) AS BIGINT) FROM ({_FAILS_SQL}) f) AS drift_flags, "
          f"round(coalesce(p.ks_stat, 0.0), 6) AS max_ks, upper(coalesce(g.status, 'FAIL')) AS policy_status, "
          f"(SELECT top_features FROM ({_TOP_NAMES_SQL}) tn) AS top_features "
          f"FROM ({_PERF_RUN_SQL}) p LEFT JOIN ({_GATE_RUN_SQL}) g ON p.run_id = g.run_id")
def q_trust_audit_summary(spark, sf):
    perf = PL.run_performance(spark, sf)
    gate = G.gate_status(G.gate_checks(PL.observed_metrics(spark, sf)))
    fails = H.fail_count_recent(_hist(spark, sf), H.FAIL_WINDOW, tiebreak="event_id")
    return H.trust_audit_summary(perf, gate, fails, PL.top_feature_table(spark, sf))


# ------------------------------------------------------------------ evidence (2.8): rows-only checks
from modelwatch.operators import evidence as EV  # noqa: E402
from modelwatch.sources import files as S  # noqa: E402


_FILES_SQL = ("SELECT source, doc_id // 500 AS part, encode(string_agg(text || chr(10), '' ORDER BY doc_id)) AS content "
              "FROM documents GROUP BY ALL")


def _text_files(spark, sf) -> str:
    """The documents' texts as files, one per source and 500 ids; the folder."""
    root = _scratch(spark, "texts")
    docs = fx.table(spark, sf, "documents").select("source", F.expr("doc_id div 500").alias("part"), "doc_id", "text")
    (docs.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").drop("doc_id")
     .write.partitionBy("source", "part").text(root))
    return root


def _file_place(path) -> list:
    return [F.regexp_extract(path, "source=([^/]*)", 1).alias("source"), F.regexp_extract(path, "part=([^/]*)", 1).cast("long").alias("part")]


@register("file_digest", f"SELECT source, part, CAST(octet_length(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256 FROM ({_FILES_SQL}) f")
def q_file_digest(spark, sf):
    """Size and SHA-256 of every file written, read by byte ranges."""
    found = EV.file_digest(spark, [_text_files(spark, sf)])
    return found.where("name not like '.%' and name not like '\\_%'").select(*_file_place(F.col("path")), "size_bytes", "sha256")


@register("tree_digest", f"""
WITH RECURSIVE f AS ({_FILES_SQL}), t AS (
  SELECT source, part, 0 AS lvl, i, CAST(ceil(octet_length(content) / 4096.0) AS BIGINT) AS n, sha256(unhex(substr(hex(content), 8192 * i + 1, 8192))) AS d
  FROM (SELECT *, unnest(range(0, CAST(ceil(octet_length(content) / 4096.0) AS BIGINT))) AS i FROM f) b
  UNION ALL
  SELECT source, part, lvl + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, part, lvl, i // 8)
SELECT source, part, CAST(octet_length(content) AS BIGINT) AS size_bytes, CAST(ceil(octet_length(content) / 4096.0) AS BIGINT) AS n_blocks, d AS tree_sha256
FROM t JOIN f USING (source, part) WHERE t.n = 1""")
def q_tree_digest(spark, sf):
    """Hash trees over blocks of 4,096 bytes, eight digests a node."""
    found = EV.tree_digest(spark, [_text_files(spark, sf)], block_bytes=4096, fan=8, partition_bytes=1 << 20)
    own = F.element_at(F.split("path", "/"), -1)
    return found.where(~own.like(".%") & ~own.startswith("_")).select(*_file_place(F.col("path")), "size_bytes", "n_blocks", "tree_sha256")


_LI_CELLS = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in ST.LINEITEM_ALL)


@register("table_fingerprint", f"SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST(SUM(CAST('0x' || substr(sha256("
                               f"concat_ws(chr(31), {_LI_CELLS})), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM lineitem")
def q_table_fingerprint(spark, sf):
    return EV.table_fingerprint(fx.table(spark, sf, "lineitem"), ST.LINEITEM_ALL)


_YEAR_PRINT_SQL = (f"SELECT year(l_shipdate) AS yr, CAST(COUNT(*) AS BIGINT) AS rows, CAST(SUM(CAST('0x' || substr(sha256("
                   f"concat_ws(chr(31), {_LI_CELLS})), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM lineitem "
                   f"WHERE year(l_shipdate) <> 1995 GROUP BY ALL")


@register("file_state", f"SELECT CASE WHEN yr = 1997 THEN 'added' WHEN yr = 1996 THEN 'changed' END AS change, yr, rows, fingerprint "
                        f"FROM ({_YEAR_PRINT_SQL}) y UNION ALL SELECT 'removed', 1995, 0, NULL")
def q_file_state(spark, sf):
    """A table of one folder a ship year gets a folder more, one written anew with other rows
    and one less; its state is brought up to date and compared with the one before."""
    li, path = fx.table(spark, sf, "lineitem").select(*ST.LINEITEM_ALL, F.year("l_shipdate").alias("yr")), _scratch(spark, "lineitem")
    first = li.where("yr <> 1997 and not (yr = 1996 and l_linenumber > 1)")
    # Partitions of a size, not of a year each: a task sorts what it writes.
    first.hint("rebalance", "yr").write.partitionBy("yr").parquet(path)
    before = write_scratch(EV.file_state(spark, path, cols=ST.LINEITEM_ALL), "state")
    (li.where("yr in (1996, 1997)").hint("rebalance", "yr").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("yr").parquet(path))
    EV.remove(spark, f"{path}/yr=1995")
    after = EV.file_state(spark, path, known=before, cols=ST.LINEITEM_ALL)
    yr = F.regexp_extract("file", "yr=([0-9]*)", 1).cast("long").alias("yr")
    moved = EV.compare_states(before, after).select(yr, "change").groupBy("yr").agg(
        F.when(F.count_distinct("change") == 2, "changed").otherwise(F.max("change")).alias("change"))     # a folder written anew has a new file name
    return EV.state_of(after, yr).join(moved, "yr", "full").select("change", "yr", F.coalesce("rows", F.lit(0)).alias("rows"), "fingerprint")


_DIGEST_SQL = ("SELECT 'doc-' || doc_id AS name, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 "
               "FROM documents")


def _digest(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return EV.content_digest(docs.select(F.concat(F.lit("doc-"), "doc_id").alias("name"), "text"), "text")


@register("content_digest", _DIGEST_SQL)
def q_content_digest(spark, sf):
    return _digest(spark, sf)


@register("checklist_join", f"WITH e AS (SELECT 'doc-' || doc_id AS name FROM labels UNION ALL SELECT 'item-' || item_id FROM benchmark) "
                            f"SELECT e.name, coalesce(f.there, false) AS present, f.size_bytes, f.sha256 FROM e "
                            f"LEFT JOIN (SELECT *, true AS there FROM ({_DIGEST_SQL}) d) f ON e.name = f.name")
def q_checklist_join(spark, sf):
    """Expected names: every labelled document and every benchmark item; found: the documents."""
    expected = fx.table(spark, sf, "labels").select(F.concat(F.lit("doc-"), "doc_id").alias("name")).union(
        fx.table(spark, sf, "benchmark").select(F.concat(F.lit("item-"), "item_id")))
    return EV.checklist_join(expected, _digest(spark, sf))


# ------------------------------------------------------------------ sources and sinks (2.1)
_ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                  "o_orderdate timestamp_ntz, o_orderpriority string")


@register("scan_csv_any", "SELECT * FROM orders")
def q_scan_csv_any(spark, sf):
    base = _scratch(spark, "orders") + "/orders.csv"
    fx.table(spark, sf, "orders").write.option("header", True).option("compression", "gzip").csv(base + ".gz")
    return S.scan_csv_any(spark, base, schema=_ORDERS_SCHEMA)


@register("scan_typed_csv", f"SELECT * FROM ({fx.ADMISSIONS_SQL}) a")
def q_scan_typed_csv(spark, sf):
    path = _scratch(spark, "admissions")
    fx.admissions(spark, sf).drop("dischtime").write.option("header", True).csv(path)
    return S.scan_typed_csv(spark, path, schema="subject_id bigint, hadm_id bigint, admittime string, "
                                                "admission_type string")


@register("scan_predictions", f"SELECT y_true, y_score FROM ({fx.PREDICTIONS_UNIQUE_SQL}) p")
def q_scan_predictions(spark, sf):
    path = _scratch(spark, "predictions")
    p = fx.predictions_unique(spark, sf)
    # Header written with a byte-order mark on the first name, as spreadsheet exports do.
    p.select(F.col("y_true").alias(S.BOM + "y_true"), F.col("y_score").alias("y_pred_prob")) \
     .write.option("header", True).csv(path)
    return S.scan_predictions(spark, path)


_METRICS_LONG_SQL = (f"SELECT run_id, metric, value FROM (SELECT run_id, CAST(n AS DOUBLE) AS n, auroc, auprc, ks_stat, "
                     f"log_loss FROM ({_PERF_RUN_SQL}) p) UNPIVOT (value FOR metric IN (n, auroc, auprc, ks_stat, log_loss))")


def _perf_small(spark, sf):
    return PL.run_performance(spark, sf).select("run_id", "n", "auroc", "auprc", "ks_stat", "log_loss")


@register("sink_metrics_long", _METRICS_LONG_SQL)
def q_sink_metrics_long(spark, sf):
    long = M.metrics_long(_perf_small(spark, sf), run_col="run_id")
    pq, _ = S.sink_metrics_long(long, _scratch(spark, "metrics"))
    return spark.read.parquet(pq)


@register("scan_json_report", f"SELECT run_id, auroc, ks_stat FROM ({_PERF_RUN_SQL}) p")
def q_scan_json_report(spark, sf):
    path = _scratch(spark, "reports")
    PL.run_performance(spark, sf).write.option("maxRecordsPerFile", 1).json(path)
    r = S.scan_json_report(spark, path, "run_id string, auroc double, ks_stat double")
    return r.where(F.col("_corrupt").isNull()).select("run_id", "auroc", "ks_stat")


@register("sink_table", f"SELECT * FROM ({_PERF_RUN_SQL}) p")
def q_sink_table(spark, sf):
    path = S.sink_table(PL.run_performance(spark, sf), _scratch(spark, "table"))
    return spark.read.parquet(path)


_STAT_ITEMS = ["count", "mean", "std", "min", "p50", "max", "missing"]


def _manifest_sql() -> str:
    def stats(split, when, sql):
        items = ", ".join(f"('{c}', CAST(\"{c}\" AS DOUBLE))" for c in _STAT_ITEMS)
        return (f"SELECT 'stats' AS part, '{split} {when} ' || feature AS name, item, value FROM ({sql}) s_, "
                f"LATERAL (VALUES {items}) v(item, value)")
    sides = {"baseline": _PB_SQL, "current": _PC_SQL}
    parts = [f"SELECT 'scaler' AS part, feature AS name, item, value FROM ({_SCALER_SQL}) s_, LATERAL (VALUES ('center', center), ('scale', scale)) v(item, value)"]
    for side, src in sides.items():
        parts.append(stats(side, "pre", f"WITH b AS ({src}) {osql.profile_sql('b', PREP_NUM)}"))
        parts.append(stats(side, "post", osql.prep_sql(_PB_SQL, _PC_SQL, PREP_NUM, PREP_OTHER, side=side, what="profile")))
        parts.append(f"SELECT 'outputs', 'data_prepared_{side}', 'rows', CAST(count(*) AS DOUBLE) FROM "
                     f"({osql.prep_sql(_PB_SQL, _PC_SQL, PREP_NUM, PREP_OTHER, side=side)}) o_")
        parts.append(f"SELECT 'files', 'data_prepared_{side}', 'matching', 1.0")
    return " UNION ALL ".join(f"({x})" for x in parts)


@register("sink_prep_manifest", _manifest_sql())
def q_sink_prep_manifest(spark, sf):
    """Prepare the pair, write both tables and the manifest, and read all its parts back:
    scaler, profiles, rows of the outputs, and whether the files listed are the files there."""
    from dataclasses import asdict
    b, c = _prep_pair(spark, sf)
    cfg = P.PrepConfig()
    bp, cp, scaler, bi, ci = P.prepare_pair(b, c, cfg)
    path = _scratch(spark, "manifest")
    written = {f"data_prepared_{side}": S.sink_table(df, f"{path}/{side}") for side, df in (("baseline", bp), ("current", cp))}
    outputs = {name: spark.read.parquet(at) for name, at in written.items()}
    S.sink_prep_manifest(spark, path, asdict(cfg), scaler.to_dataframe(spark), outputs,
                         {(side, when): i[f"{when}_stats"]() for side, i in (("baseline", bi), ("current", ci)) for when in ("pre", "post")},
                         inputs={"lineitem": f"{sf}/lineitem.parquet"}, output_paths=written, provenance={"query": "sink_prep_manifest"})
    t = spark.read.schema("feature string, kind string, center double, scale double, extra double").json(f"{path}/scaler")
    out = t.select(F.lit("scaler").alias("part"), F.col("feature").alias("name"), round6("center").alias("center"), round6("scale").alias("scale")) \
           .unpivot(["part", "name"], ["center", "scale"], "item", "value")
    stats = spark.read.schema("split string, when string, " + P.PROFILE_SCHEMA.split(", ", 1)[1]).json(f"{path}/stats")
    out = out.unionByName(stats.select(F.lit("stats").alias("part"), F.concat_ws(" ", "split", "when", "feature").alias("name"),
                                       *[F.col(c).cast("double").alias(c) for c in _STAT_ITEMS]).unpivot(["part", "name"], _STAT_ITEMS, "item", "value"))
    rows = spark.read.schema("name string, rows long, fingerprint string").json(f"{path}/outputs")
    out = out.unionByName(rows.select(F.lit("outputs").alias("part"), "name", F.lit("rows").alias("item"), F.col("rows").cast("double").alias("value")))
    listed = spark.read.schema("role string, name string, file string, size_bytes long, sha256 string").json(f"{path}/files").where("role = 'output'")
    for name, at in written.items():
        there = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(at).select(
            F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size_bytes"))
        own = listed.where(F.col("name") == name).select("file", "size_bytes", "sha256")
        j = own.join(there.withColumn("there", F.lit(True)), ["file", "size_bytes"], "full")
        same = F.every(F.col("there").isNotNull() & (F.length("sha256") == 64)).cast("double")
        out = out.unionByName(j.agg(same.alias("value")).select(F.lit("files").alias("part"), F.lit(name).alias("name"), F.lit("matching").alias("item"), "value"))
    return out


@register("sink_run_log", _METRICS_LONG_SQL)
def q_sink_run_log(spark, sf):
    """Some metrics first, then all, twice: a run that is logged again replaces itself."""
    root = _scratch(spark, "runlog")
    long = write_scratch(M.metrics_long(_perf_small(spark, sf), run_col="run_id"), "metrics")
    S.sink_run_log(long.where("metric = 'auroc'").withColumn("value", F.lit(-1.0)), root, "metrics")
    for _ in range(2):
        out = S.sink_run_log(long, root, "metrics")
    return spark.read.parquet(out).select("run_id", "metric", "value")


_PARTS_SQL = ("SELECT 'run-' || s_nationkey AS run_id, 'metrics' AS kind, 'price-' || l_linenumber AS name, CAST(1700000000 + l_linenumber AS BIGINT) AS ts, "
              "max(l_extendedprice) AS value, CAST(NULL AS VARCHAR) AS text, CAST(year(l_shipdate) AS BIGINT) AS step "
              "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL "
              "UNION ALL SELECT 'run-' || s_nationkey, kind, 'supplier', NULL, NULL, max(s_name), NULL FROM supplier, (VALUES ('params'), ('tags')) k(kind) GROUP BY ALL")


@register("stream_run_log", _PARTS_SQL)
def q_stream_run_log(spark, sf):
    """Runs (one a supplier nation) with metrics, params and tags as files; the table is brought up to
    date three times: from some runs, from all, and after a run was recorded twice."""
    root, table, check = (_scratch(spark, n) for n in ("runs", "run-table", "run-check"))
    li, su = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "supplier")
    metrics = li.join(su, li["l_suppkey"] == su["s_suppkey"]).groupBy(F.concat(F.lit("run-"), "s_nationkey").alias("run_id"), F.concat(F.lit("price-"), "l_linenumber").alias("name"), "l_linenumber",
                         F.year("l_shipdate").alias("step")).agg(F.max("l_extendedprice").alias("v"))
    lines = metrics.groupBy("run_id", "name").agg(F.array_join(F.array_sort(F.collect_list(     # a line a year
        F.concat_ws(" ", (F.lit(1_700_000_000) + F.col("l_linenumber")).cast("string"), F.col("v").cast("string"), F.col("step").cast("string")))), "\n").alias("text"))
    texts = su.groupBy(F.concat(F.lit("run-"), "s_nationkey").alias("run_id"), F.lit("supplier").alias("name")).agg(F.max("s_name").alias("text"))
    files = write_scratch(lines.select("run_id", F.lit("metrics").alias("kind"), "name", "text").unionByName(
        texts.select("run_id", F.explode(F.array(F.lit("params"), F.lit("tags"))).alias("kind"), "name", "text")), "run-files")
    first = F.pmod(F.xxhash64("run_id"), F.lit(3)) == 0
    for part, experiment in ((files.where(first), "0"), (files.where(~first), "0"), (files.where(first & (F.col("kind") == "metrics")), "1")):
        S.write_run_files(part.withColumn("experiment", F.lit(experiment)), root)
        S.update_run_log(spark, root, table, check)
    return S.read_run_log(spark, table)


def _run_log(spark, sf):
    """Metrics in the tracking layout (one text file per run and metric), scanned back."""
    root = _scratch(spark, "mlruns")
    long = M.metrics_long(_perf_small(spark, sf), run_col="run_id")
    line = F.concat_ws(" ", (F.length("metric") + 1_700_000_000).cast("string"), F.col("value").cast("string"),
                       F.length("run_id").cast("string"))
    long.select(F.concat(F.lit("0/"), "run_id").alias("exp_run"), "metric", line.alias("value")) \
        .write.partitionBy("exp_run", "metric").text(root)
    return S.scan_run_log(spark, root, layout="partitioned")


@register("scan_run_log", f"SELECT run_id, metric, CAST(length(metric) + 1700000000 AS BIGINT) AS ts, value, "
                          f"CAST(length(run_id) AS BIGINT) AS step FROM ({_METRICS_LONG_SQL}) m")
def q_scan_run_log(spark, sf):
    return _run_log(spark, sf)


@register("list_runs", f"SELECT DISTINCT run_id FROM ({_PERF_RUN_SQL}) p ORDER BY run_id LIMIT 5")
def q_list_runs(spark, sf):
    """The run listing: its first five ids."""
    return S.list_runs(_run_log(spark, sf))


@register("table_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def q_table_head(spark, sf):
    return S.table_head(fx.table(spark, sf, "orders"), 5, order=["o_orderkey"])


# ------------------------------------------------------------------ streaming history (2.7)
_YEARS_SQL = ("SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(l_returnflag = 'R' AS INTEGER) AS y_true, "
              "l_extendedprice / 105000.0 AS y_score FROM lineitem")


@register("stream_history",
          f"SELECT yr, n, auroc, ks_stat, CASE WHEN auroc IS NULL OR auroc < 0.7 OR (ks_stat IS NOT NULL AND ks_stat < 0.1) "
          f"THEN 'FAIL' ELSE 'PASS' END AS status FROM ({osql.metrics_sql(_YEARS_SQL, ['yr'], ['n', 'auroc', 'ks_stat'])}) m")
def q_stream_history(spark, sf):
    """Predictions land as files (one per ship year); the stream scores and gates each
    micro-batch and appends its record to the history table, which is read back."""
    from modelwatch.streaming.monitor import monitor_stream
    src, hist = _scratch(spark, "stream-src"), _scratch(spark, "stream-history")
    li = fx.table(spark, sf, "lineitem")
    preds = li.select(F.year("l_shipdate").alias("yr"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
                      (F.col("l_extendedprice") / 105000.0).alias("y_score"))
    preds.repartition("yr").write.parquet(src)
    q = monitor_stream(spark, src, "yr int, y_true int, y_score double", hist, by=["yr"], files_per_batch=1)
    q.awaitTermination()
    return spark.read.parquet(hist).select("yr", "n", "auroc", "ks_stat", "status")


# ------------------------------------------------------------------ remaining inventory names
@register("numeric_coerce", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, "
                            "TRY_CAST(event_type AS DOUBLE) AS event_type_num FROM events")
def q_numeric_coerce(spark, sf):
    from modelwatch.functions.scalar import numeric_coerce
    ev = fx.table(spark, sf, "events")
    return ev.select("event_id", numeric_coerce(F.get_json_object("props", "$.k")).alias("k"),
                     numeric_coerce("event_type").alias("event_type_num"))


@register("round6", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7.0, 6) AS price FROM lineitem")
def q_round6(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", round6(F.col("l_extendedprice") / 7.0).alias("price"))


_CO_NUM = ["anchor_age"] + _LABS
_CO_OTHER = ["subject_id", "hadm_id", "charttime", "gender", "admission_type", "anchor_year_group"]
_CO_SIDE = ("(WITH " + _COHORT_CTES + " SELECT " + ", ".join(_CO_OTHER + _CO_NUM) + " FROM cohort WHERE split = '{s}')")


_CO_ORDER = ["subject_id", "hadm_id", "charttime", *[c for c in CO.COHORT_COLUMNS
                                                      if c in _CO_NUM + _CO_OTHER and c not in ("subject_id", "hadm_id", "charttime")]]


@register("reorder_columns", f"SELECT *, '{','.join(_CO_ORDER)}' AS column_order FROM (" + both_sql(
    *[osql.prep_sql(_CO_SIDE.format(s="baseline"), _CO_SIDE.format(s="current"), _CO_NUM, _CO_OTHER, side=side)
      for side in ("baseline", "current")]) + ") x")
def q_reorder_columns(spark, sf):
    """Cohort -> prepare (baseline fits the scaler) -> id/time columns first; ``column_order``
    lists the columns as they come out."""
    c = _cohort(spark, sf).drop("position")
    b, cur = c.where("split = 'baseline'").drop("split"), c.where("split = 'current'").drop("split")
    bp, cp, _, _, _ = P.prepare_pair(b, cur)
    return both_splits(*[rounded(side, _CO_NUM).withColumn("column_order", F.lit(",".join(side.columns))) for side in (bp, cp)])


@register("union_chunks", ORACLE["join_item_labels"])
def q_union_chunks(spark, sf):
    """Lab events land in two chunk folders; one multi-path read appends them."""
    root = _scratch(spark, "chunks")
    ev = fx.lab_events(spark, sf)
    cut = F.col("charttime") < F.lit(fx.DRIFT_SPLIT_SHIPDATE).cast("timestamp_ntz")
    ev.where(cut).write.parquet(f"{root}/a")
    ev.where(~cut).write.parquet(f"{root}/b")
    events = CO.union_chunks(spark, paths=[f"{root}/a", f"{root}/b"])
    labs = CO.scan_events_filtered(events, CO.item_lookup(fx.lab_items(spark, sf), list(_T)))
    return labs.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("rows"),
                                     round6(F.avg("valuenum")).alias("mean_value"))


@register("prediction_rejects",
          f"SELECT segment, CAST(SUM(CASE WHEN TRY_CAST(y_true AS INTEGER) IN (0, 1) AND y_score IS NOT NULL "
          f"AND NOT isnan(y_score) THEN 1 ELSE 0 END) AS BIGINT) AS n_kept, "
          f"CAST(SUM(CASE WHEN TRY_CAST(y_true AS INTEGER) IN (0, 1) AND y_score IS NOT NULL "
          f"AND NOT isnan(y_score) THEN 0 ELSE 1 END) AS BIGINT) AS n_dropped "
          f"FROM ({fx.PREDICTIONS_TEXT_SQL}) p GROUP BY segment")
def q_prediction_rejects(spark, sf):
    """Rows kept and dropped per segment by the prediction validity rule (bad label,
    NULL or NaN score); the decided deviation D3 counts rather than hides them."""
    return M.prediction_rejects(fx.predictions_text(spark, sf), by=SEG)
