"""Stand-in inputs formed from the driver's tables, plus the same views in SQL.

These only rename and derive columns into the schemas the operators expect (see
FIXTURES.md); they do none of the operators' work. Each Spark builder has a SQL twin
(used by the oracle in ``plans/registry.py``) that must produce the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LINEITEM_ID_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
DRIFT_SPLIT_SHIPDATE = "1998-07-01"
EVENTS_SPLIT_TS = "2024-01-16"
# Lab-item stand-ins: part types playing the three target labs, and their short names.
COHORT_TARGETS = {"PROMO": "wbc", "SMALL": "lactate", "ECONOMY": "creatinine"}
COHORT_WINDOW = "365 days"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- predictions
def predictions_ties(spark, sf_dir) -> DataFrame:
    """lineitem: y_true = returnflag 'R', y_score = 10 * discount (11 distinct scores)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("segment"),
                     (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
                     (F.col("l_discount") * 10).alias("y_score"))


PREDICTIONS_TIES_SQL = """SELECT l_linestatus AS segment,
       CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
       l_discount * 10 AS y_score
FROM lineitem"""


def predictions_unique(spark, sf_dir) -> DataFrame:
    """lineitem: same label, y_score = extendedprice / 105000 (near-unique scores)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("segment"),
                     (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
                     (F.col("l_extendedprice") / 105000.0).alias("y_score"))


PREDICTIONS_UNIQUE_SQL = """SELECT l_linestatus AS segment,
       CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
       l_extendedprice / 105000.0 AS y_score
FROM lineitem"""


def predictions_text(spark, sf_dir) -> DataFrame:
    """labels joined to documents: y_true = quality, y_score = min(1, n_chars / 20000)."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return lab.join(doc, "doc_id").select(
        F.col("lang").alias("segment"), F.col("quality").alias("y_true"),
        F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("y_score"))


PREDICTIONS_TEXT_SQL = """SELECT d.lang AS segment, l.quality AS y_true,
       least(1.0, d.n_chars / 20000.0) AS y_score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def fairness_frame(spark, sf_dir) -> DataFrame:
    """lineitem x orders x customer: group = market segment, label = returnflag 'R'."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount",
                                                  "l_quantity", "l_extendedprice", "l_tax")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.select(F.col("l_orderkey").alias("hadm_id"), F.col("l_linestatus").alias("segment"),
                    F.col("c_mktsegment").alias("gender"),
                    (F.col("l_returnflag") == "R").cast("int").alias("label"),
                    (F.col("l_discount") * 10).alias("y_score"),
                    "l_quantity", "l_extendedprice", "l_tax")


FAIRNESS_FRAME_SQL = """SELECT li.l_orderkey AS hadm_id, li.l_linestatus AS segment, c.c_mktsegment AS gender,
       CAST(li.l_returnflag = 'R' AS INTEGER) AS label,
       li.l_discount * 10 AS y_score, li.l_quantity, li.l_extendedprice, li.l_tax
FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey"""


# ---------------------------------------------------------------- drift pairs
def drift_pair_events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, sf_dir, "events").select("ts", "value", "user_id")
    cond = F.col("ts") < F.lit(EVENTS_SPLIT_TS).cast("timestamp_ntz")
    return ev.where(cond).drop("ts"), ev.where(~cond).drop("ts")


DRIFT_EVENTS_BASE_SQL = f"SELECT value, user_id FROM events WHERE ts < TIMESTAMP '{EVENTS_SPLIT_TS}'"
DRIFT_EVENTS_CURR_SQL = f"SELECT value, user_id FROM events WHERE ts >= TIMESTAMP '{EVENTS_SPLIT_TS}'"
DRIFT_EVENTS_COLS = ["value"]  # user_id ends in _id


def drift_pair_lineitem(spark, sf_dir, shift_quantity: float | None = None,
                        null_quantity: bool = False) -> tuple[DataFrame, DataFrame]:
    """lineitem split on ship date. ``shift_quantity`` scales current l_quantity (pair C);
    ``null_quantity`` turns quantity 1 into NULL (the prep input)."""
    li = table(spark, sf_dir, "lineitem")
    if null_quantity:
        li = li.withColumn("l_quantity", F.when(F.col("l_quantity") != 1, F.col("l_quantity")))
    cond = F.col("l_shipdate") < F.lit(DRIFT_SPLIT_SHIPDATE).cast("timestamp_ntz")
    base, curr = li.where(cond), li.where(~cond)
    if shift_quantity is not None:
        curr = curr.withColumn("l_quantity", F.col("l_quantity") * shift_quantity)
    return base, curr


def drift_lineitem_sql(side: str, shift_quantity: float | None = None, null_quantity: bool = False) -> str:
    q = "nullif(l_quantity, 1)" if null_quantity else "l_quantity"
    if side == "current" and shift_quantity is not None:
        q = f"{q} * {shift_quantity}"
    op = "<" if side == "baseline" else ">="
    return (f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {q} AS l_quantity, "
            f"l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate "
            f"FROM lineitem WHERE l_shipdate {op} TIMESTAMP '{DRIFT_SPLIT_SHIPDATE}'")


DRIFT_LINEITEM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ---------------------------------------------------------------- cohort sources
def lab_events(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"),
        F.col("l_shipdate").alias("charttime"), F.col("l_partkey").alias("itemid"),
        F.col("l_extendedprice").alias("valuenum"), F.lit("USD").alias("valueuom"))


def admissions(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
                    F.col("o_orderdate").alias("admittime"),
                    F.col("o_orderdate").alias("dischtime"),
                    F.col("o_orderpriority").alias("admission_type"))


def patients(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("gender"),
                    F.col("c_nationkey").alias("anchor_age"),
                    (F.col("c_nationkey") % 5).cast("string").alias("anchor_year_group"))


def lab_items(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("itemid"), F.lower("p_type").alias("label"))


LAB_EVENTS_SQL = """SELECT o.o_custkey AS subject_id, li.l_orderkey AS hadm_id, li.l_shipdate AS charttime,
       li.l_partkey AS itemid, li.l_extendedprice AS valuenum
FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey"""
ADMISSIONS_SQL = """SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
       o_orderpriority AS admission_type FROM orders"""
PATIENTS_SQL = """SELECT c_custkey AS subject_id, c_mktsegment AS gender, c_nationkey AS anchor_age,
       CAST(c_nationkey % 5 AS VARCHAR) AS anchor_year_group FROM customer"""
LAB_ITEMS_SQL = "SELECT p_partkey AS itemid, lower(p_type) AS label FROM part"


# ---------------------------------------------------------------- contributions, runs
def contributions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("contrib"))


HISTORY_FAIL_BELOW = 2.0   # fixture rule: a record whose metric is under 2.0 is a FAIL


def history_records(spark, sf_dir) -> DataFrame:
    """events as run-history records: one record per event, model = event_type,
    run = (day, event_type), metric = value, status FAIL when the metric is under 2.0."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat_ws(":", F.date_format("ts", "yyyy-MM-dd"), "event_type").alias("run_id"),
        F.col("event_type").alias("model"), F.col("ts"), F.col("event_id"), F.col("value").alias("metric"),
        F.when(F.col("value") < HISTORY_FAIL_BELOW, "FAIL").otherwise("PASS").alias("status"))


HISTORY_SQL = f"""SELECT strftime(ts, '%Y-%m-%d') || ':' || event_type AS run_id, event_type AS model, ts, event_id,
       value AS metric, CASE WHEN value < {HISTORY_FAIL_BELOW} THEN 'FAIL' ELSE 'PASS' END AS status FROM events"""
