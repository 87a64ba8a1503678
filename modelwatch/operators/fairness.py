"""Fairness audit: positive rate per group, parity gap, per-group classification table,
and a train-and-score audit that feeds the per-group table.

``fairness_by_group`` computes the overall row and the per-group rows in ONE plan: each
row is expanded to (its group) and ('__overall__') before the score pre-aggregation,
which is how Spark's grouping sets work (Expand, then map-side combine), so the rank
statistics (AUC) run once over n + 1 groups instead of twice.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import fairness_features, pick_group_column
from modelwatch.functions.scalar import round6
from modelwatch.operators.metrics import raw_metrics
from modelwatch.operators.prefix import row_position
from modelwatch.session import materialize

OVERALL = "__overall__"
POSITIVE_RATE_SCHEMA = "metric string, group string, value double"
FAIRNESS_COLUMNS = ["group", "n", "accuracy", "precision", "recall", "f1", "auc", "pos_rate"]


def positive_rate_by_group(df: DataFrame, group: str, label: str = "label",
                           by: Sequence[str] = ()) -> DataFrame:
    """Share of label == 1 per group. Unparsable / NULL labels stay in the denominator
    as non-positive; NULL groups are dropped. Missing columns give an empty table."""
    by = list(by)
    if group not in df.columns or label not in df.columns:
        return df.sparkSession.createDataFrame([], POSITIVE_RATE_SCHEMA)
    pos = F.when(F.col(label).try_cast("double") == 1, 1.0).otherwise(0.0)
    return (df.where(F.col(group).isNotNull())
              .groupBy(*by, F.col(group).cast("string").alias("group"))
              .agg(F.avg(pos).alias("value"))
              .select(*by, F.lit("positive_rate").alias("metric"), "group", round6("value").alias("value")))


def parity_gap(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gap (max - min) and ratio (min / max) of the per-group rates, per ``by``."""
    return rates.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("n_groups"),
        round6(F.max("value") - F.min("value")).alias("parity_gap"),
        round6(F.try_divide(F.min("value"), F.max("value"))).alias("parity_ratio"))


def fairness_by_group(df: DataFrame, group: str, y: str = "label", s: str = "y_score",
                      thr: float = 0.5) -> DataFrame:
    """Overall and per-group n, accuracy, precision, recall, F1, AUC, predicted-positive
    rate. AUC is NULL for a group with one class only. Rows without a group count in the
    overall row only."""
    g = F.col(group).cast("string")
    ex = df.select(F.explode(F.array(g, F.lit(OVERALL))).alias("group"), F.col(y).alias("_y"), F.col(s).alias("_s")) \
           .where(F.col("group").isNotNull())
    m = raw_metrics(ex, "_y", "_s", by=["group"], thr=thr)
    n = F.col("n")
    return m.select(
        "group", n.cast("long").alias("n"),
        round6("accuracy_at_05").alias("accuracy"),
        round6(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))).alias("precision"),
        round6(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))).alias("recall"),
        round6("f1_at_05").alias("f1"),
        round6("auroc").alias("auc"),
        round6(F.try_divide(F.col("tp") + F.col("fp"), n)).alias("pos_rate"))


def fairness_slices(table: DataFrame, metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1", "auc")) -> DataFrame:
    """Slices x metrics grid (long rows pivoted back with an explicit metric list)."""
    metrics = list(metrics)
    long = table.select("group", *[F.col(c).cast("double") for c in metrics]).unpivot(
        ["group"], metrics, "metric", "value")
    return long.groupBy(F.col("group").alias("slice")).pivot("metric", metrics).agg(F.first("value"))


def split_train_test(df: DataFrame, label: str = "label", key_cols: Sequence[str] | None = None,
                     seed: int = 42, train_share: float = 0.7) -> DataFrame:
    """Stratified split column ``_train``: within each label the first ``train_share`` of
    the rows (rounded to whole rows), in the order of a hash of the row id and the seed.

    The id is ``key_cols`` where the caller names columns that identify a row (the split
    then does not depend on the table's layout), else a row number given once and
    checkpointed, so equal rows are dealt one by one and a recomputed task repeats the split.
    """
    rows = materialize(df.withColumn("_rid", F.monotonically_increasing_id()))
    h = F.xxhash64(*(key_cols or ["_rid"]), F.lit(seed))
    placed = row_position(rows.withColumn("_h", h), ["_h", "_rid"], by=[label])
    return (placed.withColumn("_train", F.col("position") < F.round(F.col("n_rows") * F.lit(train_share)))
            .drop("_rid", "_h", "position", "n_rows"))


def train_score_audit(df: DataFrame, group: str | None = None, label: str = "label",
                      seed: int = 42, key_cols: Sequence[str] | None = None, max_iter: int = 1000) -> DataFrame:
    """Scale numeric features by their std over all rows (no centring), fit an L2 logistic
    regression on 70 % of each label (C = 1 is regParam = 1 / n_train in Spark's objective),
    score the rest, and report ``fairness_by_group`` on the scored part. Distributed MLlib
    fit; the split is computed and written once (see ``split_train_test``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    gcol = pick_group_column(df, group)
    feats = fairness_features(df, label)
    if gcol is None or not feats or label not in df.columns:
        return df.sparkSession.createDataFrame([], "group string, n bigint, accuracy double, precision double, "
                                                   "recall double, f1 double, auc double, pos_rate double")
    feats = [c for c in feats if c != gcol]
    keys = {f"_key{i}": F.col(c) for i, c in enumerate(key_cols or [])}
    data = df.select(gcol, F.col(label).cast("double").alias("_label"), *[c.alias(k) for k, c in keys.items()],
                     *[F.col(c).cast("double").alias(c) for c in feats]).na.drop(subset=feats + ["_label"])
    data = materialize(split_train_test(data, "_label", list(keys), seed))     # read by scaler, count, fit and scoring
    scaler = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="_raw"),
                              StandardScaler(inputCol="_raw", outputCol="_x", withMean=False, withStd=True)]).fit(data)
    data = scaler.transform(data).select(gcol, "_label", "_train", "_x")
    train = data.where("_train")
    n_train = train.count()
    model = LogisticRegression(featuresCol="_x", labelCol="_label", maxIter=max_iter, regParam=1.0 / max(n_train, 1),
                               elasticNetParam=0.0, standardization=False).fit(train)
    scored = model.transform(data.where(~F.col("_train")))
    scored = scored.select(gcol, F.col("_label").cast("int").alias("label"),
                           vector_to_array("probability")[1].alias("y_score"))
    return fairness_by_group(scored, gcol, "label", "y_score")
