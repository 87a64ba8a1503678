"""Feature attribution ranking: mean |contribution| per feature, top-k, and the
normalisation of attribution JSON files in their several accepted shapes."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.functions.scalar import round6

DEFAULT_TOPK = 25


def mean_abs_impact(df: DataFrame, col: str = "contrib", names: Sequence[str] | None = None) -> DataFrame:
    """(name, mean_abs_impact, pos): mean |contribution| per array position over all rows.

    ``posexplode`` then one grouped average (map-side combined; one group per feature).
    A single input row gives |contribution| per feature, as for a 1-D array."""
    ex = df.select(F.posexplode(col).alias("pos", "v"))
    g = ex.groupBy("pos").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("mean_abs_impact"))
    if names is not None:
        name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1)
    else:
        name = F.concat(F.lit("f"), F.col("pos").cast("string"))
    return g.select(name.alias("name"), "mean_abs_impact", F.col("pos").cast("int").alias("pos"))


def top_features(impacts: DataFrame, topk: int | None = DEFAULT_TOPK, rounded: bool = True) -> DataFrame:
    """By impact descending; ties keep input (position) order; k <= 0 or None -> all."""
    out = impacts.orderBy(F.desc("mean_abs_impact"), F.asc("pos"))
    if topk is not None and topk > 0:
        out = out.limit(int(topk))
    if rounded:
        out = out.select("name", round6("mean_abs_impact").alias("mean_abs_impact"), "pos")
    return out


def top_features_named(impacts: DataFrame, topk: int = DEFAULT_TOPK) -> DataFrame:
    """By impact descending, then name; cut at ``topk``."""
    out = impacts.orderBy(F.desc("mean_abs_impact"), F.asc("name")).limit(int(topk))
    return out.select("name", round6("mean_abs_impact").alias("mean_abs_impact"))


def _entries(raw: DataFrame) -> DataFrame:
    """(path, e): one row per object of {"features": [...]}, {"top_features": [...]} or a bare list.

    The text is parsed once into a VARIANT; whatever its shape, lists and fields are read from
    that. An empty or missing ``features`` gives way to ``top_features``; entries that are no
    objects (names, numbers, lists) are left out, and a broken file has none."""
    doc = raw.select("path", F.try_parse_json("value").alias("doc"))
    lists = doc.select("path", *[F.try_variant_get("doc", at, "array<variant>").alias(name)
                                 for name, at in (("features", "$.features"), ("top", "$.top_features"), ("bare", "$"))])
    of = F.when(F.size("features") > 0, F.col("features")).otherwise(F.coalesce("top", "bare"))
    return lists.select("path", F.explode(of).alias("e")).where(F.schema_of_variant("e").startswith("OBJECT"))


def _first_of(keys: Sequence[str], kind: str) -> Column:
    """The first of the keys that an entry holds, as ``kind``. A key that is there with a JSON
    null is an answer: the entry has no such value."""
    out = F.lit(None).cast(kind)
    for k in reversed(list(keys)):
        own = F.try_variant_get("e", f"$.{k}", "variant")
        out = F.when(own.isNotNull(), F.try_variant_get("e", f"$.{k}", kind)).otherwise(out)
    return out


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole text of each JSON file (a file is one JSON document)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _normalized(spark: SparkSession, path: str, names: Sequence[str], impacts: Sequence[str]) -> DataFrame:
    e = _entries(read_json_files(spark, path))
    return e.select("path", _first_of(names, "string").alias("name"), _first_of(impacts, "double").alias("mean_abs_impact")) \
            .where(F.col("name").isNotNull() & F.col("mean_abs_impact").isNotNull())


def normalize_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, mean_abs_impact) per entry. Keys ``name``/``feature`` and
    ``mean_abs_impact``/``importance``; entries with no name or a non-numeric impact are
    dropped, names that are numbers become text. Rank with ``top_features`` / ``orderBy``
    when an order is needed."""
    return _normalized(spark, path, ("name", "feature"), ("mean_abs_impact", "importance"))


def normalize_features_alt(spark: SparkSession, path: str) -> DataFrame:
    """Like ``normalize_features``, also accepting keys ``column`` and ``mean_abs``;
    nameless entries are dropped (they would otherwise become the text 'None'). The
    reference's order (impact descending, then name) is ``top_features_named``."""
    return _normalized(spark, path, ("name", "feature", "column"), ("mean_abs_impact", "mean_abs", "importance"))


def write_top_features(top: DataFrame, path: str) -> None:
    """One JSON document {"n_top_features": k, "features": [{name, mean_abs_impact}]},
    features by impact descending (ties by position).

    ``top`` is already cut to k rows, so gathering it into one record is bounded by k."""
    doc = top.agg(F.sort_array(F.collect_list(F.struct(
        F.negative("mean_abs_impact").alias("_k"),
        F.col("pos").alias("_pos") if "pos" in top.columns else F.lit(0).alias("_pos"),
        "name", "mean_abs_impact"))).alias("f"))
    doc = doc.select(F.size("f").alias("n_top_features"),
                     F.transform("f", lambda x: F.struct(x["name"].alias("name"),
                                                         x["mean_abs_impact"].alias("mean_abs_impact"))).alias("features"))
    doc.coalesce(1).write.mode("overwrite").json(path)
