"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("op2_simhash_dedup")
def op2(spark, sf):
    from modelwatch.llm.simhash_dedup import simhash_groups
    return simhash_groups(table(spark, sf, "documents"), shingle=3, radius=2)


@register("op3_sentencepiece_codec")
def op3(spark, sf):
    import public_tokenizers
    from modelwatch.llm.piece_codec import piece_codes
    return piece_codes(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op8_token_counts")
def op8(spark, sf):
    import public_tokenizers
    from modelwatch.llm.token_counts import token_counts
    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@register("op10_benchmark_decontamination")
def op10(spark, sf):
    from modelwatch.llm.decontaminate import leaks
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _op9_sql() -> str:
    from modelwatch.llm.line_templates import strip_templates_sql
    return strip_templates_sql()


@register("op9_line_templates", _op9_sql())
def op9(spark, sf):
    from modelwatch.llm.line_templates import strip_templates
    return strip_templates(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@register("op1_quality_classifier")
def op1(spark, sf):
    from modelwatch.llm.quality import quality
    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op4_language_id")
def op4(spark, sf):
    from modelwatch.llm.language_id import language_id
    return language_id(table(spark, sf, "documents"))


@register("op6_toxicity")
def op6(spark, sf):
    from modelwatch.llm.toxicity import toxicity
    out = toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.withColumn("n_offending", F.size("offending").cast("long"))


@register("op7_lm_scoring")
def op7(spark, sf):
    from modelwatch.llm.lm_score import lm_scores
    return lm_scores(table(spark, sf, "documents"))


def _op5_sql() -> str:
    from modelwatch.llm.embedding_dedup import embedding_groups_sql
    return embedding_groups_sql(0.9)


@register("op5_embedding_dedup", _op5_sql())
def op5(spark, sf):
    from modelwatch.llm.embedding_dedup import embedding_groups
    return embedding_groups(table(spark, sf, "embeddings"), threshold=0.9)


def _op11_sql() -> str:
    from modelwatch.llm.merkle import merkle_sql
    return merkle_sql()


@register("op11_merkle_manifest", _op11_sql())
def op11(spark, sf):
    from modelwatch.llm.merkle import FIELDS, fold, leaf_digest, merkle_manifest, proof_digest
    docs = table(spark, sf, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_digest(*[lower if c == "text" else F.col(c) for c in FIELDS])
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    made = merkle_manifest(docs, keep={"claim": F.when(hit, tampered)})
    folded = made.withColumn("folded_root", fold(F.coalesce("claim", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def _op12_sql() -> str:
    from modelwatch.llm.quality_rules import quality_rules_sql
    return quality_rules_sql()


@register("op12_quality_rules", _op12_sql())
def op12(spark, sf):
    from modelwatch.llm.quality_rules import quality_rules
    out = quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1"))
    return out.withColumn("score", F.round("score", 6))


def _op13_sql() -> str:
    from modelwatch.llm.fill_middle import fill_in_middle_sql
    return fill_in_middle_sql()


@register("op13_fill_in_middle", _op13_sql())
def op13(spark, sf):
    from modelwatch.llm.fill_middle import fill_in_middle, restore
    made = restore(fill_in_middle(table(spark, sf, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
