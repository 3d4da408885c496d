"""One query for each operator of this subpackage, with production parameters, over whole tables; and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, exact_dedup, html_extraction, line_dedup, lm_scoring, mixing, pii, quality_rules, sharding, simhash, sql, toxicity, vector_codes
from .common import written

#: Shards of the placement query.
SHARDS = 16
#: The mixture: its tokens over all tokens, and how often a document may be taken.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), sharding.regular_topology(SHARDS))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, expected=docs.count())
    found = exact_dedup.deduplicate(docs, index)
    index.forget()
    return found


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = ~toxicity.held_out(F.col("doc_id"))
    found = toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), learned)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", F.round("coverage", 9).alias("coverage"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    found = lm_scoring.scored(table(spark, sf_dir, "documents"), held_out)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("mean_score"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extracted(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select(F.col("_id").alias("doc_id"), "domain", "lang", "source", "tokens", "copies")


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations with a fault in every fourth row, by a checksum of its place: dropped, emptied, left without ends of sentences, repeated, or given to the user."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in turns.columns}
    fault = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    body = F.when(fault == 1, "").when(fault == 2, F.translate(text["text"], ".!?", "")).otherwise(text["text"])
    rows = turns.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(text["role"]).alias("role"), body.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, _ = conversation_repair.repaired(damaged(turns))
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *quality_rules.MEASURES, F.array_join("failed", ",").alias("failed"), "base_failed", "kept")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encoded(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = written(coded.select("vec_id", "code", "error", "label"), "vector-codes")
    found = vector_codes.with_label_error(coded)
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebook_sha256(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_simhash_near_dedup, op3_exact_dedup, op4_line_dedup, op5_toxicity, op6_benchmark_decontamination, op7_lm_scoring, op8_html_extraction, op9_pii, op10_mixing, op11_conversation_repair, op12_quality_rules, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": sql.sharding_sql(SHARDS),
    "op3_exact_dedup": sql.EXACT_DEDUP_SQL,
    "op4_line_dedup": sql.LINE_DEDUP_SQL,
    "op10_mixing": sql.mixing_sql(MIX_SHARE, MIX_EPOCHS, MIX_SEED),
    "op11_conversation_repair": sql.conversation_repair_sql(),
    "op12_quality_rules": sql.quality_rules_sql(),
    "op13_vector_codes": sql.vector_codes_sql(),
}
