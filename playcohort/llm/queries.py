"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playcohort.llm import conversations, decontaminate, hard_negatives, html_extract, jaccard_join, licences, packing, quality_rules, secret_scan, sharding, simhash, tokens, toxicity
from playcohort.llm.common import table

WINDOW = 2048
END_ID = 1
TOXIC = 0.7
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"), ["page_id", "url"])


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, RANKS, public_tokenizers.PATTERN)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        of("random").alias("n_random"),
    )


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.classes_of(table(spark, folder, "documents"))


def op4_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.find_licences(table(spark, folder, "documents"))
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"])))
    spans = F.transform("notices", lambda n: F.concat_ws(":", n["paragraph"], n["family"]))
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.concat_ws(",", families).alias("families"),
        F.concat_ws(",", spans).alias("notices"),
    )


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.mark(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("hits"), F.col("n_words")).alias("contaminated"),
    )


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, table(spark, folder, "labels"), usable=~held_out(F.col("doc_id")))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, folder, docs))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counted = tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    cut = packing.pieces(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        WINDOW,
        END_ID,
        ranks_file=RANKS,
        pattern=public_tokenizers.PATTERN,
    )
    return packing.pack(cut, WINDOW).withColumnRenamed("id", "doc_id")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.proportional_shards(table(spark, folder, "documents"), 24)
    return shards.select(
        "doc_id",
        (F.col("n_bytes") + 8).alias("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with faults that the checksum of their key decides (nulls: one space)."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), copies
    )


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.summaries(conversations.edits(damaged(rows))).withColumnRenamed("conv_id", "_conv")
    named = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return named.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_secret_scan": op2_secret_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_licence_scan": op4_licence_scan,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
