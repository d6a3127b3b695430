"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm import bpe, chat_format, decontaminate, line_dedup, oracles, ppm, quality, secret_scan, sharding, simhash, substring_dedup
from quiltgraph.llm.common import sha256, table


#: The byte limit of a shard in op3.
SHARD_BYTES = 1 << 20


def vocabulary() -> str:
    """The vocabulary file of the pipeline and op5."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    samples = secret_scan.random_samples(spark).unionByName(secret_scan.ordinary_samples(docs, labels))
    found = secret_scan.spans(docs, secret_scan.trained(samples))
    spans = F.col("spans")
    return found.select(
        "row.doc_id",
        *[secret_scan.count(spans, kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        sha256(secret_scan.listed(spans, secret_scan.KINDS[:3])).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    test = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", test), (-1, 1, "assistant", test)], "conv_id long, turn long, role string, text string")
    read = chat_format.read_back(chat_format.tree(given.unionByName(extra)))
    turns, losses = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), F.array_join("losses", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(F.array_join(turns, "")).alias("turns_sha256"),
        F.length(losses).cast("long").alias("loss_chars"),
        sha256(losses).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    kept = docs.select("doc_id", size.cast("long").alias("n_bytes"))
    return sharding.sharded(kept, F.col("n_bytes"), F.col("doc_id"), limit=SHARD_BYTES).select("doc_id", "n_bytes", "shard", F.length("shard").cast("long").alias("depth"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.occurrences(docs, items).withColumn("n_hit", decontaminate.n_hit(F.col("spans")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encoded(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.verdicts(docs, labels).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    kept = line_dedup.without_boilerplate(docs, "source", counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.removed(table(spark, sf_dir, "documents", "doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), sha256(F.col("kept")).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_chat_format": op2_chat_format,
        "op3_sharding": op3_sharding,
        "op4_decontaminate": op4_decontaminate,
        "op5_bpe": op5_bpe,
        "op6_quality": op6_quality,
        "op7_ppm": op7_ppm,
        "op8_line_dedup": op8_line_dedup,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": oracles.OP2,
        "op3_sharding": oracles.OP3.format(limit=SHARD_BYTES),
        "op4_decontaminate": oracles.OP4,
        "op8_line_dedup": oracles.OP8,
        "op9_substring_dedup": oracles.OP9,
    }
