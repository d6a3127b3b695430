"""The corpus pipeline: raw documents to token ids.

Each stage works on all that its predecessor kept. All but the last return
the columns of documents; the last returns a row of token ids a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm import bpe, decontaminate, line_dedup, quality, simhash
from quiltgraph.llm.common import checkpointed, small, small_batches, stage_written
from quiltgraph.llm.queries import vocabulary

#: SQL has neither the hashes nor the tokeniser; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.passing(quality.verdicts(docs, labels))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are common on their source."""
    return line_dedup.without_boilerplate(docs, "source")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``(row, doc)``: each row with a number of its own, written once so that it stays."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return stage_written(docs.select(F.monotonically_increasing_id().alias("row"), doc), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are alike: the one with the smallest id, or any where none has an id.

    Five-word shingles and a Jaccard similarity of 0.8. Rows are linked by their texts only, whatever their ids.
    """
    small_batches(spark)
    rows = numbered(docs, "near duplicates rows")
    groups = simhash.similar_groups(rows, "row", "doc.text")
    ids = rows.select("row", F.col("doc.doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    firsts = groups.join(ids, "row").groupBy("group").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("group", "first.row")
    others = groups.join(firsts.withColumnRenamed("row", "first"), "group").where("row != first").select("row")
    return rows.join(small(checkpointed(others)), "row", "left_anti").select("doc.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the words of benchmark windows are cut.

    What stood between two words of a cut span goes with it, what stood around
    the span stays. Each row is judged by its own text, whatever its id.
    """
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = numbered(docs, "decontamination rows")
    found = decontaminate.occurrences(rows, items, "row", "doc.text")
    hit = found.withColumn("n_hit", decontaminate.n_hit(F.col("spans"))).where("n_hit > 0")
    hit = hit.select(F.col("doc_id").alias("row"), "spans", decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
    joined = rows.join(hit, "row", "left").where("contaminated IS NULL OR NOT contaminated")
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(decontaminate.cut(F.col("doc.text"), F.col("spans")))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every document left."""
    small_batches(spark)
    return bpe.encoded(docs, vocabulary()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", boilerplate_lines),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
