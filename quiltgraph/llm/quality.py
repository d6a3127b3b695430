"""Quality rules with DataFrame functions only.

Base rules look at words, symbols and repetition. The verdict on the rest is
a log-likelihood ratio: words and word pairs are hashed to a fixed number of
buckets, one multinomial is counted over a trusted target, one over the whole
raw corpus, and a document's score is the mean over its n-grams of the log of
their ratio. Every document is held against the same threshold.

The corpus is counted in full. The target is labelled rows, at most
``MAX_TRUSTED`` of them, those whose hashed ids are smallest. The model holds
``BUCKETS`` integers, whatever the corpus, and travels as a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import SPACE, words

BUCKETS = 10_000
MAX_TRUSTED = 100_000
#: Log-likelihood ratio in thousandths of a nat.
SCALE = 1000
THRESHOLD = -0.5
SYMBOLS = "#*$%&|<>"
ENDING = 3
MIN_WORDS = 50
MAX_REPEATED = 50


def trusted(labels: DataFrame, id_col: str = "doc_id", most: int = MAX_TRUSTED) -> DataFrame:
    """Ids of labelled rows of good quality: a documented bound of ``most`` rows, by hashed id."""
    good = labels.where("quality = 1").select(F.col(id_col).alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def hashed(word_list: Column) -> Column:
    return F.transform(word_list, lambda w: F.xxhash64(w))


def endings(word_list: Column) -> Column:
    """Hashes of the last three characters of each word."""
    return F.transform(word_list, lambda w: F.xxhash64(F.lit(ENDING), F.right(w, F.lit(ENDING))))


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbouring words, in order."""
    return F.when(F.size(hashes) > 1, F.zip_with(F.slice(hashes, 1, F.size(hashes) - 1), F.slice(hashes, 2, F.size(hashes)), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def _buckets(hashes: Column, ends: Column, buckets: int) -> Column:
    return F.transform(F.concat(hashes, _pairs(hashes), ends), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _n_repeat_words(hashes: Column) -> Column:
    """Words in three-word windows that a text has twice or more.

    Hashed windows are sorted with their places; the places of equal
    neighbours, sorted again, cover three words each or up to the next place.
    A text whose windows all differ is told by their distinct count alone.
    """
    n = F.size(hashes)
    windows = F.zip_with(F.zip_with(F.slice(hashes, 1, n - 2), F.slice(hashes, 2, n - 2), lambda a, b: F.xxhash64(a, b)), F.slice(hashes, 3, n), lambda p, c: F.xxhash64(p, c))

    def covered(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.transform(F.array(placed), _equal_places)[0]

    def _equal_places(placed: Column) -> Column:
        same = F.filter(placed, lambda x, k: (x["h"] == F.get(placed, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(placed, k + 1)["h"]).eqNullSafe(True))
        places = F.array(F.sort_array(F.transform(same, lambda x: x["i"])))
        return F.transform(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda s, x: s + x))[0]

    some = F.transform(F.array(windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))[0]
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(some)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as ``row`` with the base measures and the hashed words beside it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(f"^{SPACE}*$"))
    first = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"), words(text).alias("w"), lines.alias("lines"))
    second = first.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashed(F.col("w")).alias("hashes"),
        endings(F.col("w")).alias("ends"),
    )
    return second.withColumn("n_repeat_words", _n_repeat_words(F.col("hashes")))


def ratio_model(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """For each bucket the log-likelihood ratio of target to corpus, times ``SCALE``.

    Counts cover the whole corpus, summed before they are shuffled; ``buckets``
    rows reach the driver. Both multinomials are smoothed by one count a bucket.
    """
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(trusted_ids), F.col("id") == F.col("trusted_id"), "left")
    cut = flagged.select(F.col("trusted_id").isNotNull().cast("long").alias("target"), words(F.col("text")).alias("w"))
    parts = cut.select("target", hashed(F.col("w")).alias("hashes"), endings(F.col("w")).alias("ends"))
    grams = parts.select("target", F.explode(_buckets(F.col("hashes"), F.col("ends"), buckets)).alias("bucket"))
    counts = {r.bucket: (r.raw, r.target) for r in grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")).collect()}
    return weights(counts, buckets)


def weights(counts: dict[int, tuple[int, int]], buckets: int) -> list[int]:
    from math import log

    all_raw, all_target = (sum(c[k] for c in counts.values()) + buckets for k in (0, 1))
    if all_target == buckets:  # no target: nothing speaks against any document
        return [0] * buckets
    got = [counts.get(b, (0, 0)) for b in range(buckets)]
    return [round(SCALE * log((target + 1) / all_target * all_raw / (raw + 1))) for raw, target in got]


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``row`` (all of ``docs``) with its measures, ``score``, ``base_failed`` and ``kept``.

    ``score``: the mean log-likelihood ratio of the text's words, word pairs
    and word endings, 0 for a text without words. Base rules reject texts of fewer than
    50 words or with over half of them in repeated windows; the rest is kept
    at a score of ``threshold`` or more. Null counts as empty. Labels without
    id, labels of absent documents and repeated labels do no harm; without
    any trusted row all scores are 0. Repeated rows each get a row.
    """
    model = ratio_model(docs, trusted(labels), id_col, text_col, buckets)
    table = F.from_json(F.lit("[" + ",".join(map(str, model)) + "]"), "array<int>")
    total = F.aggregate(_buckets(F.col("hashes"), F.col("ends"), buckets), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    n_grams = F.greatest(3 * F.col("n_words") - 1, F.lit(1))
    scored = measured(docs, text_col).withColumn("score", total / (F.lit(float(SCALE)) * n_grams))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return scored.drop("hashes", "ends").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def passing(rows: DataFrame) -> DataFrame:
    """The rows of ``verdicts`` that are kept.

    A filter on ``kept`` alone would be pushed below the measures, which would
    then be computed for every mention of theirs; one that isn't deterministic
    stays above them.
    """
    stays = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return rows.withColumn("stays", stays).where("stays").select("row.*")
