"""Secret scans with DataFrame functions only.

Three patterns give the base spans. Besides them, every run of 20 or more
token characters is scored by two character Markov models, one of random
strings and one of ordinary identifiers, both trained here from labelled
samples; a run whose log-likelihood ratio a character exceeds ``THRESHOLD`` is
a span of kind ``random``. The models are one table of 65 x 65 integers
(64 characters and the start), so they travel as a literal.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


KINDS = ("assign", "access", "hex", "random")
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_VALUE = 6
RUN = "[A-Za-z0-9+/_-]{20,}"
#: Characters of the models, in order; the start of a string is 0, others fold to the last.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
WIDTH = len(ALPHABET) + 1
SCALE = 1000
#: Nats a character by which a random string must be likelier than an identifier.
THRESHOLD = 0.35
#: The labelled samples' bounds: random strings of each kind, and labelled rows read for identifiers.
MAX_RANDOM = 2000
MAX_ROWS = 2000


def random_samples(spark: SparkSession, n: int = MAX_RANDOM) -> DataFrame:
    """Strings labelled random, made from hashes: base64, hexadecimal, and letters with digits."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    base64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    kinds = F.array(base64, F.substring(digest, 1, 40), F.translate(base64, "+/", ""), F.upper(F.translate(base64, "+/_-", "")))
    return spark.range(n).select(F.explode(kinds).alias("sample"), F.lit(1).alias("random"), F.lit(1).cast("long").alias("weight"))


def ordinary_samples(docs: DataFrame, labels: DataFrame, n: int = MAX_ROWS) -> DataFrame:
    """Strings labelled ordinary: words of labelled rows of good quality, base spans cut out,
    and identifiers joined from them; at most ``n`` rows, by hashed id. Digits count as ordinary.
    Each different word is a row, ``weight`` the number of times it occurs."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("labelled")).distinct().orderBy(F.xxhash64("labelled"), "labelled").limit(n)
    texts = docs.join(F.broadcast(good), F.col("doc_id") == F.col("labelled"), "left_semi").select("text")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    word = texts.select(F.explode(F.split(plain, r"[^A-Za-z0-9_-]+")).alias("sample")).where(F.length("sample") >= 3).groupBy("sample").agg(F.count("*").alias("weight"))
    joined = [F.col("sample"), F.concat("sample", F.lit("_"), F.lower("sample")), F.concat(F.lit("-"), "sample", F.initcap("sample")), F.concat(F.upper("sample"), F.lit("_")), F.concat("sample", F.lit("20240131")), F.lit("4096-1234567890")]
    return word.select(F.explode(F.array(*joined)).alias("sample"), F.lit(0).alias("random"), "weight")


def _codes(sample: Column) -> Column:
    """Places in the alphabet, a start before them."""
    folded = F.translate(sample, "+/", "__")
    chars = F.filter(F.split(folded, ""), lambda c: c != "")
    return F.concat(F.array(F.lit(0)), F.transform(chars, lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c)).otherwise(F.lit(WIDTH - 1))))


def _steps(codes: Column) -> Column:
    """Each step from one character to the next as ``before * WIDTH + after``."""
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: a * WIDTH + b)


def trained(samples: DataFrame) -> list[int]:
    """For each step the log of its chance in random over that in ordinary strings, times ``SCALE``.

    ``samples``: ``(sample, random, weight)`` with 1 for random strings and 0
    for ordinary ones, each counting ``weight`` times, or once without that column. Each chance is smoothed by a count of one a character. Only
    the step counts, ``2 * WIDTH ** 2`` at most, reach the driver.
    """
    if "weight" not in samples.columns:
        samples = samples.withColumn("weight", F.lit(1).cast("long"))
    steps = samples.where(F.col("sample").isNotNull()).select("random", "weight", _codes(F.col("sample")).alias("codes")).select("random", "weight", F.explode(_steps(F.col("codes"))).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.sum("weight").alias("n")).collect()}
    table = []
    for a in range(WIDTH):
        row = [[counts.get((kind, a * WIDTH + b), 0) for b in range(WIDTH)] for kind in (1, 0)]
        sums = [sum(x) + WIDTH for x in row]
        table += [round(SCALE * log((p + 1) / sums[0] * sums[1] / (q + 1))) for p, q in zip(*row, strict=True)]
    return table


def _found(text: Column, pattern: str, guard: Column, kind: str) -> Column:
    """All matches, leftmost first, with code point places: ``array<struct<start, end, kind, text>>``.

    Matches and what stands between them are taken in one pass, so a place is
    a sum of lengths. ``guard`` spares texts without a match that pass.
    """
    whole = f"(?s)(.*?)(?:({pattern})|\\z)"
    gaps, matches = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), pair["match"].alias("text"))
        return F.struct(end.alias("at"), F.when(F.length(pair["match"]) > 0, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    kind_type = "array<struct<start:int,end:int,kind:int,text:string>>"
    nothing = F.array().cast(kind_type)
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))
    return F.when(guard, F.aggregate(pairs, start, add, lambda done: done["spans"]).cast(kind_type)).otherwise(nothing)


def spans(docs: DataFrame, model: list[int], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all of ``docs``) and ``spans``: ``array<struct<start, end, kind, text>>``.

    ``kind`` is a place in ``KINDS``; spans are sorted by start, then kind.
    Base matches whose value is too short are dropped after matching, so they
    still hide what they cover. A ``random`` span is added where it isn't
    within a base span. Null and empty texts have no spans; repeated rows keep
    theirs; all columns of ``docs`` are kept in ``row``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"))
    value = lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= LEAST_VALUE
    t = F.col("t")
    base = row.select(
        "row",
        "t",
        F.filter(_found(t, ASSIGN, t.rlike(ASSIGN), "assign"), value).alias("assign"),
        _found(t, ACCESS, F.contains(t, F.lit("AKIA")), "access").alias("access"),
        _found(t, HEX, t.rlike(HEX), "hex").alias("hex"),
        _found(t, RUN, t.rlike(RUN), "random").alias("runs"),
    ).withColumn("base", F.concat("assign", "access", "hex"))
    table = F.from_json(F.lit("[" + ",".join(map(str, model)) + "]"), "array<int>")
    ratio = lambda s: F.aggregate(_steps(_codes(s["text"])), F.lit(0).cast("long"), lambda total, k: total + F.get(table, k)) / F.length(s["text"])
    within = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    added = F.filter("runs", lambda s: (ratio(s) > threshold * SCALE) & ~within(s))
    every = F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"))))
    return base.select("row", F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"))).alias("spans"))


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    some = F.filter(found, lambda s: s["kind"].isin([KINDS.index(k) for k in kinds]))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
