"""Line dedup by site-relative frequency, with DataFrame functions only.

A line's pages on a host, divided by the host's pages, is its frequency
there; lines above a boilerplate ratio are dropped. Lines travel as MD5 of
host and line, once for each page, and are counted before they are shuffled,
so neither a hot host nor a hot line meets in one task. A host can have
``mean lines a page / ratio`` such lines at most, which bounds the set kept
for a host. The sets are broadcast where their measured size is below
``BROADCAST_LINES``; beyond it they are joined by host, where adaptive
execution splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import SPACE, checkpointed

RATIO = 0.1
MIN_PAGES = 5
BROADCAST_LINES = 200_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _counts(line: Column) -> Column:
    """Whether a line is one that can be boilerplate: it has a word."""
    return ~line.rlike(f"^{SPACE}*$")


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host_key, keys)``: for each host the MD5 keys of its boilerplate lines."""
    pages = docs.select(_host_key(host).alias("host_key"), text.alias("text"))
    totals = pages.groupBy("host_key").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.coalesce("text", F.lit(""))), _counts), lambda x: F.unhex(F.md5(x))))
    counted = pages.select("host_key", F.explode(keys).alias("key")).groupBy("host_key", "key").agg(F.count("*").alias("with_line"))
    frequent = counted.where(F.col("with_line") >= min_pages).join(totals, "host_key").where(F.col("with_line") > F.lit(ratio) * F.col("pages"))
    return frequent.groupBy("host_key").agg(F.collect_set("key").alias("keys"))


def _host_key(host: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), host), F.lit(""))))


def without_boilerplate(docs: DataFrame, host: str | Column = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text_col``.

    A line goes where the host's rows that contain it are ``min_pages`` or
    more and over ``ratio`` of the host's rows. A row counts once however often
    it has the line; repeated rows count each. Lines are compared exactly and
    those without a word always stay. Null hosts form one host. A null text
    stays null, an empty one empty; a text all of whose lines go becomes empty.
    ``counts``: names of two more columns, lines seen and lines dropped. All
    columns of ``docs`` are kept, whatever their names.
    """
    host = F.col(host) if isinstance(host, str) else host
    sets = checkpointed(boilerplate(docs, host, F.col(text_col), ratio, min_pages))
    n = sets.agg(F.sum(F.size("keys"))).first()[0] or 0
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _host_key(host).alias("host_key"), _lines(F.col(text_col)).alias("lines"))
    joined = row.join(F.broadcast(sets) if n <= BROADCAST_LINES else sets, "host_key", "left")
    kept = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~(_counts(x) & F.array_contains("keys", F.unhex(F.md5(x))))))
    done = joined.select("row", "lines", kept.alias("kept"))
    out = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if counts:
        size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
        out += [size("lines").alias(counts[0]), (size("lines") - size("kept")).alias(counts[1])]
    return done.select(*out)
