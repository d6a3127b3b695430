"""Extendible hashing against splitting bucket by bucket."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltgraph.llm import sharding as S


def slow(rows, limit):
    done, open_ = {}, [("", rows)]
    while open_:
        prefix, bucket = open_.pop()
        if not bucket:
            continue
        if sum(s for _, s in bucket) <= limit or len(bucket) == 1 or len(prefix) == 128:
            done[prefix] = (sum(s for _, s in bucket), len(bucket))
        else:
            open_ += [(prefix + b, [r for r in bucket if r[0][len(prefix)] == b]) for b in "01"]
    return done


def test_directory(spark):
    sizes = spark.range(300).select(S.key_bits(F.col("id")).alias("bits"), F.when(F.col("id") % 50 == 0, 900).otherwise(F.col("id") % 9).alias("size"))
    rows = [(r.bits, r["size"]) for r in sizes.collect()]
    for limit, step in ((100, 2), (10, 3), (100000, 12), (30, 12)):
        got = {r.prefix: (r.bytes, r.rows) for r in S.directory(sizes, limit, step).collect()}
        assert got == slow(rows, limit)


def test_equal_rows_part_and_none_is_lost(spark, tmp_path):
    rows = [(1, "same", "x", "old")] * 100 + [(2, None, "y", "old"), (None, "", "z", "old"), (3, "w" * 5000, "w", "old")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, prefix string, shard string").write.parquet(path)
    docs = spark.read.parquet(path)
    got = S.sharded(docs, F.octet_length("text"), F.col("doc_id"), limit=40).collect()
    assert sorted((str(r.doc_id), r.text or "", r.prefix) for r in got) == sorted((str(a), b or "", c) for a, b, c, _ in rows)
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(len(r.text or ""))
    assert all(sum(x) <= 40 or len(x) == 1 for x in held.values())
    S.written(S.sharded(docs, F.octet_length("text"), F.col("doc_id"), limit=1000), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_order_of_the_input_loses_no_row(spark):
    rows = [(i % 7, f"text {i % 11}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).orderBy(F.rand())
    got = S.sharded(docs, F.octet_length("text"), F.col("doc_id"), limit=60).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows) and all(r.shard for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, n long")
    assert S.sharded(docs, F.col("n"), F.col("doc_id")).columns == ["doc_id", "n", "shard"]
