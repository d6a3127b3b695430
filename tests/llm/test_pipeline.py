"""The pipeline's stages on planted documents."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quiltgraph.llm.common import BATCH_BYTES, BATCH_SETTING


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(51)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    clean = [text(rng.randint(80, 150)) for _ in range(60)]
    items = [(i, text(30)) for i in range(5)]
    rows = [(i, f"menu home about\n{t}") for i, t in enumerate(clean)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " end"), (102, "few words"), (103, " ".join(w + "***" for w in rng.choices(vocab, k=90)))]
    rows += [(104, text(60) + " " + items[2][1]), (105, text(900) + " " + items[3][1].upper() + ". tail"), (106, None), (107, "")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "src0" if i % 3 else "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages_take_effect(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in P.STAGES[:-1]:
        docs = P.stage_written(stage(spark, docs, path), "test")
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, near, clean = seen
    assert set(quality) == {i for i, _ in rows} - {102, 103, 106, 107}
    assert lines.keys() == quality.keys() and not any("menu" in t for t in lines.values())
    assert set(near) == set(lines) - {100, 101}
    assert set(clean) == set(near) - {104}
    assert items[3][1].upper() not in clean[105] and clean[105].endswith(" . tail") and all(clean[i] == near[i] for i in clean if i != 105)
    ids = P.run(spark, path)
    assert {r.doc_id for r in ids.collect()} == set(clean)


def test_rows_without_an_id_or_with_a_shared_one(spark, folder):
    path, rows, items = folder
    schema = "doc_id long, text string"
    a, b, c = (rows[i][1] for i in (10, 11, 12))
    docs = spark.createDataFrame([(1, a), (None, a), (None, b), (None, b), (None, c), (2, rows[13][1]), (2, rows[14][1])], schema)
    got = sorted((str(r.doc_id), r.text) for r in P.near_duplicates(spark, docs, path).collect())
    assert got == sorted([("1", a), ("None", b), ("None", c), ("2", rows[13][1]), ("2", rows[14][1])])
    dirty = a + " " + items[1][1]
    docs = spark.createDataFrame([(None, dirty), (None, b), (3, dirty), (3, c), (3, a)], schema)
    got = sorted((str(r.doc_id), r.text) for r in P.benchmark_passages(spark, docs, path).collect())
    assert got == sorted([("None", b), ("3", c), ("3", a)])


def test_python_workers_get_small_batches(spark, folder):
    """4,000 rows of 5 KB were two batches of 20 MB; a limit that the session has stays, and rows one by one give the same results."""
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("text IS NOT NULL")
    large = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000 + F.col("id").cast("int") % 2).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    try:
        for stage in (P.near_duplicates, P.benchmark_passages, P.token_ids):
            spark.conf.unset(BATCH_SETTING)
            usual = sorted(map(str, stage(spark, docs, path).collect()))
            found = large.mapInArrow(sizes, "size long, n long").collect()
            assert max(r["size"] for r in found) <= BATCH_BYTES + 10_000 and sum(r["n"] for r in found) == 4000
            spark.conf.set(BATCH_SETTING, "1")
            assert sorted(map(str, stage(spark, docs, path).collect())) == usual
            assert spark.conf.get(BATCH_SETTING) in ("1", "1b")
    finally:
        spark.conf.unset(BATCH_SETTING)
