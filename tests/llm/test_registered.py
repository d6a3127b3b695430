"""The registered queries on the smallest tables, those with SQL against it."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quiltgraph.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")
COLUMNS = {
    "op1_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op2_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op3_sharding": {"doc_id", "n_bytes", "shard", "depth"},
    "op4_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_ppm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op9_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op10_simhash": {"doc_id", "fingerprint", "component_id"},
}


def test_all_are_registered(spark):
    assert set(Q.queries()) == set(COLUMNS) and set(Q.queries()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_sql(spark, name):
    got = Q.queries()[name](spark, FOLDER).toPandas()
    assert COLUMNS[name] <= set(got.columns) and len(got)
    if name not in Q.oracle_sql():
        return
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    want = duck.sql(Q.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)
