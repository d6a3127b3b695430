"""The test tables' graph, its queries against their SQL, and the entry module."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quiltgraph import queries as Q

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 9) if isinstance(x, int | float) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return connection


#: One query of each family; the whole list runs in the driver's check.
@pytest.mark.parametrize("name", ["node_one_of_two_labels", "node_in_null", "order_desc_nulls", "distinct_order_unprojected", "rel_prop_range", "anchored_any", "three_hop_mixed", "chain_reverse_bound", "chain_late_join", "bfs_depth3", "subgraph_full", "delete_node_cascade", "gen_deep"])
def test_query_matches_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, FOLDER).toPandas(), duck.sql(Q.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(str([cell(x) for x in r]) for r in df[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_generated_counts(spark):
    assert [Q.queries()[k](spark, FOLDER).first().n for k in ("gen_neighbors", "gen_typed_path", "gen_deep", "gen_star")] == [17, 125, 105, 500_000]


def test_every_end_exists(spark):
    g = Q.graph(spark, FOLDER)
    assert g.validate() and g.nodes.select("id").distinct().count() == g.nodes.count() and g.edges.select("id").distinct().count() == g.edges.count()


def test_entry(spark):
    assert entry.entry(spark).count() == 51
    assert set(Q.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
