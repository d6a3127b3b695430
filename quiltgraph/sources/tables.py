"""The test tables as a property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiltgraph.model import PREFIX

NODE_PROPS = {"name": "string", "mktsegment": "string", "acctbal": "double", "brand": "string", "ptype": "string", "size": "bigint", "price": "double", "status": "string"}
EDGE_PROPS = {"quantity": "double", "discount": "double", "priority": "string"}
#: The columns that the graph needs, so that opening a table reads no file.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, user_id bigint, event_type string, value double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}
LABEL_KEYS = ("Customer;Party", "Party;Supplier", "Part", "Order", "Nation", "Region", "Event")


def opened(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _named(letter: str, column: str) -> Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def _props(known: dict[str, str], given: dict[str, str]) -> list[Column]:
    return [(F.col(given[p]).cast(t) if p in given else F.lit(None).cast(t)).alias(PREFIX + p) for p, t in known.items()]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch for each table; its label key is a literal, so a label test leaves only the branches it needs."""
    parts = [
        ("customer", "c", "c_custkey", LABEL_KEYS[0], {"name": "c_name", "mktsegment": "c_mktsegment", "acctbal": "c_acctbal"}),
        ("supplier", "s", "s_suppkey", LABEL_KEYS[1], {"name": "s_name", "acctbal": "s_acctbal"}),
        ("part", "p", "p_partkey", LABEL_KEYS[2], {"name": "p_name", "brand": "p_brand", "ptype": "p_type", "size": "p_size", "price": "p_retailprice"}),
        ("orders", "o", "o_orderkey", LABEL_KEYS[3], {"price": "o_totalprice", "status": "o_orderstatus"}),
        ("nation", "n", "n_nationkey", LABEL_KEYS[4], {"name": "n_name"}),
        ("region", "r", "r_regionkey", LABEL_KEYS[5], {"name": "r_name"}),
        ("events", "e", "event_id", LABEL_KEYS[6], {"name": "event_type", "price": "value"}),
    ]

    def branch(table: str, letter: str, key: str, label_key: str, given: dict[str, str]) -> DataFrame:
        labels = F.array(*map(F.lit, label_key.split(";")))
        return opened(spark, sf_dir, table).select(_named(letter, key).alias("id"), labels.alias("labels"), F.lit(label_key).alias("label_key"), *_props(NODE_PROPS, given))

    return reduce(DataFrame.unionAll, [branch(*p) for p in parts])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch for each relationship, with its type as a literal. Line items have no key, so equal ones are numbered."""
    read = {t: opened(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier", "nation", "events")}

    def branch(table: DataFrame, id_: Column, src: Column, dst: Column, kind: str, given: dict[str, str] | None = None) -> DataFrame:
        return table.select(id_.alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), *_props(EDGE_PROPS, given or {}))

    # What queries filter on is in the key, so that filters go below the numbering.
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"]
    rest = ["l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = read["lineitem"].select(*key, *rest, F.row_number().over(W.partitionBy(*key).orderBy(*rest)).alias("k"))
    line_id = F.concat(F.lit("li"), F.concat_ws("-", *[F.col(c).cast("string") for c in (*key, "k")]))
    pairs = read["lineitem"].select("l_suppkey", "l_partkey").distinct()
    square = ((F.col("n_nationkey") * F.col("n_nationkey")) % 25).cast("string")
    return reduce(
        DataFrame.unionAll,
        [
            branch(read["orders"], _named("pl", "o_orderkey"), _named("c", "o_custkey"), _named("o", "o_orderkey"), "PLACED", {"priority": "o_orderpriority"}),
            branch(lines, line_id, _named("o", "l_orderkey"), _named("p", "l_partkey"), "CONTAINS", {"quantity": "l_quantity", "discount": "l_discount"}),
            branch(pairs, F.concat(F.lit("su"), F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))), _named("s", "l_suppkey"), _named("p", "l_partkey"), "SUPPLIES"),
            branch(read["customer"], _named("cn", "c_custkey"), _named("c", "c_custkey"), _named("n", "c_nationkey"), "LOCATED_IN"),
            branch(read["supplier"], _named("sn", "s_suppkey"), _named("s", "s_suppkey"), _named("n", "s_nationkey"), "LOCATED_IN"),
            branch(read["nation"], _named("nr", "n_nationkey"), _named("n", "n_nationkey"), _named("r", "n_regionkey"), "PART_OF"),
            branch(read["nation"], _named("ln", "n_nationkey"), _named("n", "n_nationkey"), F.concat(F.lit("n"), square), "LINKS"),
            branch(read["events"], _named("ev", "event_id"), _named("c", "user_id"), _named("e", "event_id"), "PERFORMED", {"quantity": "value", "priority": "event_type"}),
        ],
    )
