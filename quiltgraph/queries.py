"""The graph queries over the test tables, each with its SQL.

Every query runs on the graph of ``sources.tables`` unless its name starts
with ``gen_``; its SQL reads the same tables under ``ORACLE_PREFIX``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.graph import PropertyGraph
from quiltgraph.model import PREFIX, Edge, Node
from quiltgraph.sources import ingest, tables

Query = Callable[[SparkSession, str], DataFrame]

ORACLE_PREFIX = """WITH RECURSIVE nodes AS (
SELECT concat('c', CAST(c_custkey AS STRING)) AS id, 'Customer;Party' AS label_key, c_name AS name, c_mktsegment AS mktsegment, c_acctbal AS acctbal,
  CAST(NULL AS STRING) AS brand, CAST(NULL AS STRING) AS ptype, CAST(NULL AS BIGINT) AS size, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS STRING) AS status FROM customer
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 'Party;Supplier', s_name, NULL, s_acctbal, NULL, NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 'Part', p_name, NULL, NULL, p_brand, p_type, CAST(p_size AS BIGINT), p_retailprice, NULL FROM part
UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), 'Order', NULL, NULL, NULL, NULL, NULL, NULL, o_totalprice, o_orderstatus FROM orders
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), 'Nation', n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), 'Region', r_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region
UNION ALL SELECT concat('e', CAST(event_id AS STRING)), 'Event', event_type, NULL, NULL, NULL, NULL, NULL, value, NULL FROM events),
edges AS (
SELECT concat('pl', CAST(o_orderkey AS STRING)) AS id, concat('c', CAST(o_custkey AS STRING)) AS src, concat('o', CAST(o_orderkey AS STRING)) AS dst, 'PLACED' AS type,
  CAST(NULL AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS discount, o_orderpriority AS priority FROM orders
UNION ALL SELECT concat('li', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_quantity AS STRING), '-', CAST(l_discount AS STRING), '-',
  CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount ORDER BY l_extendedprice, l_tax, l_returnflag, l_linestatus, l_shipdate) AS STRING)),
  concat('o', CAST(l_orderkey AS STRING)), concat('p', CAST(l_partkey AS STRING)), 'CONTAINS', l_quantity, l_discount, NULL FROM lineitem
UNION ALL SELECT concat('su', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)), concat('s', CAST(l_suppkey AS STRING)), concat('p', CAST(l_partkey AS STRING)), 'SUPPLIES', NULL, NULL, NULL
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) d
UNION ALL SELECT concat('cn', CAST(c_custkey AS STRING)), concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), 'LOCATED_IN', NULL, NULL, NULL FROM customer
UNION ALL SELECT concat('sn', CAST(s_suppkey AS STRING)), concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), 'LOCATED_IN', NULL, NULL, NULL FROM supplier
UNION ALL SELECT concat('nr', CAST(n_nationkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), 'PART_OF', NULL, NULL, NULL FROM nation
UNION ALL SELECT concat('ln', CAST(n_nationkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)), concat('n', CAST((n_nationkey * n_nationkey) % 25 AS STRING)), 'LINKS', NULL, NULL, NULL FROM nation
UNION ALL SELECT concat('ev', CAST(event_id AS STRING)), concat('c', CAST(user_id AS STRING)), concat('e', CAST(event_id AS STRING)), 'PERFORMED', value, NULL, event_type FROM events),
links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)
"""

#: Line items with the id of their relationship.
LINES = """WITH lines AS (SELECT *, concat('li', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_quantity AS STRING), '-', CAST(l_discount AS STRING), '-',
  CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount ORDER BY l_extendedprice, l_tax, l_returnflag, l_linestatus, l_shipdate) AS STRING)) AS lid FROM lineitem) """

#: Name: (query text, parameters, SQL over nodes and edges, or over the tables themselves where it starts with WITH or a comment).
CYPHER: dict[str, tuple[str, dict, str]] = {
    "node_all_scan": ("MATCH (n) RETURN n.id AS id", {}, "SELECT id FROM nodes"),
    "node_label_scan": ("MATCH (n:Customer) RETURN n.id AS id, n.name AS name", {}, "SELECT id, name FROM nodes WHERE label_key = 'Customer;Party'"),
    "node_multi_label": ("MATCH (n:Party:Customer) RETURN n.id AS id", {}, "SELECT id FROM nodes WHERE label_key = 'Customer;Party'"),
    "node_one_of_two_labels": ("MATCH (n:Party) RETURN n.id AS id, n.acctbal AS acctbal", {}, "SELECT id, acctbal FROM nodes WHERE label_key LIKE '%Party%'"),
    "node_inline_prop": ('MATCH (n:Customer {mktsegment: "BUILDING"}) RETURN n.id AS id', {}, "SELECT id FROM nodes WHERE label_key = 'Customer;Party' AND mktsegment = 'BUILDING'"),
    "node_range": ("MATCH (n:Part) WHERE n.size >= 10 AND n.size < 20 RETURN n.id AS id", {}, "SELECT id FROM nodes WHERE label_key = 'Part' AND size >= 10 AND size < 20"),
    "node_in_param": ("MATCH (n:Part) WHERE n.brand IN $brands RETURN n.id AS id, n.brand AS brand", {"brands": ["Brand#11", "Brand#23", "Brand#1"]}, "SELECT id, brand FROM nodes WHERE brand IN ('Brand#11', 'Brand#23', 'Brand#1')"),
    "node_in_null": ("MATCH (n:Party) WHERE n.mktsegment IN ['BUILDING', None] RETURN n.id AS id", {}, "SELECT id FROM nodes WHERE label_key LIKE '%Party%' AND (mktsegment = 'BUILDING' OR mktsegment IS NULL)"),
    "node_ne_missing": ('MATCH (n) WHERE n.mktsegment <> "BUILDING" RETURN n.id AS id', {}, "SELECT id FROM nodes WHERE mktsegment IS DISTINCT FROM 'BUILDING'"),
    "node_is_null": ("MATCH (n) WHERE n.mktsegment IS NULL RETURN n.id AS id", {}, "SELECT id FROM nodes WHERE mktsegment IS NULL"),
    "node_is_not_null": ("MATCH (n) WHERE n.mktsegment IS NOT NULL RETURN n.id AS id", {}, "SELECT id FROM nodes WHERE mktsegment IS NOT NULL"),
    "node_eq_null": ("MATCH (n {mktsegment: null}) RETURN n.id AS id", {}, "SELECT id FROM nodes WHERE mktsegment IS NULL"),
    "node_other_kind": ('MATCH (n:Part) WHERE n.size <> "10" RETURN n.id AS id', {}, "SELECT id FROM nodes WHERE label_key = 'Part'"),
    "node_id_seek": ("MATCH (n) WHERE n.id = 'c7' RETURN n.id AS id, n.name AS name", {}, "SELECT id, name FROM nodes WHERE id = 'c7'"),
    "node_id_property": ("MATCH (n {id: 'c7'}) RETURN n.id AS id", {}, "SELECT id FROM nodes WHERE false"),
    "node_unknown_property": ("MATCH (n:Nation) RETURN n.id AS id, n.nothing AS nothing", {}, "SELECT id, CAST(NULL AS VARCHAR) AS nothing FROM nodes WHERE label_key = 'Nation'"),
    "limit_zero": ("MATCH (n) RETURN n.id AS id LIMIT 0", {}, "SELECT id FROM nodes LIMIT 0"),
    "order_desc_nulls": ("MATCH (n:Party) RETURN n.id AS id, n.mktsegment AS seg ORDER BY n.mktsegment DESC, n.id LIMIT 120", {}, "SELECT id, mktsegment AS seg FROM nodes WHERE label_key LIKE '%Party%' ORDER BY mktsegment DESC NULLS FIRST, id LIMIT 120"),
    "order_skip_limit": ("MATCH (n:Part) RETURN n.id AS id, n.price AS price ORDER BY n.price DESC, n.id ASC SKIP 5 LIMIT 20", {}, "SELECT id, price FROM nodes WHERE label_key = 'Part' ORDER BY price DESC, id OFFSET 5 LIMIT 20"),
    "order_alias": ("MATCH (n:Part) RETURN n.name AS name, n.id AS id ORDER BY name, id LIMIT 10", {}, "SELECT name, id FROM nodes WHERE label_key = 'Part' ORDER BY name, id LIMIT 10"),
    "return_distinct": ("MATCH (n) RETURN DISTINCT n.mktsegment AS seg", {}, "SELECT DISTINCT mktsegment AS seg FROM nodes"),
    "distinct_order_unprojected": ("MATCH (n:Part) RETURN DISTINCT n.brand AS brand ORDER BY n.price DESC LIMIT 5", {}, "SELECT brand FROM (SELECT brand, row_number() OVER (ORDER BY price DESC, id) AS place FROM nodes WHERE label_key = 'Part') GROUP BY brand ORDER BY min(place) LIMIT 5"),
    "rel_scan": ("MATCH (a)-[r:PLACED]->(b) RETURN r.id AS rid, a.id AS aid, b.id AS bid", {}, "SELECT id AS rid, src AS aid, dst AS bid FROM edges WHERE type = 'PLACED'"),
    "rel_scan_reverse": ("MATCH (b)<-[r:PLACED]-(a) RETURN r.id AS rid, a.id AS aid, b.id AS bid", {}, "SELECT id AS rid, src AS aid, dst AS bid FROM edges WHERE type = 'PLACED'"),
    "rel_type_alt": ("MATCH (a)-[r:PLACED|PERFORMED|PLACED]->(b) RETURN r.id AS rid, r.type AS kind", {}, "SELECT id AS rid, type AS kind FROM edges WHERE type IN ('PLACED', 'PERFORMED')"),
    "rel_ends": ("MATCH (a)-[r:PART_OF]->(b) RETURN r.source AS s, r.target AS t, b.name AS name", {}, "SELECT src AS s, dst AS t, name FROM edges JOIN nodes ON dst = nodes.id WHERE type = 'PART_OF'"),
    "rel_prop_eq": ("MATCH (a)-[r:CONTAINS]->(b) WHERE r.quantity = 10 RETURN r.id AS rid", {}, "SELECT id AS rid FROM edges WHERE type = 'CONTAINS' AND quantity = 10"),
    "rel_prop_range": ("MATCH (a)-[r:CONTAINS]->(b) WHERE r.discount >= 0.05 AND r.discount < 0.08 RETURN r.id AS rid, b.brand AS brand", {}, "SELECT edges.id AS rid, brand FROM edges JOIN nodes ON dst = nodes.id WHERE type = 'CONTAINS' AND discount >= 0.05 AND discount < 0.08"),
    "self_loop_same_var": ("MATCH (a)-[r:LINKS]->(a) RETURN a.id AS id, r.id AS rid", {}, "SELECT src AS id, id AS rid FROM edges WHERE type = 'LINKS' AND src = dst"),
    "anchored_out": ('MATCH (c {id: "c7"})-[:PLACED]->(o) RETURN o.id AS oid, o.price AS price', {}, "SELECT nodes.id AS oid, price FROM edges JOIN nodes ON dst = nodes.id WHERE src = 'c7' AND type = 'PLACED'"),
    "anchored_in": ('MATCH (n {id: "n3"})<-[:LOCATED_IN]-(x) RETURN x.id AS id', {}, "SELECT src AS id FROM edges WHERE dst = 'n3' AND type = 'LOCATED_IN'"),
    "anchored_any": ('MATCH (n {id: "n0"})-[r:LINKS]-(x) RETURN x.id AS id, r.id AS rid', {}, "SELECT dst AS id, id AS rid FROM edges WHERE src = 'n0' AND type = 'LINKS' UNION ALL SELECT src, id FROM edges WHERE dst = 'n0' AND type = 'LINKS'"),
    "anchored_missing": ('MATCH (n {id: "zz"})-[:LINKS]->(x) RETURN x.id AS id', {}, "SELECT id FROM nodes WHERE false"),
    "two_hop": ('MATCH (c {id: "c7"})-[:PLACED]->(o)-[l:CONTAINS]->(p) RETURN o.id AS oid, p.id AS pid, l.quantity AS quantity', {}, "/* tables */ SELECT concat('o', CAST(o_orderkey AS STRING)) AS oid, concat('p', CAST(l_partkey AS STRING)) AS pid, l_quantity AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7"),
    "three_hop_mixed": ('MATCH (c {id: "c7"})-[:PLACED]->(o)-[:CONTAINS]->(p)<-[:SUPPLIES]-(s) RETURN p.id AS pid, s.id AS sid', {}, "/* tables */ SELECT concat('p', CAST(l.l_partkey AS STRING)) AS pid, concat('s', CAST(s.l_suppkey AS STRING)) AS sid FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) s ON s.l_partkey = l.l_partkey WHERE o_custkey = 7"),
    "two_hop_limit": ('MATCH (c {id: "c7"})-[:PLACED]->(o)-[l:CONTAINS]->(p) RETURN l.id AS lid, p.id AS pid ORDER BY l.id LIMIT 7', {}, "SELECT l.id AS lid, l.dst AS pid FROM edges h JOIN edges l ON l.src = h.dst WHERE h.src = 'c7' AND h.type = 'PLACED' AND l.type = 'CONTAINS' ORDER BY l.id LIMIT 7"),
    "cycle_reuse": ('MATCH (a {id: "n24"})-[:LINKS]->(b)-[:LINKS]->(b) RETURN b.id AS id', {}, "SELECT h.dst AS id FROM edges h JOIN edges k ON k.src = h.dst AND k.dst = h.dst WHERE h.src = 'n24' AND h.type = 'LINKS' AND k.type = 'LINKS'"),
    "edge_reuse": ('MATCH (a {id: "n1"})-[r:LINKS]->(b)-[r:LINKS]->(c) RETURN c.id AS id', {}, "/* tables */ SELECT concat('n', CAST((n_nationkey * n_nationkey) % 25 AS STRING)) AS id FROM nation WHERE n_nationkey = 1 AND (n_nationkey * n_nationkey) % 25 = n_nationkey"),
    "edge_twice": ('MATCH (a {id: "n24"})-[r:LINKS]->(b)<-[s:LINKS]-(c) RETURN r.id AS rid, s.id AS sid', {}, "/* tables */ SELECT 'ln24' AS rid, concat('ln', CAST(n_nationkey AS STRING)) AS sid FROM nation WHERE (n_nationkey * n_nationkey) % 25 = 1"),
    "chain_disjoint": ('MATCH (a)-[p:PART_OF]->(b) MATCH (x {id: "n7"})-[q:LINKS]->(y) RETURN p.id AS pid, q.id AS qid, b.name AS region', {}, "/* tables */ SELECT concat('nr', CAST(n_nationkey AS STRING)) AS pid, 'ln7' AS qid, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "return_default_names": ("MATCH (a)-[r:PART_OF]->(b) RETURN a.id, r.id, b.name", {}, """/* tables */ SELECT concat('n', CAST(n_nationkey AS STRING)) AS "a.id", concat('nr', CAST(n_nationkey AS STRING)) AS "r.id", r_name AS "b.name" FROM nation JOIN region ON r_regionkey = n_regionkey"""),
    "all_seeds_two_hop": ("MATCH (c)-[:PLACED]->(o) MATCH (o)-[l:CONTAINS]->(p) RETURN c.id AS cid, l.id AS lid, p.brand AS brand", {}, LINES + "SELECT concat('c', CAST(o_custkey AS STRING)) AS cid, lid, p_brand AS brand FROM orders JOIN lines ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"),
    "chain_shared": ('MATCH (c:Customer {mktsegment: "BUILDING"}) MATCH (c)-[r:PLACED]->(o) WHERE o.price > 100000 RETURN c.id AS cid, o.id AS oid, r.priority AS priority', {}, "SELECT src AS cid, dst AS oid, priority FROM edges JOIN nodes c ON src = c.id JOIN nodes o ON dst = o.id WHERE type = 'PLACED' AND c.mktsegment = 'BUILDING' AND o.price > 100000"),
    "chain_target_bound": ('MATCH (o:Order {status: "F"}) MATCH (c)-[:PLACED]->(o) RETURN c.id AS cid, o.id AS oid', {}, "SELECT src AS cid, dst AS oid FROM edges JOIN nodes ON dst = nodes.id WHERE type = 'PLACED' AND status = 'F'"),
    "chain_both_bound": ("MATCH (a)-[:LINKS]->(b) MATCH (b)-[:LINKS]->(a) RETURN a.id AS aid, b.id AS bid", {}, "SELECT h.src AS aid, h.dst AS bid FROM edges h JOIN edges k ON k.src = h.dst AND k.dst = h.src WHERE h.type = 'LINKS' AND k.type = 'LINKS'"),
    "chain_reverse_bound": ("MATCH (n:Nation) MATCH (n)<-[:LOCATED_IN]-(x) WHERE n.name IS NOT NULL RETURN n.id AS nid, x.id AS xid", {}, "SELECT dst AS nid, src AS xid FROM edges WHERE type = 'LOCATED_IN'"),
    "chain_late_join": ("MATCH (c:Customer) MATCH (n:Nation) MATCH (c)-[:LOCATED_IN]->(n) RETURN c.id AS cid, n.name AS nation", {}, "SELECT src AS cid, n.name AS nation FROM edges JOIN nodes c ON src = c.id JOIN nodes n ON dst = n.id WHERE type = 'LOCATED_IN' AND c.label_key = 'Customer;Party'"),
    "chain_cross": ("MATCH (r:Region) MATCH (n:Nation) RETURN r.id AS rid, n.id AS nid", {}, "SELECT r.id AS rid, n.id AS nid FROM nodes r CROSS JOIN nodes n WHERE r.label_key = 'Region' AND n.label_key = 'Nation'"),
    "chain_anchored": ('MATCH (c:Customer) MATCH (c {id: "c7"})-[r:PLACED]->(o) RETURN c.id AS cid, r.id AS rid, o.id AS oid', {}, "SELECT src AS cid, id AS rid, dst AS oid FROM edges WHERE src = 'c7' AND type = 'PLACED'"),
}


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The test tables' graph. Every end exists there (see ``tests/test_tables.py``)."""
    return PropertyGraph(spark, tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), label_keys=tables.LABEL_KEYS, whole=True)


def _cypher(text: str, parameters: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).query(text, parameters).df


def _api(use: Callable[[PropertyGraph], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return use(graph(spark, sf_dir))


def _flat(df: DataFrame, entity: str) -> DataFrame:
    return df.select(f"{entity}.id", F.array_join(f"{entity}.labels", ",").alias("labels"), f"{entity}.properties.name")


def _starred(df: DataFrame) -> DataFrame:
    return df.select(F.col("a.id").alias("a"), F.col("r.id").alias("r"), F.col("b.id").alias("b"), F.col("r.properties.type").alias("kind"), F.col("b.properties.name").alias("name"))


def _node_got(g: PropertyGraph) -> DataFrame:
    n = g.get_node("c7")
    found = [(n.id, ",".join(sorted(n.labels)), n.properties["name"], n.properties["acctbal"])] if n and g.get_node("nobody") is None else []
    return g.spark.createDataFrame(found, "id string, labels string, name string, acctbal double")


def _nodes_got(g: PropertyGraph) -> DataFrame:
    found = [(k, n and n.id, n and n.properties["name"]) for k, n in enumerate(g.get_nodes(["r1", "nobody", "n3", "r1"]))]
    return g.spark.createDataFrame(found, "place int, id string, name string")


def _edge_got(g: PropertyGraph) -> DataFrame:
    e = g.get_edge("pl7")
    found = [(e.id, e.source, e.target, e.type, e.properties["priority"])] if e and g.get_edge("nothing") is None else []
    return g.spark.createDataFrame(found, "id string, source string, target string, type string, priority string")


def _indexed(g: PropertyGraph) -> DataFrame:
    for name in ("brand", "size"):
        g.create_node_property_index(name)
    g.create_edge_property_index("discount")
    return g.spark.createDataFrame([(k, n) for k, names in g.index_statistics().items() for n in names], "what string, name string")


def _called(g: PropertyGraph) -> DataFrame:
    df = g.query("CALL pg.sample_typed_paths(['c7', 'none'], [{'edge_type': 'PLACED', 'sample_size': 1000}, {'edge_type': 'CONTAINS', 'sample_size': 1000}]) YIELD path RETURN path").df
    return df.select("path.seed", F.element_at("path.path", 1)["edge_id"].alias("first"), F.element_at("path.path", 2)["edge_id"].alias("second"))


def _nodes_put(g: PropertyGraph) -> DataFrame:
    g.put_nodes([Node("r0", {"name": "first"}, ("Region",)), Node("r9", {"name": "new"}, ("Region",)), Node("r0", {"name": "renamed"}, ("Region",))])
    g.put_node(Node("r8", {"name": "one"}, ("Region",)))
    return g.query("MATCH (n:Region) RETURN n.id AS id, n.name AS name").df


def _edge_put(g: PropertyGraph) -> DataFrame:
    g.put_edge(Edge("n1", "n2", "mine", {"type": "PART_OF"}))
    return g.find_edges_by_type("PART_OF").select("id", "src", "dst")


def _edge_deleted(g: PropertyGraph) -> DataFrame:
    g.delete_edge("ln5")
    return g.find_edges_by_type("LINKS").select("id")


def _updated(g: PropertyGraph) -> DataFrame:
    g.update_node("n3", {"price": 2.5})
    g.update_edge("ln3", {"quantity": 4.0}, lambda old, new: old | {"quantity": 5.0 + new["quantity"]})
    again, same = g.get_node("n3"), g.get_edge("ln3")
    found = [(again.id, again.properties["name"], again.properties["price"]), (same.id, same.type, same.properties["quantity"])]
    return g.spark.createDataFrame(found, "id string, name string, price double")


def _rolled_back(g: PropertyGraph) -> DataFrame:
    with g.transaction() as t:
        t.put_node(Node("kept", {}, ("Region",)))
    try:
        with g.transaction() as t:
            t.put_node(Node("lost", {}, ("Region",)))
            t.delete_node("r1")
            raise LookupError("undo")
    except LookupError:
        pass
    return g.find_nodes_by_label("Region").select("id")


def _nations(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Nations as node columns, and where they are as edge columns."""
    links = g.find_edges_by_type("PART_OF")
    return g.find_nodes_by_label("Nation").select(F.col("id").alias("node_id"), "labels", F.col(PREFIX + "name").alias("name")), links.select(F.col("id").alias("edge_id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type").alias("edge_type"))


def _ingested_columns(g: PropertyGraph) -> DataFrame:
    nodes, edges = _nations(g)
    made = PropertyGraph(g.spark)
    made.ingest_nodes_arrow_entities(nodes)
    made.ingest_nodes_arrow_entities(nodes, append_only=False)  # replaced by id, so none is doubled
    made.ingest_edges_arrow_entities(edges)
    return made.nodes.join(made.edges, F.col("src") == made.nodes["id"]).select(made.nodes["id"], F.col("dst").alias("other"), F.col(PREFIX + "name").alias("name"))


def _ingested_payloads(g: PropertyGraph) -> DataFrame:
    regions = [Node(r.id, {"name": r["name"]}, ("Region",)) for r in g.query("MATCH (n:Region) RETURN n.id AS id, n.name AS name").df.collect()]
    made = PropertyGraph(g.spark)
    rows = [(n.id, bytearray(ingest.payload(n))) for n in regions]
    made.ingest_nodes_arrow(g.spark.createDataFrame(rows, "node_id string, node_value binary"))
    return made.nodes.select("id", F.col(PREFIX + "name").alias("name"), F.col("label_key").alias("label"))


def _deferred(g: PropertyGraph) -> DataFrame:
    made = PropertyGraph(g.spark)
    made.create_node_property_index("name")
    first = made.ingest_arrow(*_nations(g), index_mode="defer")
    rebuilt = made.rebuild_deferred_indexes()
    return _counts(g.spark, [("nodes", first["nodes"]), ("edges", first["edges"]), ("stale", len(first["stale_indexes"])), *rebuilt.items()])


def _counts(spark: SparkSession, entries: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(entries, "what string, n long")


def _deleted(g: PropertyGraph) -> DataFrame:
    g.delete_node("n3")
    return g.nodes.where(F.array_contains("labels", "Nation")).select("id").unionAll(g.edges.where(F.col("type").isin("LOCATED_IN", "LINKS", "PART_OF")).select("id"))


def _upserted(g: PropertyGraph) -> DataFrame:
    g.put_edges_bulk([Edge("n1", "n2", "ln3", {"type": "LINKS"}), Edge("n9", "n9", "new", {"type": "LINKS"})])
    return g.edges.where("type = 'LINKS'").select("id", "src", "dst")


def _paths(g: PropertyGraph) -> DataFrame:
    pattern = [{"edge_type": "PLACED", "sample_size": 1000}, {"edge_type": "CONTAINS", "sample_size": 1000}]
    return g.sample_typed_paths(["c7", "c8", "c7", "none"], pattern).select("seed", F.element_at("path", 1)["edge_id"].alias("first"), F.element_at("path", 2)["edge_id"].alias("second"))


def _subgraph(g: PropertyGraph) -> DataFrame:
    made = g.sample_typed_subgraph(["c7", "none"], [{"edge_type": "PLACED", "sample_size": 1000}])
    return made["nodes"].select(F.lit("node").alias("what"), "id", F.col("label_key").isNotNull().alias("found")).unionAll(made["edges"].select(F.lit("edge"), "id", F.col("type").isNotNull()))


def _rebuilt(g: PropertyGraph) -> DataFrame:
    return _counts(g.spark, [("labels", g.rebuild_label_index()), ("types", g.rebuild_relationship_type_index()), ("brand", g.create_node_property_index("brand")), ("discount", g.create_edge_property_index("discount"))])


def _lookup_counts(g: PropertyGraph) -> DataFrame:
    return _counts(g.spark, [("label", g.count_nodes_by_label("Party")), ("property", g.count_nodes_by_property("mktsegment", "BUILDING")), ("type", g.count_edges_by_type("CONTAINS")), ("range", g.count_edges_by_type_property_range("CONTAINS", "quantity", 10, 20, False, True))])


#: Name: (what to do with the graph, SQL over nodes and edges).
API: dict[str, tuple[Callable[[PropertyGraph], DataFrame], str]] = {
    "api_nodes_by_property": (lambda g: g.find_nodes_by_property("mktsegment", "BUILDING").select("id"), "SELECT id FROM nodes WHERE mktsegment = 'BUILDING'"),
    "api_nodes_by_label_property": (lambda g: g.find_nodes_by_label_property("Customer", "mktsegment", "BUILDING").select("id"), "SELECT id FROM nodes WHERE mktsegment = 'BUILDING'"),
    "api_range": (lambda g: g.find_nodes_by_label_property_range("Part", "size", 5, None, include_start=False).select("id"), "SELECT id FROM nodes WHERE size > 5"),
    "api_range_mixed_bounds": (lambda g: g.find_nodes_by_property_range("size", 5, "z").select("id"), "SELECT id FROM nodes WHERE false"),
    "api_nodes_by_range": (lambda g: g.find_nodes_by_property_range("price", 1000, 1500, include_end=False).select("id", "label_key"), "SELECT id, label_key FROM nodes WHERE price >= 1000 AND price < 1500"),
    "api_edges_by_property": (lambda g: g.find_edges_by_property("priority", "1-URGENT").select("id", "type"), "SELECT id, type FROM edges WHERE priority = '1-URGENT'"),
    "api_get_node": (_node_got, "/* tables */ SELECT concat('c', CAST(c_custkey AS STRING)) AS id, 'Customer,Party' AS labels, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_custkey = 7"),
    "api_get_nodes": (_nodes_got, "/* tables */ SELECT 0 AS place, 'r1' AS id, r_name AS name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 1, NULL, NULL UNION ALL SELECT 2, 'n3', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 3, 'r1', r_name FROM region WHERE r_regionkey = 1"),
    "api_get_edge": (_edge_got, "/* tables */ SELECT concat('pl', CAST(o_orderkey AS STRING)) AS id, concat('c', CAST(o_custkey AS STRING)) AS source, concat('o', CAST(o_orderkey AS STRING)) AS target, 'PLACED' AS type, o_orderpriority AS priority FROM orders WHERE o_orderkey = 7"),
    "api_node_keys": (lambda g: g.spark.createDataFrame([(i,) for i in g.get_node_keys_generator(25, "o5")], "id string"), "SELECT id FROM nodes WHERE id >= 'o5' ORDER BY id LIMIT 25"),
    "api_edge_keys": (lambda g: g.spark.createDataFrame([(i,) for i in g.get_edge_keys_generator(25, "pl2")], "id string"), "SELECT id FROM edges WHERE id >= 'pl2' ORDER BY id LIMIT 25"),
    "api_range_nodes": (lambda g: g.spark.createDataFrame([(n.id,) for n in g.range_query_nodes("size", 48, 50)], "id string"), "SELECT id FROM nodes WHERE size >= 48 AND size <= 50"),
    "api_neighbors_by_type": (lambda g: g.spark.createDataFrame([(i,) for i in g.neighbors_by_edge_type("n1", "LINKS", "in")], "id string"), "SELECT src AS id FROM edges WHERE dst = 'n1' AND type = 'LINKS'"),
    "api_edges_at_node": (lambda g: g.spark.createDataFrame([(i,) for i in g.edges_by_edge_type("n1", "LINKS", "any")], "id string"), "SELECT id FROM edges WHERE src = 'n1' AND type = 'LINKS' UNION ALL SELECT id FROM edges WHERE dst = 'n1' AND type = 'LINKS'"),
    "api_index_statistics": (_indexed, "/* tables */ SELECT 'node_properties' AS what, 'brand' AS name UNION ALL SELECT 'node_properties', 'size' UNION ALL SELECT 'edge_properties', 'discount'"),
    "return_entity": (lambda g: _flat(g.query("MATCH (n:Nation) RETURN n").df, "n"), "SELECT id, 'Nation' AS labels, name FROM nodes WHERE label_key = 'Nation'"),
    "return_star": (lambda g: _starred(g.query("MATCH (b)<-[r:PART_OF]-(a) RETURN *").df), "SELECT src AS a, edges.id AS r, dst AS b, type AS kind, name FROM edges JOIN nodes ON dst = nodes.id WHERE type = 'PART_OF'"),
    "call_sample_paths": (_called, LINES + "SELECT 'c7' AS seed, concat('pl', CAST(o_orderkey AS STRING)) AS first, lid AS second FROM orders JOIN lines ON l_orderkey = o_orderkey WHERE o_custkey = 7"),
    "put_nodes": (_nodes_put, "SELECT id, name FROM nodes WHERE label_key = 'Region' AND id <> 'r0' UNION ALL SELECT 'r0', 'renamed' UNION ALL SELECT 'r9', 'new' UNION ALL SELECT 'r8', 'one'"),
    "put_edge": (_edge_put, "SELECT id, src, dst FROM edges WHERE type = 'PART_OF' UNION ALL SELECT 'mine', 'n1', 'n2'"),
    "delete_edge": (_edge_deleted, "SELECT id FROM edges WHERE type = 'LINKS' AND id <> 'ln5'"),
    "update_node_edge": (_updated, "/* tables */ SELECT 'n3' AS id, n_name AS name, CAST(2.5 AS DOUBLE) AS price FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'ln3', 'LINKS', 9.0"),
    "transaction_rollback": (_rolled_back, "SELECT id FROM nodes WHERE label_key = 'Region' UNION ALL SELECT 'kept'"),
    "ingest_columns": (_ingested_columns, "/* tables */ SELECT concat('n', CAST(n_nationkey AS STRING)) AS id, concat('r', CAST(n_regionkey AS STRING)) AS other, n_name AS name FROM nation"),
    "ingest_payloads": (_ingested_payloads, "/* tables */ SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, r_name AS name, 'Region' AS label FROM region"),
    "ingest_deferred": (_deferred, "/* tables */ SELECT 'nodes' AS what, count(*) AS n FROM nation UNION ALL SELECT 'edges', count(*) FROM nation UNION ALL SELECT 'stale', 3 UNION ALL SELECT 'node_label', count(*) FROM nation UNION ALL SELECT 'node_property:name', count(n_name) FROM nation UNION ALL SELECT 'edge_type', count(*) FROM nation"),
    "api_edges_by_type_property": (lambda g: g.find_edges_by_type_property("CONTAINS", "quantity", 7).select("id"), "SELECT id FROM edges WHERE type = 'CONTAINS' AND quantity = 7"),
    "api_edges_by_property_range": (lambda g: g.find_edges_by_property_range("discount", 0.02, 0.04, include_end=False).select("id"), "SELECT id FROM edges WHERE discount >= 0.02 AND discount < 0.04"),
    "api_counts": (_lookup_counts, "SELECT 'label' AS what, count(*) AS n FROM nodes WHERE label_key LIKE '%Party%' UNION ALL SELECT 'property', count(*) FROM nodes WHERE mktsegment = 'BUILDING' UNION ALL SELECT 'type', count(*) FROM edges WHERE type = 'CONTAINS' UNION ALL SELECT 'range', count(*) FROM edges WHERE type = 'CONTAINS' AND quantity > 10 AND quantity <= 20"),
    "api_page": (lambda g: g.nodes.select("id").where("id >= 'o5'").orderBy("id").limit(25), "SELECT id FROM nodes WHERE id >= 'o5' ORDER BY id LIMIT 25"),
    "typed_adjacency_any": (lambda g: g.typed_adjacency("n1", "LINKS", "any").select("edge_id", "neighbor_id", "direction"), "SELECT id AS edge_id, dst AS neighbor_id, 'out' AS direction FROM edges WHERE src = 'n1' AND type = 'LINKS' UNION ALL SELECT id, src, 'in' FROM edges WHERE dst = 'n1' AND type = 'LINKS'"),
    "adjacency_any": (lambda g: g.spark.createDataFrame([(i,) for i in g.get_adjacency_list("n1")], "id string"), "SELECT DISTINCT id FROM edges WHERE src = 'n1' OR dst = 'n1'"),
    "adjacency_forward": (lambda g: g.spark.createDataFrame([(i,) for i in g.get_adjacency_list("n1", "forward")], "id string"), "SELECT id FROM edges WHERE dst = 'n1'"),
    "bfs_depth3": (lambda g: g.bfs_frame("c7", "out", depth=3), ", walk AS (SELECT 'c7' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = walk.id WHERE depth < 3) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id"),
    "bfs_reach": (lambda g: g.bfs_frame("n2", "any", types=["LINKS", "PART_OF"]).select("id"), ", walk AS (SELECT 'n2' AS id UNION SELECT CASE WHEN src = walk.id THEN dst ELSE src END FROM walk JOIN (SELECT src, dst FROM edges WHERE type IN ('LINKS', 'PART_OF')) e ON src = walk.id OR dst = walk.id) SELECT id FROM walk"),
    "sample_neighbors_size": (lambda g: g.sample_neighbors(["c7", "c8", "c9", "c10", "none"], "PLACED", sample_size=5).groupBy("seed").agg(F.count("*").alias("n"), F.countDistinct("edge_id").alias("m")), "SELECT src AS seed, least(count(*), 5) AS n, least(count(*), 5) AS m FROM edges WHERE type = 'PLACED' AND src IN ('c7', 'c8', 'c9', 'c10') GROUP BY src"),
    "sample_paths_full": (_paths, LINES + "SELECT concat('c', CAST(o_custkey AS STRING)) AS seed, concat('pl', CAST(o_orderkey AS STRING)) AS first, lid AS second FROM (VALUES (7), (8), (7)) s(k) JOIN orders ON o_custkey = k JOIN lines ON l_orderkey = o_orderkey"),
    "subgraph_full": (_subgraph, "SELECT 'node' AS what, 'c7' AS id, true AS found UNION ALL SELECT 'node', 'none', false UNION ALL SELECT 'node', dst, true FROM edges WHERE src = 'c7' AND type = 'PLACED' UNION ALL SELECT 'edge', id, true FROM edges WHERE src = 'c7' AND type = 'PLACED'"),
    "delete_node_cascade": (_deleted, "SELECT id FROM nodes WHERE label_key = 'Nation' AND id <> 'n3' UNION ALL SELECT id FROM edges WHERE type IN ('LOCATED_IN', 'LINKS', 'PART_OF') AND src <> 'n3' AND dst <> 'n3'"),
    "upsert_edge": (_upserted, "SELECT id, src, dst FROM edges WHERE type = 'LINKS' AND id <> 'ln3' UNION ALL SELECT 'ln3', 'n1', 'n2' UNION ALL SELECT 'new', 'n9', 'n9'"),
    "rebuild_counts": (_rebuilt, "SELECT 'labels' AS what, CAST(sum(len(string_split(label_key, ';'))) AS BIGINT) AS n FROM nodes UNION ALL SELECT 'types', count(*) FROM edges UNION ALL SELECT 'brand', count(brand) FROM nodes UNION ALL SELECT 'discount', count(discount) FROM edges"),
}
HOPS = {"gen_neighbors": ("synthetic", ["RelA"]), "gen_typed_path": ("typed_path", ["RelA", "RelB"]), "gen_deep": ("synthetic", ["RelA", "RelB", "RelC", "RelA"])}


def generated_hops(shape: str, types: list[str], spark: SparkSession, sf_dir: str, n_nodes: int = 100_000, n_edges: int = 500_000) -> DataFrame:
    """How many typed paths start at the nodes n0 to n9, all ten at once."""
    g = PropertyGraph.generate(spark, shape, n_nodes, n_edges)
    seeds = [f"n{i}" for i in range(10)]
    paths = g.sample_typed_paths(seeds, [{"edge_type": t, "sample_size": 1000} for t in types])
    return paths.groupBy().agg(F.count("*").alias("n"))


def star(spark: SparkSession, sf_dir: str, n_nodes: int = 100_000, n_edges: int = 500_000) -> DataFrame:
    """The hub's relationships, all of them."""
    g = PropertyGraph.generate(spark, "star", n_nodes, n_edges)
    return g.query('MATCH (a {id: "n0"})-[:RelA]->(b) RETURN b.id AS id').df.groupBy().agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {k: partial(_cypher, text, given) for k, (text, given, _) in CYPHER.items()}
    out |= {k: partial(_api, use) for k, (use, _) in API.items()}
    out |= {k: partial(generated_hops, *v) for k, v in HOPS.items()}
    return out | {"gen_star": star}


def _edges_sql(shape: str) -> str:
    src = "0" if shape == "star" else "i % 100000"
    dst = {"synthetic": "(i * 9973 + 1) % 100000", "star": "1 + i % 99999", "typed_path": "(i % 100000 + 1) % 100000"}[shape]
    types = {"synthetic": "['RelA', 'RelB', 'RelC'][i % 3 + 1]", "star": "'RelA'", "typed_path": "['RelA', 'RelB'][i % 2 + 1]"}[shape]
    return f"WITH edges AS (SELECT {src} AS src, {dst} AS dst, {types} AS type FROM range(500000) t(i))"


def oracle_sql() -> dict[str, str]:
    every = {k: sql for k, (_, _, sql) in CYPHER.items()} | {k: sql for k, (_, sql) in API.items()}
    out = {k: sql if sql.startswith(("WITH ", "/*")) else ORACLE_PREFIX + sql for k, sql in every.items()}
    for k, (shape, types) in HOPS.items():
        joins = "".join(f" JOIN edges e{i} ON e{i}.src = e{i - 1}.dst AND e{i}.type = '{t}'" for i, t in enumerate(types) if i)
        out[k] = f"{_edges_sql(shape)} SELECT count(*) AS n FROM edges e0{joins} WHERE e0.type = '{types[0]}' AND e0.src < 10"
    out["gen_star"] = f"{_edges_sql('star')} SELECT count(*) AS n FROM edges WHERE src = 0"
    return out
