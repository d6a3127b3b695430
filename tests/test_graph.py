"""Lookups, changes, traversal, sampling, ingestion and versions."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest

from quiltgraph import Edge, EdgeList, Node, NodeList, PropertyGraph, SamplingHop, SamplingPattern, TimeIndexedEdge
from quiltgraph.model import edge_type
from quiltgraph.sources import ingest, msgpack


@pytest.fixture
def graph(spark) -> PropertyGraph:
    g = PropertyGraph(spark)
    g.put_nodes([Node("n1", {"kind": "drug", "age": 30}, ("Drug",)), Node("n2", {"kind": "protein", "age": 40}, ("Protein", "Thing")), Node("n3", {"age": 50}, ("Protein",))])
    g.put_edges_bulk([Edge("n1", "n2", "e1", {"type": "binds", "score": 1}), Edge("n1", "n3", "e2", {"type": "binds", "score": 2}), Edge("n2", "n3", "e3", {}), Edge("n2", "n2", "e4", {"type": "binds", "score": 2})])
    return g


def ids(found):
    return sorted(x.id for x in found)


def test_lookups(graph):
    assert sorted(graph.iter_node_ids_by_label("Protein")) == ["n2", "n3"] and ids(graph.nodes_by_label("Drug")) == ["n1"] and graph.count_nodes_by_label("No") == 0
    assert ids(graph.nodes_by_property("kind", "drug")) == ["n1"] and graph.count_nodes_by_property("kind", None) == 1 and ids(graph.nodes_by_label_property("Protein", "age", 40.0)) == ["n2"]
    assert ids(graph.nodes_by_property_range("age", 30, 50, include_start=False)) == ["n2", "n3"] and ids(graph.nodes_by_property_range("age", None, 40, include_end=False)) == ["n1"]
    assert graph.nodes_by_property_range("age", 1, "z") == [] and graph.nodes_by_property_range("age", True, None) == [] and graph.count_nodes_by_property_range("age") == 3
    assert ids(graph.nodes_by_label_property_range("Protein", "age", 45, None)) == ["n3"] and ids(graph.range_query_nodes("age", 30, 40)) == ["n1", "n2"]
    assert ids(graph.edges_by_type("binds")) == ["e1", "e2", "e4"] and sorted(graph.iter_edge_ids_by_property("score", 2)) == ["e2", "e4"] and graph.count_edges_by_type_property("binds", "score", 1) == 1
    assert ids(graph.edges_by_property_range("score", 2, None)) == ["e2", "e4"] and ids(graph.edges_by_type_property_range("binds", "score", None, 1)) == ["e1"]
    with pytest.raises(AttributeError):
        graph.nodes_by_nothing("x")


def test_entities(graph):
    assert graph.get_node(b"n1") == Node("n1", {"kind": "drug", "age": 30}, ("Drug",)) and graph.get_node("no") is None
    assert [n and n.id for n in graph.get_nodes(["n3", "no", "n1"])] == ["n3", None, "n1"]
    assert graph.get_edge("e1") == Edge("n1", "n2", "e1", {"type": "binds", "score": 1}) and edge_type(graph.get_edge("e3")) is None
    assert list(graph.get_node_keys_generator(2, "n2")) == ["n2", "n3"] and list(graph.get_edge_keys_generator(2)) == ["e1", "e2"]


def test_changes(graph):
    graph.put_node(Node("n1", {"kind": "compound"}, ("Compound",)))
    assert graph.count_nodes_by_label("Drug") == 0 and graph.get_node("n1").properties == {"kind": "compound"}
    graph.put_node(Node("n9", {"age": "old", "kind": 7}))
    assert ids(graph.nodes_by_property("age", "old")) == ["n9"] and graph.get_node("n9").properties == {"age": "old", "kind": 7} and ids(graph.nodes_by_property("age", 40)) == ["n2"]
    assert graph.update_node("n1", {"x": 1.5}).properties == {"kind": "compound", "x": 1.5} and graph.update_node("new", {"a": 1}, lambda a, b: b).id == "new"
    assert graph.update_edge("e1", {"score": 5}).properties["score"] == 5 and graph.count_edges_by_property("score", 5) == 1
    with pytest.raises(ValueError, match="no ends"):
        graph.update_edge("none", {})
    graph.delete_edge("e1")
    graph.delete_edge("none")
    assert ids(graph.edges_by_type("binds")) == ["e2", "e4"]
    graph.delete_node("n2")
    assert graph.get_node("n2") is None and [r.id for r in graph.edges.collect()] == ["e2"]
    for k in range(10):
        graph.put_edge(Edge("n1", "n3", f"x{k}", {"type": "T"}))
    assert graph.count_edges_by_type("T") == 10
    graph.put_edge(TimeIndexedEdge("n1", "n3", "t", {"type": "At"}, timestamp=datetime(2020, 1, 2)))
    assert graph.get_edge("t").properties["timestamp"] == datetime(2020, 1, 2)


def test_transactions_and_versions(spark, graph, tmp_path):
    path = str(tmp_path / "kept")
    graph.create_node_property_index("age")
    assert graph.save(path) == 1
    with graph.transaction() as t:
        t.put_node(Node("n4", {"age": 1}))
    with pytest.raises(RuntimeError), graph.transaction() as t:
        t.delete_node("n1")
        raise RuntimeError
    with pytest.raises(NotImplementedError), graph.transaction() as t, t.transaction():
        pass
    assert graph.get_node("n1") is not None
    again = PropertyGraph(spark, path=path)
    assert again.get_node("n4").properties == {"age": 1} and again.index_statistics()["node_properties"] == ("age",) and ids(again.edges_by_type("binds")) == ["e1", "e2", "e4"]
    assert again.store.manifest()["version"] == 2 and ids(again.nodes_by_label("Thing")) == ["n2"] and again.get_edge("e3").type is None
    again.close()


def test_index_counts(graph):
    assert graph.create_node_property_index("kind") == 2 and graph.create_edge_property_index("score") == 3
    assert graph.rebuild_node_indexes() == {"node_label": 4, "node_property:kind": 2} and graph.rebuild_edge_indexes() == {"edge_type": 3, "edge_property:score": 3}
    assert graph.rebuild_typed_adjacency() == 3


def test_traversal(graph):
    assert sorted(graph.neighbors_by_edge_type("n1", "binds")) == ["n2", "n3"] and graph.edges_by_edge_type("n3", "binds", "in") == ["e2"]
    assert sorted((r["edge_id"], r["direction"]) for r in graph.get_typed_adjacency("n2", "binds", "any")) == [("e1", "in"), ("e4", "in"), ("e4", "out")]
    assert len(list(graph.iter_typed_adjacency("n2", "binds"))) == 1
    with pytest.raises(ValueError, match="direction must be"):
        graph.get_typed_adjacency("n2", "binds", "up")
    assert graph.bfs("n1") == ["n1", "n2", "n3"] and graph.bfs("n3", "backward") == ["n3"] and graph.bfs("n3", "forward") == ["n3", "n1", "n2"] and graph.bfs("alone") == ["alone"]
    assert [tuple(r) for r in graph.bfs_frame("n1", "out", depth=0).collect()] == [("n1", 0)]
    assert sorted(graph.get_adjacency_list("n2")) == ["e1", "e3", "e4"] and sorted(graph.get_adjacency_list("n2", "forward")) == ["e1", "e4"] and sorted(graph.get_adjacency_list("n2", "backward")) == ["e3", "e4"]


def test_sampling(spark):
    g = PropertyGraph.generate(spark, "synthetic", 200, 4000)
    every = {r.edge_id for r in g.typed_adjacency("n1", "RelB").collect()}
    for seed in (1, 2):
        drawn = [r.edge_id for r in g.sample_neighbors("n1", "RelB", sample_size=3, seed=seed).collect()]
        assert len(set(drawn)) == 3 and set(drawn) <= every and drawn == [r.edge_id for r in g.sample_neighbors("n1", "RelB", sample_size=3, seed=seed).collect()]
    assert {r.edge_id for r in g.sample_neighbors("n1", "RelB", sample_size=1000).collect()} == every and g.sample_neighbors("n1", "RelB", sample_size=0).count() == 0
    pattern = SamplingPattern((SamplingHop("RelB", sample_size=2), SamplingHop("RelA", "in", 2)))
    assert SamplingPattern.from_dicts(pattern.to_dicts()) == pattern
    paths = g.sample_typed_paths(["n1", "n1", "n4", "none"], pattern).collect()
    assert all(len(p.path) == 2 and p.path[0].source_id == p.seed and p.path[1].target_id == p.path[0].neighbor_id for p in paths)
    assert [(r.seed, r.path) for r in g.sample_typed_paths(["a", "a"], []).collect()] == [("a", [])] * 2
    made = g.sample_typed_subgraph(["n1", "none"], pattern)
    assert {r.id for r in made["nodes"].where("label_key IS NULL").collect()} == {"none"} and made["edges"].where("type IS NULL").count() == 0
    called = g.query("CALL pg.sample_typed_paths(['n1'], [{'edge_type': 'RelB', 'sample_size': 4}]) YIELD path RETURN path LIMIT 3").records
    assert len(called) == 3 and called[0]["path"]["seed"] == "n1" and called[0]["path"]["path"][0]["edge_type"] == "RelB"
    for bad in ({"direction": "up"}, {"sample_size": 0}):
        with pytest.raises(ValueError):
            SamplingHop("T", **bad)


NODES = pa.table({"node_id": ["a", "b"], "labels": [["X"], ["X", "Y"]], "v": [1, None], "w": ["p", "q"]})
EDGES = pa.table({"edge_id": ["e"], "source": ["a"], "target": ["b"], "edge_type": ["T"], "type": ["ignored"], "s": [0.5]})


def test_ingest_columns(spark):
    g = PropertyGraph(spark)
    g.create_node_property_index("v")
    assert g.ingest_arrow(NODES, EDGES, index_mode="defer") == {"nodes": 2, "edges": 1, "rebuilt_indexes": {}, "stale_indexes": ("node_label", "node_property:v", "edge_type")}
    assert g.rebuild_deferred_indexes() == {"node_label": 3, "node_property:v": 1, "edge_type": 1} and g.stale_indexes() == ()
    assert g.get_node("b") == Node("b", {"w": "q"}, ("X", "Y")) and g.get_edge("e") == Edge("a", "b", "e", {"type": "T", "s": 0.5})
    h = PropertyGraph(spark)
    assert h.ingest_polars(NODES.to_pandas(), spark.createDataFrame(EDGES))["stale_indexes"] == ()
    assert h.ingest_nodes_arrow_entities(pa.table({"node_id": ["b"], "labels": ["Z"], "v": [7]}), property_columns=["v"], append_only=False) == 1
    assert h.get_node("b") == Node("b", {"v": 7}, ("Z",)) and h.nodes.count() == 2


def test_ingest_payloads(spark):
    nodes = NodeList(["a", b"b"], [ingest.payload(Node("a", {"v": 1}, ("X",))), ingest.payload(Node("b", {"w": "q"}))])
    edges = EdgeList(["e"], ["a"], ["b"], ["T"], [ingest.payload(Edge("a", "b", "e", {"type": "T", "s": 2}))])
    g = PropertyGraph(spark)
    assert g.ingest_arrow(nodes, edges, mode="serialized_payloads")["nodes"] == 2
    assert g.get_node("a") == Node("a", {"v": 1}, ("X",)) and g.get_edge("e") == Edge("a", "b", "e", {"type": "T", "s": 2})
    with pytest.raises(NotImplementedError, match="append_only"):
        g.ingest_edges_arrow(edges, append_only=False)
    with pytest.raises(ValueError, match="are required"):
        g.ingest_arrow(nodes, EdgeList(["e"], ["a"], ["b"], ["T"]), mode="serialized_payloads")
    with pytest.raises(TypeError):
        g.ingest_nodes_arrow(NodeList(["a"], [b"\x80 no json"]))
    assert [len(c) for c in nodes.chunks(1)] == [1, 1]


def test_messagepack_payloads(spark):
    made = Node("a", {"v": 1, "s": "é" * 40, "x": [1, 2], "big": 2**40, "neg": -300, "f": 0.5, "yes": True}, ("X",))
    g = PropertyGraph(spark)
    nodes = NodeList(["a"], [ingest.payload(made, "messagepack")])
    edges = EdgeList(["e"], ["a"], ["a"], ["T"], [ingest.payload(Edge("a", "a", "e", {"type": "T", "s": 2}), "messagepack")])
    assert g.ingest_arrow(nodes, edges, mode="serialized_payloads", payload_format="messagepack")["edges"] == 1
    assert g.get_node("a") == made and g.get_edge("e") == Edge("a", "a", "e", {"type": "T", "s": 2})
    with pytest.raises(TypeError, match="messagepack"):
        g.ingest_nodes_arrow(NodeList(["a"], [b"\xc1"]), payload_format="messagepack")
    with pytest.raises(ValueError, match="must be one of: json, messagepack"):
        g.ingest_nodes_arrow(nodes, payload_format="pickle")


def test_messagepack_round_trip():
    for value in (None, True, False, 0, 127, 128, 255, 256, 65536, 2**32, 2**64 - 1, -1, -32, -33, -129, -(2**15) - 1, -(2**63), 1.5, "", "a" * 31, "a" * 32, "é" * 70000, b"", b"x" * 300, [], list(range(16)), [[1], {}], {str(i): i for i in range(70000)}):
        assert msgpack.unpacked(msgpack.packed(value)) == value
    # from the specification
    assert msgpack.unpacked(bytes.fromhex("82a7636f6d70616374c3a6736368656d6100")) == {"compact": True, "schema": 0}
    assert msgpack.unpacked(bytes.fromhex("ca3fc00000")) == 1.5 and msgpack.unpacked(b"\xd9\x01a") == "a"
    for bad in (b"", b"\xc1", b"\xa2a", b"\x92\x01", b"\x01\x01", b"\xcd\x01", b"\xd4\x01\x01", b"\x81\x01\x01", b"\xa1\xff"):
        with pytest.raises(ValueError):
            msgpack.unpacked(bad)


class Lazy:
    """A lazy frame over an Arrow table, that notes the rows it was asked for."""

    def __init__(self, table, asked):
        self.table, self.asked = table, asked

    def slice(self, at, n):
        self.asked.append((at, n))
        return Lazy(self.table.slice(at, n), self.asked)

    def collect(self):
        return NodesOf(self.table)


class NodesOf:
    def __init__(self, table):
        self.table = table

    def to_arrow(self):
        return self.table


@pytest.mark.parametrize("n", [0, 3, 4, 7])
def test_lazy_frames_come_in_chunks(spark, monkeypatch, n):
    monkeypatch.setattr(ingest, "CHUNK_ROWS", 2)
    asked = []
    table = pa.table({"node_id": pa.array([f"n{i}" for i in range(n)], pa.string()), "v": pa.array(range(n), pa.int64())})
    g = PropertyGraph(spark)
    assert g.ingest_nodes_arrow_entities(Lazy(table, asked)) == n
    assert sorted((r.id, r.p__v) for r in g.nodes.collect()) == [(f"n{i}", i) for i in range(n)]
    assert asked == [(i, 2) for i in range(0, n + 1, 2)]


@pytest.mark.parametrize(
    ("make", "error"),
    [
        (lambda g: g.ingest_nodes_arrow_entities(NODES.rename_columns(["x", "labels", "v", "w"])), "missing required columns: node_id"),
        (lambda g: g.ingest_nodes_arrow_entities(NODES, property_columns=["zz"]), "missing property columns: zz"),
        (lambda g: g.ingest_nodes_arrow_entities(pa.table({"node_id": ["a", None]})), "node_id must not contain nulls"),
        (lambda g: g.ingest_edges_arrow_entities(EDGES.drop_columns(["target"])), "missing required columns: target"),
        (lambda g: g.ingest_nodes_arrow_entities(NODES, index_mode="defer_rebuild"), "must be one of: maintain, defer"),
        (lambda g: g.ingest_arrow(NODES, EDGES, mode="rows"), "must be one of: entity_columns, serialized_payloads"),
        (lambda g: NodeList(["a"], []), "equal lengths"), (lambda g: NodeList([None], [b""]), "nulls"), (lambda g: list(NodeList(["a"], [b""]).chunks(0)), "chunk_size must be positive"),
        (lambda g: NodeList.from_arrow(NODES), "missing required columns: node_value"), (lambda g: EdgeList(["a"], ["b"], ["c"], []), "equal lengths"), (lambda g: PropertyGraph.generate(g.spark, "ring"), "shape must be one of"),
    ],
)
def test_bad_input(spark, make, error):
    with pytest.raises(ValueError, match=error):
        make(PropertyGraph(spark))


def test_wrong_types():
    with pytest.raises(TypeError):
        NodeList([1], [b""])
    with pytest.raises(TypeError):
        EdgeList(["a"], ["b"], ["c"], ["d"], ["text"])


def test_streams_append_once(spark, tmp_path):
    from quiltgraph.streaming.append import append_edges

    path = str(tmp_path / "in")
    spark.createDataFrame(EDGES.drop_columns(["type"])).write.parquet(path)
    g = PropertyGraph(spark)
    for _ in range(2):
        append_edges(g, spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), str(tmp_path / "state")).awaitTermination(60)
    assert [r.id for r in g.edges.collect()] == ["e"]


def test_streamed_batches_outlive_the_handle_and_are_compacted(spark, tmp_path):
    from quiltgraph.streaming.append import append_edges, append_nodes, compacted

    schema, state, kept = "edge_id string, source string, target string, edge_type string, w long", str(tmp_path / "state"), str(tmp_path / "graph")
    path = str(tmp_path / "in")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def run(g):
        append_edges(g, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), state).awaitTermination(120)

    g = PropertyGraph(spark, path=kept)
    g.put_edges_bulk([Edge("a", "b", "old", {"type": "T", "w": 1})])
    for k in range(3):
        arrive([(f"e{k}", "a", "b", "T", k), ("old", "a", "c", "T", 10 + k)])
        run(g)
        assert {r.id: (r.dst, r.p__w) for r in g.edges.collect()} == {**{f"e{i}": ("b", i) for i in range(k + 1)}, "old": ("c", 10 + k)}
    g.delete_edge("e0")
    arrive([("e3", "a", "b", "T", 3)])
    run(g)
    h = PropertyGraph(spark, path=kept)  # nothing was saved: only the batches are found again
    run(h)
    assert sorted(r.id for r in h.edges.collect()) == ["e0", "e1", "e2", "e3", "old"]
    compacted(h, state)
    h.put_edges_bulk([Edge("x", "y", "old", {"type": "T", "w": 99})])
    run(h)
    assert h.get_edge("old") == Edge("x", "y", "old", {"type": "T", "w": 99})
    n = PropertyGraph(spark)
    names = str(tmp_path / "names")
    spark.createDataFrame([("a", ["X"], 1)], "node_id string, labels array<string>, v long").write.parquet(names)
    append_nodes(n, spark.readStream.schema("node_id string, labels array<string>, v long").parquet(names), str(tmp_path / "n")).awaitTermination(60)
    assert n.get_node("a") == Node("a", {"v": 1}, ("X",))
