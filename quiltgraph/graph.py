"""A property graph over two DataFrames: queries, lookups, traversal, sampling, ingestion and changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltgraph.model import EDGE_COLUMNS, NODE_COLUMNS, PREFIX, Catalog, Edge, Node, column_of, kind_of_value, properties, text_id
from quiltgraph.operators import lookup, sampler, traversal
from quiltgraph.plans import QueryResult, plain
from quiltgraph.plans import syntax as S
from quiltgraph.plans.compiler import Compiler
from quiltgraph.plans.logical import LogicalPlan, plan
from quiltgraph.plans.parser import parse
from quiltgraph.sources import ingest
from quiltgraph.sources.generators import generated
from quiltgraph.sources.ingest import ColumnarIngestionMode, IndexMaintenanceMode
from quiltgraph.sources.shared import checkpointed
from quiltgraph.sources.store import Store

EMPTY_NODES = "id string, labels array<string>, label_key string"
EMPTY_EDGES = "id string, src string, dst string, type string"
#: Changes after which the frames' lineage is cut.
CUT_AFTER = 8


class PropertyGraph:
    """``nodes`` and ``edges`` are the current frames; changes put new ones in their place.

    ``path``: a folder in which versions are kept; what is there is opened.
    Reads never use secondary indexes, so nothing that they return is stale;
    index calls keep the names and counts that callers ask for.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None, *, path: str | None = None, label_keys: Iterable[str] | None = None, whole: bool = False) -> None:
        self.spark = spark
        self.store = Store(spark, path) if path else None
        self.node_indexes: dict[str, None] = {}
        self.edge_indexes: dict[str, None] = {}
        self.stale: dict[str, None] = {}
        self._changes, self._staged = 0, None
        loaded = self.store.load() if self.store and nodes is None else None
        if loaded:
            nodes, edges, entry = loaded
            label_keys, whole = entry["label_keys"], entry.get("whole", False)
            self.node_indexes, self.edge_indexes = (dict.fromkeys(entry.get(k, ())) for k in ("node_indexes", "edge_indexes"))
            self.stale = dict.fromkeys(entry.get("stale", ()))
        self.nodes = nodes if nodes is not None else spark.createDataFrame([], EMPTY_NODES)
        self.edges = edges if edges is not None else spark.createDataFrame([], EMPTY_EDGES)
        self.catalog = Catalog.of(self.nodes, self.edges, label_keys, whole)

    # -- making and keeping ---------------------------------------------

    @classmethod
    def from_dataframes(cls, nodes: Any, edges: Any, **options: Any) -> PropertyGraph:
        """From entity columns: ``node_id, labels, …`` and ``edge_id, source, target, edge_type, …``."""
        spark = nodes.sparkSession if isinstance(nodes, DataFrame) else SparkSession.active()
        return cls(spark, ingest.node_rows(ingest.framed(spark, nodes)), ingest.edge_rows(ingest.framed(spark, edges)), **options)

    @classmethod
    def generate(cls, spark: SparkSession, shape: str, n_nodes: int = 100_000, n_edges: int = 500_000) -> PropertyGraph:
        return cls(spark, *generated(spark, shape, n_nodes, n_edges), label_keys=["Node"], whole=True)

    def save(self, path: str | None = None) -> int:
        """Publishes the frames as the next version, and reads on from it. Returns its number."""
        if path:
            self.store = Store(self.spark, path)
        if self.store is None:
            raise ValueError("the graph has no path")
        extra = {"node_indexes": list(self.node_indexes), "edge_indexes": list(self.edge_indexes), "stale": list(self.stale), "whole": self.catalog.whole}
        entry = self.store.publish(self.nodes, self.edges, extra)
        self.nodes, self.edges, _ = self.store.load()
        self.catalog = Catalog.of(self.nodes, self.edges, entry["label_keys"], self.catalog.whole)
        return entry["version"]

    def close(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    def validate(self) -> bool:
        """Whether every edge's ends exist; if so, queries leave out joins that only prove it."""
        ids = self.nodes.select(F.col("id").alias("end"))
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("end"))
        whole = ends.join(ids, "end", "left_anti").isEmpty()
        self.catalog = Catalog(self.catalog.nodes, self.catalog.edges, self.catalog.label_keys, whole)
        return whole

    # -- queries --------------------------------------------------------

    def query(self, cypher: str, parameters: Mapping[str, Any] | None = None) -> QueryResult:
        parsed = parse(cypher)
        if isinstance(parsed, S.SampleCall):
            paths = self.sample_typed_paths(parsed.seeds, parsed.pattern)
            df = paths.select(F.struct("seed", "path").alias("path"))
            return QueryResult(df if parsed.limit is None else df.limit(parsed.limit))
        compiler = Compiler(self.nodes, self.edges, self.catalog, parameters, parsed)
        return QueryResult(compiler.run(plan(parsed)))

    def plan(self, cypher: str) -> LogicalPlan:
        return plan(parse(cypher))

    # -- entities -------------------------------------------------------

    def as_node(self, row: Row) -> Node:
        return Node(row["id"], _held(row, self.catalog.nodes), tuple(row["labels"] or ()))

    def as_edge(self, row: Row) -> Edge:
        kind = {"type": row["type"]} if row["type"] is not None else {}
        return Edge(row["src"], row["dst"], row["id"], kind | _held(row, self.catalog.edges))

    def get_node(self, node_id: str | bytes) -> Node | None:
        rows = self.nodes.where(F.col("id") == text_id(node_id)).head(1)
        return self.as_node(rows[0]) if rows else None

    def get_nodes(self, node_ids: Sequence[str | bytes]) -> list[Node | None]:
        ids = [text_id(i) for i in node_ids]
        found = {r["id"]: self.as_node(r) for r in self.nodes.where(F.col("id").isin(ids)).collect()} if ids else {}
        return [found.get(i) for i in ids]

    def get_edge(self, edge_id: str | bytes) -> Edge | None:
        rows = self.edges.where(F.col("id") == text_id(edge_id)).head(1)
        return self.as_edge(rows[0]) if rows else None

    def get_node_keys_generator(self, num_nodes: int, key_offset: str | bytes | None = None) -> Iterator[str]:
        return _ids(lookup.page_of_ids(self.nodes, num_nodes, None if key_offset is None else text_id(key_offset)))

    def get_edge_keys_generator(self, num_edges: int, key_offset: str | bytes | None = None) -> Iterator[str]:
        return _ids(lookup.page_of_ids(self.edges, num_edges, None if key_offset is None else text_id(key_offset)))

    # -- lookups: a DataFrame each, then ids, entities and counts by name --

    def find_nodes_by_label(self, label: str) -> DataFrame:
        keys = self.catalog.keys_with([label])
        return lookup.with_labels(self.nodes, label) if keys is None else self.nodes.where(F.col("label_key").isin(keys))

    def find_nodes_by_property(self, name: str, value: Any) -> DataFrame:
        return lookup.with_property(self.nodes, name, value)

    def find_nodes_by_label_property(self, label: str, name: str, value: Any) -> DataFrame:
        return lookup.with_property(self.find_nodes_by_label(label), name, value)

    def find_nodes_by_property_range(self, name: str, start: Any = None, end: Any = None, include_start: bool = True, include_end: bool = True) -> DataFrame:
        return lookup.with_range(self.nodes, name, start, end, include_start, include_end)

    def find_nodes_by_label_property_range(self, label: str, name: str, start: Any = None, end: Any = None, include_start: bool = True, include_end: bool = True) -> DataFrame:
        return lookup.with_range(self.find_nodes_by_label(label), name, start, end, include_start, include_end)

    def find_edges_by_type(self, edge_type: str) -> DataFrame:
        return lookup.with_type(self.edges, edge_type)

    def find_edges_by_property(self, name: str, value: Any) -> DataFrame:
        return lookup.with_property(self.edges, name, value)

    def find_edges_by_type_property(self, edge_type: str, name: str, value: Any) -> DataFrame:
        return lookup.with_property(self.find_edges_by_type(edge_type), name, value)

    def find_edges_by_property_range(self, name: str, start: Any = None, end: Any = None, include_start: bool = True, include_end: bool = True) -> DataFrame:
        return lookup.with_range(self.edges, name, start, end, include_start, include_end)

    def find_edges_by_type_property_range(self, edge_type: str, name: str, start: Any = None, end: Any = None, include_start: bool = True, include_end: bool = True) -> DataFrame:
        return lookup.with_range(self.find_edges_by_type(edge_type), name, start, end, include_start, include_end)

    def __getattr__(self, name: str) -> Callable[..., Any]:
        """``iter_node_ids_by_…``, ``nodes_by_…``, ``count_nodes_by_…`` for each ``find_nodes_by_…``, and so for edges."""
        for entity, make in (("node", "as_node"), ("edge", "as_edge")):
            for start in (f"iter_{entity}_ids_by_", f"{entity}s_by_", f"count_{entity}s_by_"):
                if name.startswith(start) and hasattr(type(self), finder := f"find_{entity}s_by_{name[len(start) :]}"):
                    find = getattr(self, finder)
                    if start.startswith("iter"):
                        return lambda *a, **k: _ids(find(*a, **k).select("id"))
                    if start.startswith("count"):
                        return lambda *a, **k: find(*a, **k).count()
                    return lambda *a, **k: [getattr(self, make)(r) for r in find(*a, **k).collect()]
        raise AttributeError(name)

    def range_query_nodes(self, name: str, start: Any, end: Any) -> list[Node]:
        return [self.as_node(r) for r in self.find_nodes_by_property_range(name, start, end).collect()]

    # -- traversal ------------------------------------------------------

    def typed_adjacency(self, node_id: str | bytes, edge_type: str, direction: str = "out") -> DataFrame:
        found = traversal.ways(self.edges, [edge_type], direction)
        return found.where(F.col("start") == text_id(node_id)).drop("start")

    def iter_typed_adjacency(self, node_id: str | bytes, edge_type: str, direction: str = "out") -> Iterator[dict[str, Any]]:
        found = self.typed_adjacency(node_id, edge_type, direction)
        return (r.asDict() for r in found.toLocalIterator())

    def get_typed_adjacency(self, node_id: str | bytes, edge_type: str, direction: str = "out") -> list[dict[str, Any]]:
        return [r.asDict() for r in self.typed_adjacency(node_id, edge_type, direction).collect()]

    def neighbors_by_edge_type(self, node_id: str | bytes, edge_type: str, direction: str = "out") -> list[str]:
        return [r[0] for r in self.typed_adjacency(node_id, edge_type, direction).select("neighbor_id").collect()]

    def edges_by_edge_type(self, node_id: str | bytes, edge_type: str, direction: str = "out") -> list[str]:
        return [r[0] for r in self.typed_adjacency(node_id, edge_type, direction).select("edge_id").collect()]

    def bfs_frame(self, start: Any, direction: str = "any", depth: int | None = None, types: Sequence[str] | None = None) -> DataFrame:
        """``(id, depth)``. Directions as for ``bfs``, and ``out`` and ``in``."""
        turned = {"forward": "in", "backward": "out"}.get(direction, direction)
        return traversal.bfs(self.edges, start, turned, depth, types)

    def bfs(self, start: str | bytes, direction: str = "any") -> list[str]:
        """Ids by depth, then id, the start first. ``forward`` and ``backward`` follow ``get_adjacency_list``."""
        return [r[0] for r in self.bfs_frame(text_id(start), direction).orderBy("depth", "id").collect()]

    def get_adjacency_list(self, node_id: str | bytes, direction: str = "any") -> list[str]:
        return [r[0] for r in traversal.adjacency(self.edges, text_id(node_id), direction).collect()]

    # -- sampling -------------------------------------------------------

    def sample_neighbors(self, node_id: Any, edge_type: str, direction: str = "out", sample_size: int = 10, seed: int = 0) -> DataFrame:
        ids = node_id if isinstance(node_id, DataFrame | list | tuple) else [text_id(node_id)]
        return sampler.sample_neighbors(self.edges, ids, edge_type, direction, sample_size, seed)

    def sample_typed_paths(self, ids: Any, pattern: Any, seed: int = 0) -> DataFrame:
        return sampler.sample_paths(self.edges, ids, pattern, seed)

    def sample_typed_subgraph(self, ids: Any, pattern: Any, seed: int = 0) -> dict[str, DataFrame]:
        nodes, edges, paths = sampler.subgraph(self.nodes, self.edges, ids, pattern, seed)
        return {"nodes": nodes, "edges": edges, "paths": paths}

    # -- changes --------------------------------------------------------

    def _replace(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, label_keys: Iterable[str] | None = None) -> None:
        self._changes += 1
        if self._changes % CUT_AFTER == 0:
            nodes, edges = (None if d is None else checkpointed(d) for d in (nodes, edges))
        self.replaced(nodes, edges, label_keys)

    def replaced(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, label_keys: Iterable[str] | None = None) -> None:
        """Takes new frames as they are; their lineage is the caller's to bound."""
        self.nodes = nodes if nodes is not None else self.nodes
        self.edges = edges if edges is not None else self.edges
        self.catalog = Catalog.of(self.nodes, self.edges, label_keys)

    def put_node(self, node: Node) -> None:
        self.put_nodes([node])

    def put_nodes(self, nodes: Iterable[Node]) -> None:
        """Replaces by id; of the same id the last is taken."""
        last = list({n.id: n for n in nodes}.values())
        if last:
            self._replace(nodes=lookup.upserted(self.nodes, self.node_frame(last)))

    def put_edge(self, edge: Edge, update_adjacency: bool = True) -> None:
        self.put_edges_bulk([edge])

    def put_edges_bulk(self, edges: Iterable[Edge], check_existing: bool = True) -> None:
        """Replaces by id, or, unchecked, adds. Ends need not exist."""
        last = list({e.id: e for e in edges}.values())
        if last:
            new = self.edge_frame(last)
            self._replace(edges=lookup.upserted(self.edges, new) if check_existing else lookup.added(self.edges, new))

    def node_frame(self, nodes: Sequence[Node]) -> DataFrame:
        fixed = [(n.id, list(n.labels), ";".join(sorted(n.labels))) for n in nodes]
        return _frame(self.spark, EMPTY_NODES, fixed, [n.properties for n in nodes])

    def edge_frame(self, edges: Sequence[Edge]) -> DataFrame:
        fixed = [(e.id, e.source, e.target, e.type) for e in edges]
        return _frame(self.spark, EMPTY_EDGES, fixed, [{k: v for k, v in e.properties.items() if k != "type"} for e in edges])

    def delete_node(self, node_id: str | bytes) -> None:
        """With every edge at it."""
        ids = [text_id(node_id)]
        kept = lookup.without(lookup.without(self.edges, "src", ids), "dst", ids)
        self._replace(lookup.without(self.nodes, "id", ids), kept)

    def delete_edge(self, edge_id: str | bytes) -> None:
        self._replace(edges=lookup.without(self.edges, "id", [text_id(edge_id)]))

    def update_node(self, node_id: str | bytes, data: dict[str, Any], merge_func: Callable[[dict, dict], dict] | None = None) -> Node:
        """Merges properties on the driver; a node that doesn't exist is made."""
        node = self.get_node(node_id) or Node(text_id(node_id))
        node.properties = merge_func(node.properties, data) if merge_func else node.properties | data
        self.put_node(node)
        return node

    def update_edge(self, edge_id: str | bytes, data: dict[str, Any], merge_func: Callable[[dict, dict], dict] | None = None) -> Edge:
        edge = self.get_edge(edge_id)
        if edge is None:
            raise ValueError(f"edge {text_id(edge_id)} doesn't exist, and data has no ends for it")
        edge.properties = merge_func(edge.properties, data) if merge_func else edge.properties | data
        self.put_edge(edge)
        return edge

    @contextmanager
    def transaction(self) -> Iterator[PropertyGraph]:
        """Changes made inside are published together, if the graph has a path; an exception undoes them."""
        if self._staged is not None:
            raise NotImplementedError("transactions don't nest")
        self._staged = before = (self.nodes, self.edges, self.catalog, dict(self.node_indexes), dict(self.edge_indexes), dict(self.stale))
        try:
            yield self
        except BaseException:
            self.nodes, self.edges, self.catalog, self.node_indexes, self.edge_indexes, self.stale = before
            raise
        finally:
            self._staged = None
        if self.store:
            self.save()

    # -- index bookkeeping ----------------------------------------------

    def create_node_property_index(self, name: str) -> int:
        self.node_indexes[name] = None
        return self.rebuild_node_property_index(name)

    def create_edge_property_index(self, name: str) -> int:
        self.edge_indexes[name] = None
        return self.rebuild_edge_property_index(name)

    def rebuild_node_property_index(self, name: str) -> int:
        self.stale.pop(f"node_property:{name}", None)
        return lookup.having(self.nodes, name).count()

    def rebuild_edge_property_index(self, name: str) -> int:
        self.stale.pop(f"edge_property:{name}", None)
        return lookup.having(self.edges, name).count()

    def rebuild_label_index(self) -> int:
        """How many pairs of node and label there are."""
        self.stale.pop("node_label", None)
        return self.nodes.agg(F.coalesce(F.sum(F.size("labels")), F.lit(0))).first()[0]

    def rebuild_relationship_type_index(self) -> int:
        self.stale.pop("edge_type", None)
        return self.edges.where("type IS NOT NULL").count()

    def rebuild_typed_adjacency(self) -> int:
        return self.edges.where("type IS NOT NULL").count()

    def rebuild_node_indexes(self) -> dict[str, int]:
        return {"node_label": self.rebuild_label_index()} | {f"node_property:{p}": self.rebuild_node_property_index(p) for p in self.node_indexes}

    def rebuild_edge_indexes(self) -> dict[str, int]:
        return {"edge_type": self.rebuild_relationship_type_index()} | {f"edge_property:{p}": self.rebuild_edge_property_index(p) for p in self.edge_indexes}

    def rebuild_deferred_indexes(self) -> dict[str, int]:
        stale = list(self.stale)
        every = (self.rebuild_node_indexes() if any(s.startswith("node") for s in stale) else {}) | (self.rebuild_edge_indexes() if any(s.startswith("edge") for s in stale) else {})
        self.stale = {}
        return {k: n for k, n in every.items() if k in stale}

    def stale_indexes(self) -> tuple[str, ...]:
        return tuple(self.stale)

    def index_statistics(self) -> dict[str, tuple[str, ...]]:
        return {"node_properties": tuple(self.node_indexes), "edge_properties": tuple(self.edge_indexes)}

    # -- ingestion ------------------------------------------------------

    def _ingested(self, entity: str, rows: DataFrame, append_only: bool, mode: str, whole_mode: bool = False) -> int:
        allowed = () if whole_mode else (IndexMaintenanceMode.MAINTAIN, IndexMaintenanceMode.DEFER)
        deferred = ingest.chosen(IndexMaintenanceMode, mode, *allowed) != IndexMaintenanceMode.MAINTAIN
        base = getattr(self, f"{entity}s")
        put = lookup.added if append_only else lookup.upserted
        self._replace(**{f"{entity}s": put(base, rows) if base.columns else rows})
        if deferred:
            names = ["node_label" if entity == "node" else "edge_type", *[f"{entity}_property:{p}" for p in getattr(self, f"{entity}_indexes")]]
            self.stale |= dict.fromkeys(names)
        return rows.count()

    def ingest_nodes_arrow_entities(self, table: Any, id_column: str = "node_id", labels_column: str | None = "labels", property_columns: Sequence[str] | None = None, append_only: bool = True, index_mode: str = "maintain") -> int:
        return self._ingested("node", ingest.node_rows(ingest.framed(self.spark, table), id_column, labels_column, property_columns), append_only, index_mode)

    def ingest_edges_arrow_entities(self, table: Any, id_column: str = "edge_id", source_column: str = "source", target_column: str = "target", type_column: str = "edge_type", property_columns: Sequence[str] | None = None, append_only: bool = True, index_mode: str = "maintain") -> int:
        return self._ingested("edge", ingest.edge_rows(ingest.framed(self.spark, table), id_column, source_column, target_column, type_column, property_columns), append_only, index_mode)

    def ingest_nodes_arrow(self, nodes: Any, append_only: bool = True, index_mode: str = "maintain", payload_format: str = "json") -> int:
        table = nodes.to_arrow() if isinstance(nodes, ingest.NodeList) else nodes
        return self._ingested("node", ingest.node_payload_rows(ingest.framed(self.spark, table), form=payload_format), append_only, index_mode)

    def ingest_edges_arrow(self, edges: Any, append_only: bool = True, index_mode: str = "maintain", payload_format: str = "json") -> int:
        if not append_only:
            raise NotImplementedError("columnar edge ingestion of payloads requires append_only=True")
        table = edges.to_arrow() if isinstance(edges, ingest.EdgeList) else edges
        return self._ingested("edge", ingest.edge_payload_rows(ingest.framed(self.spark, table), form=payload_format), append_only, index_mode)

    ingest_nodes_polars_entities, ingest_edges_polars_entities = ingest_nodes_arrow_entities, ingest_edges_arrow_entities
    ingest_nodes_polars, ingest_edges_polars = ingest_nodes_arrow, ingest_edges_arrow

    def ingest_arrow(self, nodes: Any, edges: Any, *, mode: str = "entity_columns", index_mode: str = "defer_rebuild", append_only: bool = True, payload_format: str = "json") -> dict[str, Any]:
        """Nodes, then edges. Says how many there were, and which index names were rebuilt or left stale."""
        how = ingest.chosen(ColumnarIngestionMode, mode)
        when = ingest.chosen(IndexMaintenanceMode, index_mode)
        low = IndexMaintenanceMode.MAINTAIN if when == IndexMaintenanceMode.MAINTAIN else IndexMaintenanceMode.DEFER
        if how == ColumnarIngestionMode.ENTITY_COLUMNS:
            n = self.ingest_nodes_arrow_entities(nodes, append_only=append_only, index_mode=low)
            m = self.ingest_edges_arrow_entities(edges, append_only=append_only, index_mode=low)
        else:
            names = [set(getattr(x, "columns", None) or getattr(x, "column_names", None) or x.to_arrow().column_names) if not isinstance(x, ingest.NodeList | ingest.EdgeList) else set(x.to_arrow().column_names) for x in (nodes, edges)]
            if "node_value" not in names[0] or "edge_value" not in names[1]:
                raise ValueError("node_values and edge_values are required for serialized payloads")
            n = self.ingest_nodes_arrow(nodes, append_only, low, payload_format)
            m = self.ingest_edges_arrow(edges, append_only, low, payload_format)
        rebuilt = self.rebuild_deferred_indexes() if when == IndexMaintenanceMode.DEFER_REBUILD else {}
        return {"nodes": n, "edges": m, "rebuilt_indexes": rebuilt, "stale_indexes": self.stale_indexes()}

    ingest_polars = ingest_arrow


def _ids(df: DataFrame) -> Iterator[str]:
    return (r[0] for r in df.toLocalIterator())


def _held(row: Row, known: Mapping[str, Sequence[tuple[str, str]]]) -> dict[str, Any]:
    """The properties that a row has."""
    found = {name: next((plain(row[c]) for c, _ in columns if row[c] is not None), None) for name, columns in known.items()}
    return {k: v for k, v in found.items() if v is not None}


def _frame(spark: SparkSession, fixed_schema: str, fixed: list[tuple], props: list[dict[str, Any]]) -> DataFrame:
    """Rows with a column for each property, and for each kind of those whose values differ in kind."""
    kinds: dict[str, dict[str, list[Any]]] = {}
    for p in props:
        for name, value in p.items():
            if value is not None:
                kinds.setdefault(name, {}).setdefault(kind_of_value(value), []).append(value)
    columns = [(name, kind, column_of(name, kind if k else None), values) for name, by_kind in kinds.items() for k, (kind, values) in enumerate(by_kind.items())]
    fields = [T.StructField(c, _type_of(spark, values), True) for _, _, c, values in columns]
    schema = T.StructType([*T._parse_datatype_string(fixed_schema).fields, *fields])

    def cell(p: dict[str, Any], name: str, kind: str, dtype: T.DataType) -> Any:
        value = p.get(name)
        if value is None or kind_of_value(value) != kind:
            return None
        return float(value) if isinstance(dtype, T.DoubleType) else list(value) if isinstance(value, tuple) else value

    rows = [(*f, *[cell(p, name, kind, field.dataType) for (name, kind, _, _), field in zip(columns, fields, strict=True)]) for f, p in zip(fixed, props, strict=True)]
    return spark.createDataFrame(rows, schema)


def _type_of(spark: SparkSession, values: list[Any]) -> T.DataType:
    first = values[0]
    if kind_of_value(first) == "number":
        if any(isinstance(v, float) for v in values):
            return T.DoubleType()
        return T.LongType() if all(-(2**63) <= v < 2**63 for v in values) else T.DecimalType(38, 0)
    if isinstance(first, dict):
        return T.MapType(T.StringType(), T.StringType())
    return spark.createDataFrame([(list(first) if isinstance(first, tuple) else first,)], ["x"]).schema["x"].dataType



