"""Spark-native property-graph analytics."""

from quiltgraph.graph import PropertyGraph
from quiltgraph.model import Edge, Node, TimeIndexedEdge
from quiltgraph.operators.sampler import SamplingHop, SamplingPattern
from quiltgraph.plans import QueryResult
from quiltgraph.sources.ingest import ColumnarIngestionMode, EdgeList, IndexMaintenanceMode, NodeList

__all__ = ["ColumnarIngestionMode", "Edge", "EdgeList", "IndexMaintenanceMode", "Node", "NodeList", "PropertyGraph", "QueryResult", "SamplingHop", "SamplingPattern", "TimeIndexedEdge"]
