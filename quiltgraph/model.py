"""Entities, and how property graphs are laid out as DataFrames.

A node is a row ``id, labels, label_key`` and a column for each property, an
edge a row ``id, src, dst, type`` and its properties. Property columns carry
``PREFIX``, so a property may be called ``id``. A property whose values differ
in kind between entities has a column for each kind.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PREFIX = "p__"
KIND_MARK = "__as_"
KINDS = ("number", "string", "boolean", "other")
NODE_COLUMNS = ("id", "labels", "label_key")
EDGE_COLUMNS = ("id", "src", "dst", "type")


def label_tuple(labels: str | Iterable[str] | None) -> tuple[str, ...]:
    """Labels in order, each once."""
    return tuple(dict.fromkeys([labels] if isinstance(labels, str) else labels or ()))


def text_id(value: str | bytes | Any) -> str:
    """An id as a string: bytes are decoded, entities give their own."""
    if isinstance(value, bytes):
        return value.decode()
    return value.id if isinstance(value, Node | Edge) else value


@dataclass
class Node:
    """An attributed node. Ids default to fresh UUIDs."""

    id: str = field(default_factory=lambda: str(uuid4()))
    properties: dict[str, Any] = field(default_factory=dict)
    labels: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self.id, self.labels = text_id(self.id), label_tuple(self.labels)

    def to_dict(self) -> dict[str, Any]:
        return {"id": self.id, "properties": self.properties, "labels": list(self.labels)}

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Node:
        return cls(data["id"], dict(data.get("properties") or {}), data.get("labels") or ())


@dataclass
class Edge:
    """A directed edge. Its relationship type is the property ``type``; without one no typed traversal sees it."""

    source: str
    target: str
    id: str = field(default_factory=lambda: str(uuid4()))
    properties: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.id, self.source, self.target = text_id(self.id), text_id(self.source), text_id(self.target)

    @property
    def type(self) -> str | None:
        return self.properties.get("type")

    def to_dict(self) -> dict[str, Any]:
        return {"id": self.id, "source": self.source, "target": self.target, "properties": self.properties}

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Edge:
        return cls(data["source"], data["target"], data["id"], dict(data.get("properties") or {}))


@dataclass
class TimeIndexedEdge(Edge):
    """An edge with a time; it is kept as the property ``timestamp``, so ordering by it and the id is by time."""

    timestamp: datetime | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.timestamp is not None:
            self.properties = self.properties | {"timestamp": self.timestamp}


def edge_type(edge: Edge | dict[str, Any]) -> str | None:
    """The relationship type of an edge or of its dictionary."""
    return (edge.properties if isinstance(edge, Edge) else edge.get("properties") or {}).get("type")


def kind_of_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.StringType):
        return "string"
    return "boolean" if isinstance(dtype, T.BooleanType) else "other"


def kind_of_value(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    return "string" if isinstance(value, str) else "other"


def column_of(name: str, kind: str | None = None) -> str:
    return f"{PREFIX}{name}{KIND_MARK}{kind}" if kind else f"{PREFIX}{name}"


@dataclass(frozen=True)
class Catalog:
    """Which properties the frames have, by name: ``{property: ((column, kind), ...)}``.

    ``label_keys``: all label keys there are, where known; label tests then
    become a choice of keys, which prunes partitions and branches of unions.
    ``whole``: every edge's ends are known to exist.
    """

    nodes: dict[str, tuple[tuple[str, str], ...]]
    edges: dict[str, tuple[tuple[str, str], ...]]
    label_keys: tuple[str, ...] | None = None
    whole: bool = False

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, label_keys: Iterable[str] | None = None, whole: bool = False) -> Catalog:
        return cls(properties(nodes), properties(edges), None if label_keys is None else tuple(sorted(label_keys)), whole)

    def keys_with(self, labels: Iterable[str]) -> list[str] | None:
        if self.label_keys is None:
            return None
        return [k for k in self.label_keys if set(labels) <= set(k.split(";"))]


def properties(df: DataFrame) -> dict[str, tuple[tuple[str, str], ...]]:
    found: dict[str, list[tuple[str, str]]] = {}
    for item in df.schema.fields:
        if item.name.startswith(PREFIX):
            name = item.name[len(PREFIX) :].split(KIND_MARK)[0]
            found.setdefault(name, []).append((item.name, kind_of_type(item.dataType)))
    return {k: tuple(v) for k, v in found.items()}
