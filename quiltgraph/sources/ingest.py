"""Bulk columnar ingestion: checked columns to entity rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from enum import StrEnum
from typing import Any
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltgraph.model import PREFIX
from quiltgraph.sources import msgpack
from quiltgraph.sources.shared import shared_folder

#: Rows of a lazy frame that the driver holds at a time.
CHUNK_ROWS = 1_000_000


class ColumnarIngestionMode(StrEnum):
    ENTITY_COLUMNS = "entity_columns"
    SERIALIZED_PAYLOADS = "serialized_payloads"


class PayloadFormat(StrEnum):
    JSON = "json"
    MESSAGEPACK = "messagepack"


class IndexMaintenanceMode(StrEnum):
    MAINTAIN = "maintain"
    DEFER = "defer"
    DEFER_REBUILD = "defer_rebuild"


def chosen(kind: type[StrEnum], value: str, *allowed: StrEnum) -> StrEnum:
    some = allowed or tuple(kind)
    try:
        found = kind(value)
    except ValueError:
        found = None
    if found not in some:
        raise ValueError(f"{kind.__name__} must be one of: {', '.join(some)}")
    return found


def framed(spark: SparkSession, data: Any) -> DataFrame:
    """A DataFrame from one, or from anything that gives an Arrow table (Arrow, Polars eager or lazy, pandas).

    A lazy frame is collected ``CHUNK_ROWS`` rows at a time, which are written
    to the shared folder, so the driver never holds all of it.
    """
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "collect") and not hasattr(data, "to_arrow"):
        return _chunked(spark, data)
    if hasattr(data, "to_arrow"):
        data = data.to_arrow()
    if not isinstance(data, pa.Table):
        data = pa.Table.from_pandas(data, preserve_index=False)
    return spark.createDataFrame(data)


def _chunked(spark: SparkSession, lazy: Any) -> DataFrame:
    folder = f"{shared_folder(spark)}/lazy-{uuid4().hex}"
    schema, at, size = None, 0, CHUNK_ROWS
    while size == CHUNK_ROWS:
        chunk = lazy.slice(at, CHUNK_ROWS).collect().to_arrow()
        size, at = chunk.num_rows, at + chunk.num_rows
        rows = spark.createDataFrame(chunk)
        schema = schema or rows.schema
        rows.write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def required(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def no_nulls(df: DataFrame, *columns: str) -> None:
    """One pass over the columns; the first with a null is named."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first()
    for c in columns:
        if counts[c]:
            raise ValueError(f"{c} must not contain nulls")


def _props(df: DataFrame, given: Sequence[str] | None, taken: Sequence[str]) -> list[str]:
    if given is None:
        return [c for c in df.columns if c not in taken]
    missing = [c for c in given if c not in df.columns]
    if missing:
        raise ValueError(f"missing property columns: {', '.join(missing)}")
    return list(given)


def label_key(labels: Any) -> Any:
    return F.array_join(F.array_sort(labels), ";")


def node_rows(df: DataFrame, id_column: str = "node_id", labels_column: str | None = "labels", property_columns: Sequence[str] | None = None) -> DataFrame:
    """Nodes from columns; labels may be a list or one string, and may be absent."""
    required(df, id_column)
    no_nulls(df, id_column)
    props = _props(df, property_columns, (id_column, labels_column))
    labels = F.array().cast("array<string>")
    if labels_column in df.columns:
        raw = F.col(f"`{labels_column}`")
        given = raw if isinstance(df.schema[labels_column].dataType, T.ArrayType) else F.array_compact(F.array(raw))
        labels = F.coalesce(F.array_distinct(given), labels)
    out = df.select(F.col(f"`{id_column}`").cast("string").alias("id"), labels.alias("labels"), *[F.col(f"`{c}`").alias(PREFIX + c) for c in props])
    return out.select("id", "labels", label_key(F.col("labels")).alias("label_key"), *[F.col(f"`{PREFIX}{c}`") for c in props])


def edge_rows(df: DataFrame, id_column: str = "edge_id", source_column: str = "source", target_column: str = "target", type_column: str = "edge_type", property_columns: Sequence[str] | None = None) -> DataFrame:
    """Edges from columns. The type comes from its own column; a property column ``type`` is dropped."""
    fixed = (id_column, source_column, target_column, type_column)
    required(df, *fixed)
    no_nulls(df, *fixed)
    props = [c for c in _props(df, property_columns, fixed) if c != "type"]
    named = [F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(fixed, ("id", "src", "dst", "type"), strict=True)]
    return df.select(*named, *[F.col(f"`{c}`").alias(PREFIX + c) for c in props])


def decoded(df: DataFrame, payload: str, form: str = "json") -> tuple[DataFrame, list[str]]:
    """Payloads' properties as columns; their types are inferred from all payloads."""
    form = chosen(PayloadFormat, form)
    text = F.col(f"`{payload}`").cast("string") if form == PayloadFormat.JSON else msgpack.as_json(F.col(f"`{payload}`"))
    variants = df.withColumn("_payload", F.try_parse_json(text))
    if variants.where(F.col("_payload").isNull()).limit(1).count():
        raise TypeError(f"{payload} must hold payloads in {form}")
    kind = variants.agg(F.schema_of_variant_agg("_payload")).first()[0]
    ddl = kind.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    rows = df.withColumn("_payload", F.from_json(text, ddl))
    found = next((f.dataType for f in rows.schema["_payload"].dataType.fields if f.name == "properties"), None)
    names = found.fieldNames() if isinstance(found, T.StructType) else []
    return rows.select("*", *[F.col(f"_payload.properties.`{n}`").alias(PREFIX + n) for n in names]), names


def node_payload_rows(df: DataFrame, id_column: str = "node_id", payload: str = "node_value", form: str = "json") -> DataFrame:
    required(df, id_column, payload)
    no_nulls(df, id_column, payload)
    rows, names = decoded(df, payload, form)
    has = "labels" in rows.schema["_payload"].dataType.fieldNames()
    labels = F.coalesce(F.col("_payload.labels").cast("array<string>"), F.array().cast("array<string>")) if has else F.array().cast("array<string>")
    out = rows.withColumn("_labels", labels)
    return out.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col("_labels").alias("labels"), label_key(F.col("_labels")).alias("label_key"), *[F.col(f"`{PREFIX}{n}`") for n in names])


def edge_payload_rows(df: DataFrame, id_column: str = "edge_id", source_column: str = "source", target_column: str = "target", type_column: str = "edge_type", payload: str = "edge_value", form: str = "json") -> DataFrame:
    fixed = (id_column, source_column, target_column, type_column)
    required(df, *fixed, payload)
    no_nulls(df, *fixed, payload)
    rows, names = decoded(df, payload, form)
    named = [F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(fixed, ("id", "src", "dst", "type"), strict=True)]
    return rows.select(*named, *[F.col(f"`{PREFIX}{n}`") for n in names if n != "type"])


def payload(entity: Any, form: str = "json") -> bytes:
    """An entity as a payload."""
    if chosen(PayloadFormat, form) == PayloadFormat.MESSAGEPACK:
        return msgpack.packed(entity.to_dict())
    return json.dumps(entity.to_dict(), separators=(",", ":")).encode()


def _checked(name: str, values: Any, kinds: tuple[type, ...]) -> list[Any]:
    values = values.to_pylist() if hasattr(values, "to_pylist") else list(values)
    if any(v is None for v in values):
        raise ValueError(f"{name} must not contain nulls")
    if not all(isinstance(v, kinds) for v in values):
        raise TypeError(f"{name} must hold {' or '.join(k.__name__ for k in kinds)}")
    return values


@dataclass
class NodeList:
    """Ids with serialized nodes, checked."""

    node_ids: Any
    node_values: Any

    def __post_init__(self) -> None:
        self.node_ids = _checked("node_ids", self.node_ids, (str, bytes))
        self.node_values = _checked("node_values", self.node_values, (bytes,))
        if len(self.node_ids) != len(self.node_values):
            raise ValueError("node_ids and node_values must have equal lengths")

    @classmethod
    def from_arrow(cls, table: pa.Table, id_column: str = "node_id", value_column: str = "node_value") -> NodeList:
        _has(table, id_column, value_column)
        return cls(table.column(id_column), table.column(value_column))

    def __len__(self) -> int:
        return len(self.node_ids)

    def to_arrow(self) -> pa.Table:
        return pa.table({"node_id": _texts(self.node_ids), "node_value": pa.array(self.node_values, pa.binary())})

    def chunks(self, chunk_size: int) -> Iterator[NodeList]:
        for k in _starts(len(self), chunk_size):
            yield NodeList(self.node_ids[k : k + chunk_size], self.node_values[k : k + chunk_size])


@dataclass
class EdgeList:
    """Ids, ends and types with serialized edges, checked."""

    edge_ids: Any
    sources: Any
    targets: Any
    edge_types: Any
    edge_values: Any = None

    def __post_init__(self) -> None:
        for name in ("edge_ids", "sources", "targets", "edge_types"):
            setattr(self, name, _checked(name, getattr(self, name), (str, bytes)))
        if self.edge_values is not None:
            self.edge_values = _checked("edge_values", self.edge_values, (bytes,))
        columns = [self.edge_ids, self.sources, self.targets, self.edge_types, *([self.edge_values] if self.edge_values is not None else [])]
        if len({len(c) for c in columns}) > 1:
            raise ValueError("edge columns must have equal lengths")

    @classmethod
    def from_arrow(cls, table: pa.Table, id_column: str = "edge_id", source_column: str = "source", target_column: str = "target", type_column: str = "edge_type", value_column: str = "edge_value") -> EdgeList:
        _has(table, id_column, source_column, target_column, type_column)
        values = table.column(value_column) if value_column in table.column_names else None
        return cls(table.column(id_column), table.column(source_column), table.column(target_column), table.column(type_column), values)

    def __len__(self) -> int:
        return len(self.edge_ids)

    def to_arrow(self) -> pa.Table:
        table = {"edge_id": _texts(self.edge_ids), "source": _texts(self.sources), "target": _texts(self.targets), "edge_type": _texts(self.edge_types)}
        return pa.table(table | ({"edge_value": pa.array(self.edge_values, pa.binary())} if self.edge_values is not None else {}))

    def chunks(self, chunk_size: int) -> Iterator[EdgeList]:
        for k in _starts(len(self), chunk_size):
            cut = slice(k, k + chunk_size)
            yield EdgeList(self.edge_ids[cut], self.sources[cut], self.targets[cut], self.edge_types[cut], self.edge_values[cut] if self.edge_values is not None else None)


def _has(table: pa.Table, *columns: str) -> None:
    missing = [c for c in columns if c not in table.column_names]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def _texts(values: list[Any]) -> pa.Array:
    return pa.array([v.decode() if isinstance(v, bytes) else v for v in values], pa.string())


def _starts(n: int, chunk_size: int) -> range:
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    return range(0, n, chunk_size)
