"""Label, type, property and range lookups over one frame."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions import predicates as P
from quiltgraph.model import PREFIX, properties


def values_of(df: DataFrame, name: str) -> P.Values:
    if name == "type" and "type" in df.columns:
        return [(F.col("type"), "string")]
    return [(F.col(f"`{c}`"), kind) for c, kind in properties(df).get(name, ())]


def with_labels(nodes: DataFrame, *labels: str) -> DataFrame:
    for label in labels:
        nodes = nodes.where(F.array_contains("labels", label))
    return nodes


def with_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("type") == kind)


def with_property(df: DataFrame, name: str, value: Any) -> DataFrame:
    """Equal values; None finds the rows without the property."""
    return df.where(P.equals(values_of(df, name), value))


def with_range(df: DataFrame, name: str, start: Any = None, end: Any = None, include_start: bool = True, include_end: bool = True) -> DataFrame:
    return df.where(P.within(values_of(df, name), start, end, include_start, include_end))


def having(df: DataFrame, name: str) -> DataFrame:
    """Rows with the property, not null."""
    return df.where(~P.is_null(values_of(df, name)))


def page_of_ids(df: DataFrame, count: int, start: str | None = None) -> DataFrame:
    """``count`` ids in byte order from ``start`` on, itself included."""
    ids = df.select("id")
    return (ids if start is None else ids.where(F.col("id") >= start)).orderBy("id").limit(count)


def upserted(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those of the same id; columns of either are kept."""
    return added(base.join(new.select("id"), "id", "left_anti"), new)


def added(base: DataFrame, new: DataFrame) -> DataFrame:
    """Both, with a column for each kind where a property differs in kind."""
    have, fresh = properties(base), properties(new)
    for name, columns in fresh.items():
        for column, kind in columns:
            known = dict(have.get(name, ()))
            if known and kind not in known.values():
                new = new.withColumnRenamed(column, f"{PREFIX}{name}__as_{kind}")
            elif known:
                same = next(c for c, k in known.items() if k == kind)
                if same != column:
                    new = new.withColumnRenamed(column, same)
                if kind == "number" and base.schema[same].dataType != new.schema[same].dataType:
                    base, new = (d.withColumn(same, F.col(f"`{same}`").cast("double")) for d in (base, new))
    return base.unionByName(new, allowMissingColumns=True)


def without(df: DataFrame, column: str, ids: Iterable[str]) -> DataFrame:
    return df.where(~F.col(column).isin(list(ids)))
