"""From query text to DataFrames: syntax, logical plan, compiler."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.types import VariantVal

from quiltgraph.plans.logical import LogicalPlan, plan
from quiltgraph.plans.parser import parse


class QueryResult:
    """``df`` is the result; ``records`` collects it when it is first asked for."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.columns = df, tuple(df.columns)

    @cached_property
    def records(self) -> list[dict[str, Any]]:
        return [{c: plain(row[k]) for k, c in enumerate(self.columns)} for row in self.df.collect()]

    def __iter__(self) -> Iterator[dict[str, Any]]:
        return iter(self.records)

    def __len__(self) -> int:
        return len(self.records)


def plain(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value.toPython() if isinstance(value, VariantVal) else value


def explain(text: str) -> LogicalPlan:
    """The logical plan of a query."""
    return plan(parse(text))


__all__ = ["LogicalPlan", "QueryResult", "explain", "parse", "plain", "plan"]
