"""Syntax trees of the query language."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class PropertyRef:
    """``variable`` or ``variable.property``."""

    variable: str
    name: str | None = None


@dataclass(frozen=True)
class Comparison:
    left: PropertyRef
    op: str
    value: Any


@dataclass(frozen=True)
class Membership:
    left: PropertyRef
    choices: Any


@dataclass(frozen=True)
class NullTest:
    left: PropertyRef
    negated: bool


@dataclass(frozen=True)
class Conjunction:
    parts: tuple[Comparison | Membership | NullTest, ...]


@dataclass(frozen=True)
class OrderItem:
    ref: PropertyRef
    descending: bool = False


@dataclass(frozen=True)
class ReturnItem:
    ref: PropertyRef
    name: str


@dataclass(frozen=True)
class NodePattern:
    """``(variable:Label {key: value})``; ``key`` is None without a property map."""

    variable: str
    labels: tuple[str, ...] = ()
    key: str | None = None
    value: Any = None


@dataclass(frozen=True)
class Hop:
    """One relationship from the node before it; ``direction`` is out, in or any."""

    variable: str | None
    types: tuple[str, ...]
    direction: str
    target: str


@dataclass(frozen=True)
class RelationshipPattern:
    """``(left)-[..]->(right)``, or the arrow reversed; ``source`` and ``target`` follow the edge."""

    left: str
    hop: Hop

    @property
    def source(self) -> str:
        return self.left if self.hop.direction == "out" else self.hop.target

    @property
    def target(self) -> str:
        return self.hop.target if self.hop.direction == "out" else self.left


@dataclass(frozen=True)
class AnchoredPattern:
    """``(variable {id: "..."})`` and one or more hops."""

    variable: str
    anchor: str
    hops: tuple[Hop, ...]


Pattern = NodePattern | RelationshipPattern | AnchoredPattern


@dataclass(frozen=True)
class MatchQuery:
    patterns: tuple[Pattern, ...]
    where: Conjunction | None
    items: tuple[ReturnItem, ...]
    distinct: bool = False
    order_by: tuple[OrderItem, ...] = ()
    skip: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class SampleCall:
    """``CALL pg.sample_typed_paths(seeds, pattern) YIELD path RETURN path``."""

    seeds: tuple[str, ...]
    pattern: tuple[dict[str, Any], ...]
    limit: int | None = None


def bound(patterns: tuple[Pattern, ...]) -> list[tuple[str, bool]]:
    """Variables by first appearance in the text, and whether each is a relationship."""
    found: dict[str, bool] = {}
    for p in patterns:
        if isinstance(p, NodePattern):
            found.setdefault(p.variable, False)
        elif isinstance(p, RelationshipPattern):
            found.setdefault(p.source, False)
            if p.hop.variable:
                found.setdefault(p.hop.variable, True)
            found.setdefault(p.target, False)
        else:
            found.setdefault(p.variable, False)
            for hop in p.hops:
                if hop.variable:
                    found.setdefault(hop.variable, True)
                found.setdefault(hop.target, False)
    return list(found.items())
