"""Logical plans as DataFrames.

Every variable's columns are renamed ``variable__column`` before they are
joined, so self-joins are unambiguous. The seeks of a plan are filters here:
Parquet statistics, partitions and pushed predicates do what indexes would.
A node's row is joined for its existence; where the catalog says that all
ends exist and nothing but the id is asked for, that join is left out.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiltgraph.functions import predicates as P
from quiltgraph.model import Catalog
from quiltgraph.plans import logical as L
from quiltgraph.plans import syntax as S

ENDS = {"source": "src", "target": "dst"}


class Compiler:
    def __init__(self, nodes: DataFrame, edges: DataFrame, catalog: Catalog, parameters: Mapping[str, Any] | None, query: S.MatchQuery) -> None:
        self.nodes, self.edges, self.catalog = nodes, edges, catalog
        self.parameters, self.query = parameters or {}, query
        self.relationships = {v for v, is_rel in S.bound(query.patterns) if is_rel}
        self.rows: DataFrame | None = None
        self.aside: DataFrame | None = None
        self.single = False  # whether the rows so far are one node, found by its id
        self.bound: dict[str, bool] = {}
        self.keys: list[Column] = []

    # -- values ---------------------------------------------------------

    def given(self, value: Any) -> Any:
        """A literal as it is, a parameter's value from the parameters."""
        if not isinstance(value, S.Parameter):
            return value
        if value.name not in self.parameters:
            raise ValueError(f"Missing Cypher parameter: ${value.name}")
        return self.parameters[value.name]

    def property(self, variable: str, name: str) -> P.Values:
        """A property proper, which may share its name with an identity."""
        is_edge = variable in self.relationships
        if is_edge and name == "type":
            return [(F.col(f"{variable}__type"), "string")]
        found = (self.catalog.edges if is_edge else self.catalog.nodes).get(name, ())
        return [(F.col(f"`{variable}__{c}`"), kind) for c, kind in found]

    def values(self, ref: S.PropertyRef) -> P.Values:
        """What ``variable.name`` means in WHERE, RETURN and ORDER BY: identities first."""
        is_edge = ref.variable in self.relationships
        if ref.name == "id":
            return [(F.col(f"{ref.variable}__id"), "string")]
        if is_edge and ref.name in ENDS:
            return [(F.col(f"{ref.variable}__{ENDS[ref.name]}"), "string")]
        if not is_edge and ref.name == "labels":
            return [(F.col(f"{ref.variable}__labels"), "other")]
        return self.property(ref.variable, ref.name)

    def projected(self, ref: S.PropertyRef) -> Column:
        if ref.name is not None:
            return one_value(self.values(ref))
        known = self.catalog.edges if ref.variable in self.relationships else self.catalog.nodes
        v = ref.variable
        props = [one_value(self.property(v, p)).alias(p) for p in known]
        if v in self.relationships:
            return F.struct(F.col(f"{v}__id").alias("id"), F.col(f"{v}__src").alias("source"), F.col(f"{v}__dst").alias("target"), F.struct(F.col(f"{v}__type").alias("type"), *props).alias("properties"))
        return F.struct(F.col(f"{v}__id").alias("id"), F.col(f"{v}__labels").alias("labels"), (F.struct(*props) if props else F.lit(None).cast("struct<>")).alias("properties"))

    def needs_row(self, variable: str) -> bool:
        """Whether a node's row must be joined, or its id on an edge is enough."""
        if not self.catalog.whole:
            return True
        refs = [i.ref for i in (*self.query.items, *self.query.order_by)] + [p.left for p in (self.query.where.parts if self.query.where else ())]
        patterns = [p for p in self.query.patterns if isinstance(p, S.NodePattern) and p.variable == variable]
        return any(r.variable == variable and r.name != "id" for r in refs) or any(p.labels or p.key for p in patterns)

    # -- rows -----------------------------------------------------------

    def renamed(self, df: DataFrame, variable: str) -> DataFrame:
        return df.select([F.col(f"`{c}`").alias(f"{variable}__{c}") for c in df.columns])

    def labelled(self, df: DataFrame, labels: tuple[str, ...], prefix: str = "") -> DataFrame:
        keys = self.catalog.keys_with(labels)
        if labels and keys is not None:
            return df.where(F.col(f"{prefix}label_key").isin(keys))
        for label in labels:
            df = df.where(F.array_contains(f"{prefix}labels", label))
        return df

    def edges_of(self, types: tuple[str, ...]) -> DataFrame:
        return self.edges.where(F.col("type") == types[0] if len(types) == 1 else F.col("type").isin(list(types)))

    def meet(self, df: DataFrame, variable: str | None) -> None:
        """``df`` as the rows, or, after a CrossProduct, beside them."""
        self.rows = df if self.aside is None else self.aside.crossJoin(df)
        self.aside = None
        if variable:
            self.bound[variable] = False

    def scan(self, variable: str, labels: tuple[str, ...] = (), key: str | None = None, value: Any = None) -> None:
        df = self.renamed(self.labelled(self.nodes, labels), variable)
        if key:
            df = df.where(P.equals(self.property(variable, key), self.given(value)))
        self.meet(df, variable)

    def attach(self, rows: DataFrame, end: str, variable: str) -> DataFrame:
        """The node ``variable`` at the column ``end``, which is dropped."""
        if variable in self.bound:
            return rows.where(F.col(end) == F.col(f"{variable}__id")).drop(end)
        self.bound[variable] = False
        if not self.needs_row(variable):
            return rows.withColumnRenamed(end, f"{variable}__id")
        return rows.join(self.renamed(self.nodes, variable), F.col(end) == F.col(f"{variable}__id")).drop(end)

    def relationship(self, edges: DataFrame, variable: str | None) -> DataFrame:
        """Edges with their ends under names of their own, and the variable's columns if there is one."""
        ends = [F.col("src").alias("_src"), F.col("dst").alias("_dst")]
        if not variable:
            return edges.select(*ends)
        if variable in self.bound:
            return edges.select(F.col("id").alias("_edge"), *ends)
        return edges.select(*[F.col(f"`{c}`").alias(f"{variable}__{c}") for c in edges.columns], *ends)

    def same_edge(self, rows: DataFrame, variable: str | None) -> DataFrame:
        if variable and variable in self.bound:
            return rows.where(F.col("_edge") == F.col(f"{variable}__id")).drop("_edge")
        if variable:
            self.bound[variable] = True
        return rows

    # -- steps ----------------------------------------------------------

    def run(self, plan: L.LogicalPlan) -> DataFrame:
        for step in plan.steps:
            getattr(self, type(step).__name__)(step)
        return self.rows

    def NodeByIdSeek(self, step: L.NodeByIdSeek) -> None:
        self.single = self.rows is None
        self.meet(self.renamed(self.nodes.where(F.col("id") == step.id), step.variable), step.variable)

    def NodeAllScan(self, step: L.NodeAllScan) -> None:
        self.scan(step.variable)

    def NodeLabelScan(self, step: L.NodeLabelScan) -> None:
        self.scan(step.variable, step.labels)

    def NodePropertySeek(self, step: L.NodePropertySeek) -> None:
        self.scan(step.variable, step.labels, step.key, step.value)

    def NodePropertyRangeSeek(self, step: L.NodePropertyRangeSeek) -> None:
        for p in step.predicates:
            self.rows = self.rows.where(self.condition(p))

    RelationshipPropertyRangeSeek = NodePropertyRangeSeek

    def RelationshipPropertySeek(self, step: L.RelationshipPropertySeek) -> None:
        self.rows = self.rows.where(self.condition(step.predicate))

    def RelationshipTypeScan(self, step: L.RelationshipTypeScan) -> None:
        found = self.relationship(self.edges_of(step.types), step.variable)
        if step.variable and step.variable in self.bound:  # only the relationship is shared with the rows
            found = self.same_edge(self.rows.join(found, F.col("_edge") == F.col(f"{step.variable}__id")), step.variable)
        else:
            self.same_edge(found, step.variable)
        aside, self.aside = self.aside, None
        if step.source == step.target:
            found = self.attach(found.where("_src = _dst").drop("_dst"), "_src", step.source)
        else:
            found = self.attach(self.attach(found, "_src", step.source), "_dst", step.target)
        self.aside = aside
        self.meet(found, None)

    def Expand(self, step: L.Expand) -> None:
        hop = step.hop
        edges = self.relationship(self.edges_of(hop.types), hop.variable)
        others = [c for c in edges.columns if c not in ("_src", "_dst")]
        turned = lambda a, b: edges.select(*[F.col(f"`{c}`") for c in others], F.col(a).alias("_from"), F.col(b).alias("_to"))
        if hop.direction == "any":
            ways = turned("_src", "_dst").unionAll(turned("_dst", "_src"))
        else:
            ways = turned("_src", "_dst") if hop.direction == "out" else turned("_dst", "_src")
        rows = F.broadcast(self.rows) if self.single else self.rows  # one row
        self.single = False
        joined = rows.join(ways, F.col(f"{step.source}__id") == F.col("_from")).drop("_from")
        self.rows = self.attach(self.same_edge(joined, hop.variable), "_to", hop.target)

    def FilterNodeProperty(self, step: L.FilterNodeProperty) -> None:
        p = step.pattern
        self.rows = self.labelled(self.rows, p.labels, f"{p.variable}__")
        if p.key:
            self.rows = self.rows.where(P.equals(self.property(p.variable, p.key), self.given(p.value)))

    def FilterNodeId(self, step: L.FilterNodeId) -> None:
        self.rows = self.rows.where(F.col(f"{step.variable}__id") == step.id)

    def CrossProduct(self, step: L.CrossProduct) -> None:
        self.aside, self.single = self.rows, False

    def condition(self, part: S.Comparison | S.Membership | S.NullTest) -> Column:
        values = self.values(part.left)
        if isinstance(part, S.NullTest):
            return ~P.is_null(values) if part.negated else P.is_null(values)
        if isinstance(part, S.Membership):
            choices = self.given(part.choices)
            if not isinstance(choices, list | tuple | set | frozenset):
                raise ValueError("IN expects a list, tuple, or set value")
            return P.is_in(values, list(choices))
        value = self.given(part.value)
        if part.op == "=":
            return P.equals(values, value)
        return P.differs(values, value) if part.op == "<>" else P.compares(values, part.op, value)

    def FilterExpression(self, step: L.FilterExpression) -> None:
        for part in step.expression.parts:
            self.rows = self.rows.where(self.condition(part))

    def Sort(self, step: L.Sort) -> None:
        names = {i.name: i.ref for i in self.query.items}
        for item in step.items:
            ref = names.get(item.ref.variable, item.ref) if item.ref.name is None else item.ref
            if ref.name is None:
                ref = S.PropertyRef(ref.variable, "id")
            values = self.values(ref)
            sorted_by = [F.when(c.isNotNull(), F.lit(k)) for c, k in values] if len(values) > 1 else []
            for c in [F.coalesce(*sorted_by)] * bool(sorted_by) + [c for c, _ in values]:
                self.keys.append(c.desc_nulls_first() if item.descending else c.asc_nulls_last())
        self.keys += [F.col(f"{v}__id").asc() for v in self.bound]  # a total order

    def Project(self, step: L.Project) -> None:
        out = [self.projected(i.ref).alias(i.name) for i in step.items]
        if not self.query.distinct:
            if self.keys:
                self.rows = self.rows.orderBy(*self.keys)
            self.rows = self.rows.select(*out)
            return
        same = [distinct_key(self.values(S.PropertyRef(i.ref.variable, i.ref.name or "id"))) for i in step.items]
        rows = self.rows.select("*", *[c.alias(f"_same{k}") for k, c in enumerate(same)])
        marks = [f"_same{k}" for k in range(len(same))]
        if self.keys:  # the first of each in order stays, so that the order of what is left is that of the rows
            first = F.row_number().over(W.partitionBy(*marks).orderBy(*self.keys))
            rows = rows.withColumn("_first", first).where("_first = 1").orderBy(*self.keys)
        else:
            rows = rows.dropDuplicates(marks)
        self.rows = rows.select(*out)

    def Distinct(self, step: L.Distinct) -> None:
        """Done with the projection, which still sees the variables."""

    def Skip(self, step: L.Skip) -> None:
        self.rows = self.rows.offset(step.count)

    def Limit(self, step: L.Limit) -> None:
        self.rows = self.rows.limit(step.count)


def one_value(values: P.Values) -> Column:
    """A property as one column; of several kinds, as a variant."""
    if not values:
        return F.lit(None).cast("string")
    if len(values) == 1:
        return values[0][0]
    return F.coalesce(*[c.cast("variant") for c, _ in values])


def distinct_key(values: P.Values) -> Column:
    return F.struct(*[c for c, _ in values]) if values else F.lit(None).cast("string")
