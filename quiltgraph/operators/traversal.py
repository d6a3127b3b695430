"""Adjacency and breadth-first search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.sources.shared import checkpointed

DIRECTIONS = ("out", "in", "any")


def checked(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError("direction must be 'out', 'in', or 'any'")
    return direction


def ways(edges: DataFrame, types: Sequence[str] | None, direction: str, typed: bool = True) -> DataFrame:
    """Edges as ways to go: ``start, edge_id, neighbor_id, source_id, target_id, edge_type, direction``.

    ``any`` is out and in together, so a self-loop is two ways. Untyped edges
    are left out unless ``typed`` is false.
    """
    checked(direction)
    if types is not None:
        edges = edges.where(F.col("type") == types[0] if len(types) == 1 else F.col("type").isin(list(types)))
    elif typed:
        edges = edges.where(F.col("type").isNotNull())

    def one(start: str, end: str, name: str) -> DataFrame:
        return edges.select(F.col(start).alias("start"), F.col("id").alias("edge_id"), F.col(end).alias("neighbor_id"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("type").alias("edge_type"), F.lit(name).alias("direction"))

    if direction == "any":
        return one("src", "dst", "out").unionAll(one("dst", "src", "in"))
    return one("src", "dst", "out") if direction == "out" else one("dst", "src", "in")


def seeds(spark: SparkSession, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Seeds with their place in the list: ``seed_at, seed``. A DataFrame's first column is the ids; its places follow its rows."""
    if isinstance(ids, DataFrame):
        return ids.select(F.monotonically_increasing_id().alias("seed_at"), F.col(f"`{ids.columns[0]}`").alias("seed"))
    return spark.createDataFrame([(k, s) for k, s in enumerate(ids)], "seed_at long, seed string")


def bfs(edges: DataFrame, start: str | Sequence[str], direction: str = "any", depth: int | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """``(id, depth)`` of all nodes reachable from ``start``, itself at depth 0.

    All edges count, typed or not, unless ``types`` names some; a start need
    not exist. Each round joins only the frontier; its result is checkpointed,
    and a count reaches the driver.
    """
    spark = edges.sparkSession
    first = [start] if isinstance(start, str) else list(start)
    hops = ways(edges, types, direction, typed=False).select("start", "neighbor_id")
    seen = frontier = spark.createDataFrame([(s,) for s in dict.fromkeys(first)], "id string").withColumn("depth", F.lit(0))
    level = 0
    while depth is None or level < depth:
        level += 1
        near = hops.join(frontier.select(F.col("id").alias("start")), "start", "left_semi").select(F.col("neighbor_id").alias("id")).distinct()
        frontier = checkpointed(near.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % 8 == 0:
            seen = checkpointed(seen)
    return seen


def adjacency(edges: DataFrame, node: str, direction: str = "any") -> DataFrame:
    """Edge ids at a node: ``forward`` those that it is the target of, ``backward`` those that it is the source of."""
    tests = {"forward": F.col("dst") == node, "backward": F.col("src") == node, "any": (F.col("dst") == node) | (F.col("src") == node)}
    if direction not in tests:
        raise ValueError("direction must be 'forward', 'backward', or 'any'")
    return edges.where(tests[direction]).select("id").distinct()
