"""Typed sampling, the same for the same seed.

A hop draws up to ``sample_size`` ways for each partial path by the rank of a
hash of seed, hop, path and way. Draws of different paths that meet at a node
are independent, as each has its own key, and no window spans more than the
ways at one node.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiltgraph.operators.traversal import checked, seeds, ways

RECORD = ("edge_id", "neighbor_id", "source_id", "target_id", "edge_type", "direction")
NO_PATH = "array<struct<" + ",".join(f"{c}:string" for c in RECORD) + ">>"


@dataclass(frozen=True)
class SamplingHop:
    """One hop of a pattern."""

    edge_type: str
    direction: str = "out"
    sample_size: int = 10

    def __post_init__(self) -> None:
        checked(self.direction)
        if self.sample_size < 1:
            raise ValueError("sample_size must be at least 1")


@dataclass(frozen=True)
class SamplingPattern:
    """Hops in order."""

    hops: tuple[SamplingHop, ...] = ()

    @classmethod
    def from_dicts(cls, hops: Iterable[Mapping[str, Any]]) -> SamplingPattern:
        return cls(tuple(as_sampling_hop(h) for h in hops))

    def to_dicts(self) -> list[dict[str, Any]]:
        return [asdict(h) for h in self.hops]


def as_sampling_hop(hop: SamplingHop | Mapping[str, Any]) -> SamplingHop:
    return hop if isinstance(hop, SamplingHop) else SamplingHop(**hop)


def as_sampling_pattern(pattern: SamplingPattern | Iterable[SamplingHop | Mapping[str, Any]]) -> SamplingPattern:
    return pattern if isinstance(pattern, SamplingPattern) else SamplingPattern(tuple(map(as_sampling_hop, pattern)))


def sample_neighbors(edges: DataFrame, ids: Sequence[str] | DataFrame, edge_type: str, direction: str = "out", sample_size: int = 10, seed: int = 0) -> DataFrame:
    """Up to ``sample_size`` ways from each node, without replacement: ``seed`` and the six fields of a way."""
    found = sample_paths(edges, ids, [SamplingHop(edge_type, direction, max(1, sample_size))], seed)
    found = found if sample_size >= 1 else found.limit(0)
    return found.select("seed", F.col("path")[0].alias("way")).select("seed", "way.*")


def sample_paths(edges: DataFrame, ids: Sequence[str] | DataFrame, pattern: Any, seed: int = 0) -> DataFrame:
    """``(seed, path)``: paths of full length only.

    An empty pattern gives an empty path for each seed, a repeated seed its
    paths again. Seeds need not exist. Neighbours aren't looked up as nodes.
    """
    start = seeds(edges.sparkSession, ids)
    rows = start.select("seed", F.col("seed").alias("at"), F.array().cast(NO_PATH).alias("path"), F.xxhash64(F.lit(seed), "seed_at", "seed").alias("draw"))
    for k, hop in enumerate(as_sampling_pattern(pattern).hops):
        step = ways(edges, [hop.edge_type], hop.direction)
        joined = rows.join(step, F.col("at") == F.col("start"))
        chance = F.xxhash64(F.lit(seed), F.lit(k), "draw", "edge_id", "direction")
        order = W.partitionBy("draw").orderBy(chance, "edge_id", "direction")
        drawn = joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hop.sample_size)
        rows = drawn.select("seed", F.col("neighbor_id").alias("at"), F.concat("path", F.array(F.struct(*RECORD))).alias("path"), F.xxhash64("draw", "edge_id", "direction").alias("draw"))
    return rows.select("seed", "path")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: Sequence[str] | DataFrame, pattern: Any, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and paths of a sample. All seeds are among the nodes; what doesn't exist has null columns but its id."""
    paths = sample_paths(edges, ids, pattern, seed)
    start = seeds(edges.sparkSession, ids)
    ways_taken = paths.select(F.explode("path").alias("w"))
    node_ids = start.select(F.col("seed").alias("id")).unionByName(ways_taken.select(F.col("w.source_id").alias("id"))).unionByName(ways_taken.select(F.col("w.target_id").alias("id"))).distinct()
    edge_ids = ways_taken.select(F.col("w.edge_id").alias("id")).distinct()
    return node_ids.join(nodes, "id", "left"), edge_ids.join(edges, "id", "left"), paths
