"""Deterministic graphs of any size: nodes ``n{i}``, edges ``e{i}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.model import PREFIX

SHAPES = ("synthetic", "star", "typed_path")


def generated(spark: SparkSession, shape: str, n_nodes: int = 100_000, n_edges: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """``group = i % 128`` on nodes and ``weight = i % 1000`` on edges.

    synthetic: ``i % N`` to ``(i * 9973 + 1) % N``, types RelA, RelB, RelC in turn;
    star: node 0 to ``1 + i % (N - 1)``, RelA;
    typed_path: ``i % N`` to the next node, RelA and RelB in turn.
    """
    if shape not in SHAPES:
        raise ValueError(f"shape must be one of: {', '.join(SHAPES)}")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    i = F.col("i")
    nodes = spark.range(n_nodes).select(name(F.col("id")).alias("id"), F.array(F.lit("Node")).alias("labels"), F.lit("Node").alias("label_key"), (F.col("id") % 128).alias(f"{PREFIX}group"))
    types = {"synthetic": ["RelA", "RelB", "RelC"], "star": ["RelA"], "typed_path": ["RelA", "RelB"]}[shape]
    src = F.lit(0) if shape == "star" else i % n_nodes
    dst = {"synthetic": (i * 9973 + 1) % n_nodes, "star": 1 + i % (n_nodes - 1), "typed_path": (i % n_nodes + 1) % n_nodes}[shape]
    kind = F.array(*map(F.lit, types))[(i % len(types)).cast("int")]
    edges = spark.range(n_edges).withColumnRenamed("id", "i").select(F.concat(F.lit("e"), i.cast("string")).alias("id"), name(src).alias("src"), name(dst).alias("dst"), kind.alias("type"), (i % 1000).alias(f"{PREFIX}weight"))
    return nodes, edges
