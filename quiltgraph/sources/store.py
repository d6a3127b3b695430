"""Versioned Parquet folders.

``v=N`` holds a version: nodes partitioned by label key, edges by type. A
manifest names the current version and is replaced by a rename, so a reader
sees a version whole or not at all. Paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.model import EDGE_COLUMNS, NODE_COLUMNS

MANIFEST = "_CURRENT"


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def manifest(self) -> dict[str, Any] | None:
        where = self._path(MANIFEST)
        if not self._fs.exists(where):
            return None
        stream = self._fs.open(where)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, nodes: DataFrame, edges: DataFrame, extra: dict[str, Any] | None = None) -> dict[str, Any]:
        """Writes the next version, then makes it current."""
        version = ((self.manifest() or {}).get("version") or 0) + 1
        folder = f"{self.path}/v={version:06d}"
        # sorted files give narrow ranges of ids to Parquet's statistics
        nodes.sortWithinPartitions("label_key", "id").write.mode("overwrite").partitionBy("label_key").parquet(f"{folder}/nodes")
        edges.sortWithinPartitions("type", "src").write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
        keys = [r[0] or "" for r in self.spark.read.schema(nodes.schema).parquet(f"{folder}/nodes").select("label_key").distinct().collect()]
        entry = {"version": version, "label_keys": sorted(keys), "nodes": nodes.schema.json(), "edges": edges.schema.json(), **(extra or {})}
        self._replace(MANIFEST, json.dumps(entry))
        return entry

    def _replace(self, name: str, text: str) -> None:
        fresh, target = self._path(f"{name}.new"), self._path(name)
        out = self._fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fresh, target, options)

    def load(self) -> tuple[DataFrame, DataFrame, dict[str, Any]] | None:
        from pyspark.sql.types import StructType

        entry = self.manifest()
        if entry is None:
            return None
        frames = []
        for name, first, key in (("nodes", NODE_COLUMNS, "label_key"), ("edges", EDGE_COLUMNS, "type")):
            schema = StructType.fromJson(json.loads(entry[name]))
            df = self.spark.read.schema(schema).parquet(f"{self.path}/v={entry['version']:06d}/{name}")
            rest = [c for c in df.columns if c not in first]
            if name == "nodes":  # a node without labels lies in the partition without a key
                df = df.withColumn(key, F.coalesce(key, F.lit("")))
            frames.append(df.select(*first, *[F.col(f"`{c}`") for c in rest]))
        return frames[0], frames[1], entry
