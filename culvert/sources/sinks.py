"""Sinks: canonical JSON, folders of JSON, single small files written whole or not at all."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


def _sorted_fields(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of all its objects, at any depth, in alphabetical order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_fields(x, kind.elementType))
    return value


def canonical_column(df: DataFrame) -> Column:
    """Canonical JSON of the row: fields in alphabetical order at every depth, nulls kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[_sorted_fields(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines; the commit protocol makes the folder appear whole."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_small_json(value, path: str) -> None:
    """One small JSON file, replaced atomically."""
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def network_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node and edge, per plan set and utility (a network is not gathered into one value)."""
    n = nodes.select("plan_id", "utility", F.lit("node").alias("part"), F.col("node_id").alias("id"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    e = edges.select("plan_id", "utility", F.lit("edge").alias("part"), F.col("edge_id").alias("id"), F.to_json(F.struct(*edges.columns)).alias("json"))
    return n.unionByName(e)


def network_from_json(lines: DataFrame, nodes: T.StructType, edges: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as ``network_json`` wrote them."""
    part = lambda name, schema: lines.filter(F.col("part") == name).select(F.from_json("json", schema).alias("r")).select("r.*")
    return part("node", nodes), part("edge", edges)
