"""Sinks: table swaps, JSON and GraphML exports, append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import xml_escape


def swap(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``: written beside it first, so a reader never sees half of it."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    at = Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(at)
    if had and not fs.rename(at, Path(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(Path(new), at):
        raise OSError(f"cannot move {new}")
    if had:
        fs.delete(Path(old), True)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, json``: one line per node and per edge, in a stable order within each kind; scales with partitions, not one document."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*[F.col(c) for c in nodes.columns])).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", "type")).alias("json")))


def graphml(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``part, value``: lines of a GraphML document; write them sorted by part (0 head, 1 nodes, 2 edges, 3 end)."""
    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *[f'<key id="{k}" for="node" attr.name="{k}" attr.type="string"/>' for k in keys], '<key id="type" for="edge" attr.name="type" attr.type="string"/>', '<graph id="G" edgedefault="directed">']
    data = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f'<data key="{k}">'), xml_escape(F.col(k).cast("string")), F.lit("</data>"))) for k in keys]
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">'), F.concat_ws("", *data), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('"><data key="type">'), xml_escape(F.col("type")), F.lit("</data></edge>")).alias("value"))
    fixed = spark.createDataFrame([(0, "\n".join(head)), (3, "</graph>\n</graphml>")], "part int, value string")
    return fixed.unionByName(n).unionByName(e)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)
