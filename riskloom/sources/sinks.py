"""Sinks: graphs, feeds and transfer packages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sanitised(attrs: Column) -> Column:
    """A VARIANT's scalars as text, lists and objects as JSON, null as the empty text."""
    return F.coalesce(F.when(F.schema_of_variant(attrs).rlike("^(ARRAY|OBJECT)"), F.to_json(attrs)).otherwise(F.try_variant_get(attrs, "$", "string")), F.lit(""))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K1: the graph as two Parquet tables, the form to work with."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def _xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def save_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K1: the graph in GraphML, for exchange: every part file is a document of its own with its keys, so the write is distributed.

    Attributes are keyed by name. nodes: node_id, node_type, attrs; edges: src, dst, relation.
    """
    names = sorted(r[0] for r in nodes.select(F.explode(F.map_keys("attrs"))).distinct().collect())  # attribute names are a fixed vocabulary
    head = ['<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="node_type" for="node" attr.name="node_type" attr.type="string"/>', '<key id="relation" for="edge" attr.name="relation" attr.type="string"/>']
    head += [f'<key id="{k}" for="node" attr.name="{k}" attr.type="string"/>' for k in names]
    data = lambda key, value: F.concat(F.lit('<data key="'), key, F.lit('">'), _xml(F.coalesce(value, F.lit(""))), F.lit("</data>"))
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: data(e["key"], e["value"])), "")
    n = nodes.select(F.concat(F.lit('<node id="'), _xml(F.col("node_id")), F.lit('">'), data(F.lit("node_type"), F.col("node_type")), F.coalesce(attrs, F.lit("")), F.lit("</node>")).alias("line"))
    e = edges.select(F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), data(F.lit("relation"), F.col("relation")), F.lit("</edge>")).alias("line"))

    def document(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [*head, '<graph edgedefault="directed">']})
        for b in batches:
            yield b.rename_columns(["value"])
        yield pa.RecordBatch.from_pydict({"value": ["</graph></graphml>"]})

    n.unionByName(e).mapInArrow(document, "value string").write.mode("overwrite").text(path)


def json_documents(rows: DataFrame, wrapper: str, path: str, documents: int = 8) -> None:
    """Records as JSON documents {wrapper: [..]}, one a file, written a record at a time."""

    def document(batches):
        import pyarrow as pa

        last = None
        yield pa.RecordBatch.from_pydict({"value": [json.dumps({wrapper: []})[:-2]]})
        for b in batches:
            lines = ([last] if last is not None else []) + b.column(0).to_pylist()
            if lines:
                last = lines.pop()
                yield pa.RecordBatch.from_pydict({"value": pa.array([f"{x}," for x in lines], pa.string())})
        yield pa.RecordBatch.from_pydict({"value": [*([last] if last is not None else []), "]}"]})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).repartition(documents).mapInArrow(document, "value string").write.mode("overwrite").text(path)


def transfer_package(spark: SparkSession, sources: dict[str, str], path: str, created_at: str) -> DataFrame:
    """The files below each named folder copied to ``path``, with a manifest and checksums; returns (name, file, length, sha256).

    Files travel as rows of the binary source to a Parquet table, so that any store will do. Wheels and a zip file need a local disk and a network: left out.
    """
    all_ = None
    for name, folder in sorted(sources.items()):
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        f = f.select(F.lit(name).alias("name"), F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("file"), "length", F.sha2("content", 256).alias("sha256"), "content")
        all_ = f if all_ is None else all_.unionByName(f)
    all_.write.mode("overwrite").parquet(f"{path}/files")
    listed = spark.read.parquet(f"{path}/files").drop("content")
    manifest = listed.groupBy("name").agg(F.sort_array(F.collect_list("file")).alias("files")).select(F.lit(created_at).alias("created_at"), "name", "files")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    listed.select(F.concat("sha256", F.lit("  "), "name", F.lit("/"), "file").alias("value")).sort("value").write.mode("overwrite").text(f"{path}/checksums")
    return listed
