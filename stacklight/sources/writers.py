"""Writers of the three enrichment tables, document lines, extraction caches and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def write_lines(df: DataFrame, path: str, column: str = "tagged_description") -> None:
    """A line for each row; line ends inside a text become spaces, so that a line is a document."""
    df.select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def append_extractions(df: DataFrame, path: str) -> None:
    """New extractions join the cache; none is written again."""
    df.write.mode("append").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def _escaped(x: Column) -> Column:
    """As XML text without line ends, so that an element stays a line."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def _attribute(key: str, column: str) -> Column:
    escaped = _escaped(F.col(column).cast("string"))
    return F.when(F.col(column).isNotNull(), F.concat(F.lit(f'<data key="{key}">'), escaped, F.lit("</data>"))).otherwise(F.lit(""))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML document in parts: the files of the folder, one after another by name, are the document.

    The head is the first part and the tail the last; nodes and edges are written between them by as many tasks as they have partitions, unsorted."""
    names = ("node_type", "cluster", "title", "authors", "average_rating", "simple_categories")
    quoted = lambda c: _escaped(F.col(c))
    keys = "".join(f'<key id="d{i}" for="node" attr.name="{n}" attr.type="string"/>' for i, n in enumerate(names))
    spark = nodes.sparkSession
    head = spark.createDataFrame([('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + keys + '<key id="d9" for="edge" attr.name="relation" attr.type="string"/>\n<graph edgedefault="undirected">',)], "value string")
    tail = spark.createDataFrame([("</graph>\n</graphml>",)], head.schema)
    n = nodes.select(F.concat(F.lit('<node id="'), quoted("node_id"), F.lit('">'), *[_attribute(f"d{i}", c) for i, c in enumerate(names)], F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), quoted("src"), F.lit('" target="'), quoted("dst"), F.lit('">'), _attribute("d9", "relation"), F.lit("</edge>")).alias("value"))
    # a union keeps the partitions of its sides in their order, and so do the names of the files
    head.coalesce(1).union(n).union(e).union(tail.coalesce(1)).write.mode("overwrite").text(path)


def write_extraction_json(extractions: DataFrame, path: str) -> None:
    """The cache as JSON, a line for each book: {isbn13: record}. Lines of all parts together are the cache; Spark makes the folder."""
    record = F.struct(F.col("isbn13").cast("string").alias("isbn13"), *[F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in ("themes", "settings", "moods", "tropes", "forms")])
    extractions.select(F.to_json(F.create_map(F.col("isbn13").cast("string"), record)).alias("value")).write.mode("overwrite").text(path)


def write_vector_store(documents: DataFrame, path: str, embed) -> None:
    """(content, embedding) of each document; embed: a column function of the text, that of a model or a stub."""
    documents.select("content", embed(F.col("content")).alias("embedding")).write.mode("overwrite").parquet(path)
