"""The knowledge graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.ontology import PREFIXES, cluster_of, literal_map
from stacklight.operators.components import connected_components


def build_edges(triples: DataFrame) -> DataFrame:
    """(src, dst, relation): one edge for a book and a target; of several relations the last in triple order."""
    e = triples.select(F.concat(F.lit("book:"), "subject_isbn").alias("src"), F.concat_ws(":", literal_map(PREFIXES)[F.col("relation")], "object_concept").alias("dst"), "relation", "ord")
    return e.groupBy("src", "dst").agg(F.max_by("relation", "ord").alias("relation"))


def build_nodes(books: DataFrame, edges: DataFrame) -> DataFrame:
    """Books with their attributes, targets with type and cluster, and books that only triples name, without a type."""
    attrs = ("title", "authors", "average_rating", "simple_categories")
    b = books.groupBy(F.concat(F.lit("book:"), F.col("isbn13").cast("string")).alias("node_id")).agg(F.max_by(F.struct(*attrs), "src_ord").alias("a"))
    b = b.select("node_id", F.lit("book").alias("node_type"), F.lit(None).cast("string").alias("cluster"), "a.*")
    none = [F.lit(None).cast("double" if a == "average_rating" else "string").alias(a) for a in attrs]
    kind = F.substring_index("node_id", ":", 1)
    t = edges.select(F.col("dst").alias("node_id")).distinct()
    t = t.select("node_id", kind.alias("node_type"), F.when(kind == "concept", cluster_of(F.substring("node_id", 9, 1 << 30))).alias("cluster"), *none)
    stray = edges.select(F.col("src").alias("node_id")).distinct().join(b.select("node_id"), "node_id", "left_anti")
    return b.unionByName(t).unionByName(stray.select("node_id", F.lit(None).cast("string").alias("node_type"), F.lit(None).cast("string").alias("cluster"), *none))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, in one pass."""
    return edges.select(F.explode(F.array(F.struct("src", "dst", "relation"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))).alias("e")).select("e.*")


def book_neighbors(edges: DataFrame, isbn13: str, relation: str | None = None) -> DataFrame:
    found = symmetric(edges).where(F.col("src") == f"book:{isbn13}")
    found = found if relation is None else found.where(F.col("relation") == relation)
    return found.select(F.col("dst").alias("neighbor"))


def concept_books(edges: DataFrame, concept: str) -> DataFrame:
    found = symmetric(edges).where((F.col("src") == f"concept:{concept}") & F.col("dst").startswith("book:"))
    return found.select(F.replace("dst", F.lit("book:"), F.lit("")).alias("isbn13"))


def all_books(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_id").startswith("book:")).select(F.replace("node_id", F.lit("book:"), F.lit("")).alias("isbn13")).distinct()


def node_types(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("node_type", F.lit("unknown")).alias("node_type")).agg(F.count("*").alias("n"))


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("relation", F.lit("unknown")).alias("relation")).agg(F.count("*").alias("n"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, density), density 0 for fewer than two nodes."""
    n, m = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    x = n.crossJoin(F.broadcast(m))
    return x.select("nodes", "edges", F.when((F.col("nodes") > 1) & (F.col("edges") > 0), 2 * F.col("edges") / (F.col("nodes").cast("double") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component) of every node, the isolated ones too."""
    c = connected_components(edges).withColumnRenamed("node", "node_id")
    return nodes.select("node_id").join(c, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, counts by type as maps, density, number of components."""
    as_map = lambda d, k: d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(f"{k}s"))
    parts = (as_map(node_types(nodes), "node_type"), as_map(edge_types(edges), "relation"), components(nodes, edges).agg(F.countDistinct("component").alias("components")))
    out = density(nodes, edges)
    for p in parts:  # single rows
        out = out.crossJoin(F.broadcast(p))
    return out
