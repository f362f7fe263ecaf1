"""Merging near-duplicate concepts: links of similar pairs, connected components, canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.config import DEFAULTS
from stacklight.operators.components import connected_components
from stacklight.operators.vector import similar_links


def dedup_mapping(concepts: DataFrame, threshold: float = DEFAULTS.dedup_threshold) -> DataFrame:
    """(concept, canonical) for (concept, ord, embedding, count): the commonest of a cluster, then the shortest, then the first."""
    comps = connected_components(similar_links(concepts, threshold), "a", "b")
    d = concepts.join(comps.withColumnRenamed("node", "concept"), "concept", "left").withColumn("component", F.coalesce("component", "concept"))
    best = d.groupBy("component").agg(F.max_by("concept", F.struct(F.coalesce("count", F.lit(0)).alias("n"), -F.length("concept"), -F.col("ord"))).alias("canonical"))
    return d.join(best, "component").select("concept", "canonical")


def dedup_stats(mapping: DataFrame) -> DataFrame:
    """(concepts, canonical_forms, merged)."""
    return mapping.agg(F.count("*").alias("concepts"), F.countDistinct("canonical").alias("canonical_forms"), (F.count("*") - F.countDistinct("canonical")).alias("merged"))
