"""The composed recommendation: vector search, spreading activation from its first hits, explanations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklight.config import DEFAULTS, Config
from stacklight.operators import paths, present, spreading, vector
from stacklight.session import written


@dataclass(frozen=True)
class Recommendation:
    """Three tables; the last two are empty or None without a graph."""

    vector: DataFrame
    activated: DataFrame | None
    explanations: DataFrame | None


def seeds_of(books: DataFrame, n: int, order: list) -> DataFrame:
    """(query_id, node_id, pos) of the first n books."""
    first = books.orderBy(*order).limit(n)
    return first.select(F.lit(0).alias("query_id"), F.concat(F.lit("book:"), F.col("isbn13").cast("string")).alias("node_id"), F.row_number().over(Window.orderBy(*order)).alias("pos"))


def san_search(books: DataFrame, edges: DataFrame, seeds: DataFrame, top_k: int = DEFAULTS.san_top_k, category: str | None = "All", config: Config = DEFAULTS) -> DataFrame:
    """(query_id, the columns of books, activation_score): books activated by each query's seeds. Three times as many are fetched before the category filter, so fewer than top_k may come."""
    found = spreading.activated_books(spreading.activate(edges, seeds, config), seeds, 3 * top_k, config.san_min_activation)
    found = found.select("query_id", F.col("isbn13").cast("long").alias("isbn13"), F.col("activation").alias("activation_score"))
    hits = found.join(books, "isbn13")
    if category not in (None, "All"):
        hits = hits.where(F.col("simple_categories") == category)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("activation_score", 6)), "isbn13")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).drop("rank")


def recommend(books: DataFrame, query: DataFrame, edges: DataFrame | None, category: str | None = "All", tone: str | None = "All", config: Config = DEFAULTS) -> Recommendation:
    """Without a graph, vector results alone. The vector search runs once; its tone order decides the seeds."""
    from stacklight.ontology import TONES

    found = written(vector.vector_search(books, query, category, tone, config.initial_top_k, config.final_top_k), "vector")
    if edges is None:
        return Recommendation(found, None, None)
    order = [F.desc_nulls_last(TONES[tone]), F.col("src_ord")] if tone in TONES else [F.col("src_ord")]
    seeds = written(seeds_of(found, config.san_seed_count, order), "seeds")
    san = written(san_search(books, edges, seeds, config.san_top_k, category, config), "san")
    targets = san.select("query_id", F.concat(F.lit("book:"), F.col("isbn13").cast("string")).alias("target"))
    return Recommendation(found, san, paths.explanations(edges, seeds, targets))


def page(r: Recommendation, books: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(cards, cards, html) for display."""
    if r.activated is None:
        return present.cards(r.vector), None, None
    lines = present.explanation_lines(r.explanations, books)
    rank = r.activated.select(F.concat(F.lit("book:"), F.col("isbn13").cast("string")).alias("target"), (-F.round("activation_score", 6)).alias("rank"))
    return present.cards(r.vector), present.cards(r.activated), present.explanation_html(lines.join(rank, "target"))
