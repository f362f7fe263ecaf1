"""The composed pipelines: cleaning, categories, emotions, the knowledge graph, and the search page over what they leave."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.config import DEFAULTS, Config
from stacklight.functions.providers import stub_embedding, stub_emotions, stub_zero_shot
from stacklight.operators import dedup, enrich, graph, present, triples, vector
from stacklight.operators.ranges import cumulated
from stacklight.plans.recommend import page, recommend
from stacklight.session import written
from stacklight.sources import readers, writers

# Messages of the page; the first names the layer by what it is.
NOT_ENABLED = "<p><em>Enable the graph layer and build the Knowledge Graph to see structurally connected book discoveries.</em></p>"
NO_CONNECTIONS = "<p><em>No knowledge graph connections found for this query.</em></p>"
ERROR = "<p><em>Knowledge graph search encountered an error: {error}</em></p>"


def categorised(spark: SparkSession, cleaned: str, path: str, provider=stub_zero_shot) -> DataFrame:
    """Reads the cleaned table, imputes missing simple categories, writes the categorised table and reads it."""
    writers.write_csv(enrich.imputed(readers.read_books_csv(spark, cleaned, readers.CLEANED), provider=provider), path)
    return readers.read_books_csv(spark, path, readers.CATEGORISED)


def emotional(spark: SparkSession, categorised_path: str, path: str, provider=stub_emotions, model=None, positional: bool = False) -> DataFrame:
    """Reads the categorised table, scores emotions, writes the table with emotions and reads it."""
    books = enrich.with_emotions(readers.read_books_csv(spark, categorised_path, readers.CATEGORISED), provider, positional, model)
    writers.write_csv(books.select(*[c.split()[0] for c in readers.EMOTIONAL.split(", ")]), path)
    return readers.read_books_csv(spark, path, readers.EMOTIONAL)


def concepts_of(t: DataFrame, embed=stub_embedding) -> DataFrame:
    """(concept, ord, embedding, count) of the objects of triples. ord: their number in order of name. However few bytes the names are, all cores share in embedding them."""
    c = cumulated(t.groupBy(F.col("object_concept").alias("concept")).agg(F.count("*").alias("count")), [F.col("concept")], F.lit(1), "ord").repartition(t.sparkSession.sparkContext.defaultParallelism, "concept")
    return c.select("concept", "ord", embed(F.col("concept")).alias("embedding"), "count")


def build_graph(books: DataFrame, extractions: DataFrame, path: str, embed=stub_embedding, threshold: float = DEFAULTS.dedup_threshold) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), written to path: metadata triples, triples of the valid extractions with their near-duplicate concepts merged, then the graph."""
    found = written(triples.extraction_triples(triples.validated(extractions)), "extraction-triples")
    concepts = written(concepts_of(found, embed), "concepts")  # read several times, and a model embeds each name once
    mapping = dedup.dedup_mapping(concepts, threshold)
    edges = graph.build_edges(triples.metadata_triples(books).unionByName(triples.apply_mapping(found, mapping)))
    edges = written(edges, "edges")
    writers.write_graph(graph.build_nodes(books, edges), edges, path)
    return readers.load_graph(books.sparkSession, path)[0]


@dataclass(frozen=True)
class Engine:
    """What a search page needs: books with vectors, the graph's (nodes, edges) if there is one, and why not if there is none."""

    books: DataFrame
    graph: tuple[DataFrame, DataFrame] | None
    reason: str | None


def started(spark: SparkSession, books: DataFrame, graph_path: str) -> Engine:
    return Engine(books, *readers.load_graph(spark, graph_path))


def handled(engine: Engine, query: DataFrame, category: str | None = "All", tone: str | None = "All", enabled: bool = True, config: Config = DEFAULTS) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(cards, cards or None, html): vector results always; activated books and explanations if the layer is enabled, its graph is there and its search runs.

    An error of the graph search costs that part of the page alone and is told in it."""
    spark = engine.books.sparkSession
    told = lambda text: spark.createDataFrame([(text,)], "html string")
    alone = present.cards(vector.vector_search(engine.books, query, category, tone, config.initial_top_k, config.final_top_k))
    if not enabled or engine.graph is None:
        return alone, None, told(NOT_ENABLED)
    try:
        left, right, html = page(recommend(engine.books, query, engine.graph[1], category, tone, config), engine.books)
        html = written(html, "html")
        if html.first().html == present.NONE_FOUND:
            html = told(NO_CONNECTIONS)
        return left, right, html
    except PySparkException as e:
        return alone, None, told(ERROR.format(error=e.getCondition() or type(e).__name__))
