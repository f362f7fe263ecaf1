"""The books view over the driver's tables, in Spark and in DuckDB, and its derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.ontology import CATEGORIES, CLUSTERS, vocabulary
from stacklight.operators import enrich, graph, triples
from stacklight.session import table

SEEDS = (0, 41, 83, 122, 164)


def books_sql(at: str) -> str:
    """SQL of the view; at: how an engine takes the i-th element of the vector, as a format of i."""
    emotions = ", ".join(f"CAST({at.format(i)} AS DOUBLE) AS {e}" for i, e in enumerate(("anger", "disgust", "fear", "joy", "sadness", "surprise", "neutral"), 1))
    return f"""SELECT 9780000000000 + p.p_partkey AS isbn13, p.p_partkey AS src_ord, p.p_name AS title,
 CASE WHEN p.p_partkey % 3 = 0 THEN p.p_brand END AS subtitle,
 CASE WHEN p.p_partkey % 11 = 0 THEN NULL
  WHEN p.p_partkey % 6 = 5 THEN concat('Author A', CAST(floor(p.p_partkey / 10) AS BIGINT), ';Author B', CAST(floor(p.p_partkey / 25) AS BIGINT), ';Author C', CAST(floor(p.p_partkey / 40) AS BIGINT))
  WHEN p.p_partkey % 4 = 0 THEN concat('Author A', CAST(floor(p.p_partkey / 10) AS BIGINT), '; Author B', CAST(floor((p.p_partkey + 7) / 25) AS BIGINT))
  ELSE concat('Author A', CAST(floor(p.p_partkey / 10) AS BIGINT)) END AS authors,
 CASE p.p_partkey % 8 WHEN 0 THEN 'Fiction' WHEN 1 THEN 'Juvenile Fiction' WHEN 2 THEN 'History' WHEN 3 THEN 'Drama' WHEN 4 THEN 'Juvenile Nonfiction' WHEN 5 THEN 'Science' WHEN 6 THEN 'Romance' ELSE 'Horror' END AS categories,
 CASE WHEN p.p_partkey % 13 <> 0 THEN concat('http://img.example/', p.p_partkey) END AS thumbnail,
 d.text AS description,
 CASE WHEN p.p_partkey % 17 <> 0 THEN CAST(1950 + p.p_partkey % 75 AS DOUBLE) END AS published_year,
 CASE WHEN p.p_partkey % 19 <> 0 THEN CAST(1 + (p.p_partkey * 7 % 40) / 10.0 AS DOUBLE) END AS average_rating,
 CASE WHEN p.p_partkey % 23 <> 0 THEN CAST(p.p_size * 10 AS DOUBLE) END AS num_pages,
 e.embedding AS embedding, {emotions}
FROM {{part}} p LEFT JOIN {{documents}} d ON d.doc_id = p.p_partkey LEFT JOIN {{embeddings}} e ON e.vec_id = p.p_partkey"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("part", "documents", "embeddings")}
    return spark.sql(books_sql("element_at(e.embedding, {})"), **tables)


def raw_extractions(b: DataFrame) -> DataFrame:
    """The deterministic extraction of each book, before validation."""
    arrays = lambda f: "array(" + ", ".join(f"'{c}'" for c in vocabulary(f)) + ")"
    pick = lambda f, e: f"element_at({arrays(f)}, CAST(1 + ({e}) % {len(vocabulary(f))} AS INT))"
    none = "CAST(array() AS ARRAY<STRING>)"
    themes = f"CASE WHEN src_ord % 29 = 0 THEN array('Not A Theme') WHEN src_ord % 2 = 0 THEN array({pick('themes', '7 * src_ord')}, {pick('themes', '11 * src_ord')}) ELSE array({pick('themes', '7 * src_ord')}) END"
    return b.selectExpr(
        "isbn13",
        "src_ord",
        f"CASE WHEN src_ord % 10 = 1 THEN transform({themes}, x -> upper(replace(x, '-', ' '))) ELSE {themes} END AS themes",
        f"CASE WHEN src_ord % 4 = 1 THEN array(concat('place-', CAST(floor(src_ord / 16) AS STRING))) ELSE {none} END AS settings",
        f"CASE WHEN src_ord % 2 = 1 THEN array({pick('moods', 'src_ord')}) ELSE {none} END AS moods",
        f"CASE WHEN src_ord % 3 = 0 THEN array({pick('tropes', 'src_ord')}) ELSE {none} END AS tropes",
        f"CASE WHEN src_ord % 5 = 0 THEN array({pick('forms', 'src_ord')}) ELSE {none} END AS forms",
    )


def all_triples(b: DataFrame) -> DataFrame:
    from_text = triples.extraction_triples(triples.validated(raw_extractions(b)))
    return triples.metadata_triples(enrich.imputed(b)).unionByName(from_text)


def edges(b: DataFrame) -> DataFrame:
    return graph.build_edges(all_triples(b))


def nodes(b: DataFrame, e: DataFrame) -> DataFrame:
    return graph.build_nodes(enrich.imputed(b), e)


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q_embedding"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dedup fixture: a concept for each vector, with counts."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("c"), "vec_id").alias("concept"), F.col("vec_id").alias("ord"), "embedding", (F.col("vec_id") * 37 % 11).alias("count"))


# The same views for DuckDB, as common table expressions.

BOOKS = "books AS (" + books_sql("e.embedding[{}]").format(part="part", documents="documents", embeddings="embeddings") + ")"
_CASE = "CASE categories " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in CATEGORIES.items()) + " END"
IMPUTED = BOOKS + f", imputed AS (SELECT * REPLACE (embedding AS embedding), coalesce({_CASE}, CASE WHEN isbn13 % 2 = 0 THEN 'Fiction' ELSE 'Nonfiction' END) AS simple_categories FROM books)"


def _list(field: str) -> str:
    return "[" + ", ".join(f"'{c}'" for c in vocabulary(field)) + "]"


def _pick(field: str, e: str) -> str:
    return f"{_list(field)}[CAST(1 + ({e}) % {len(vocabulary(field))} AS INTEGER)]"


NORM = "replace(lower(trim({})), ' ', '-')"
AUTHORS = "authors_x AS (SELECT isbn13, src_ord, unnest(string_split(authors, ';')) AS name FROM imputed WHERE authors IS NOT NULL)"
TRIPLES = (
    IMPUTED
    + ", "
    + AUTHORS
    + f"""
, valid AS (SELECT * FROM imputed WHERE src_ord % 29 <> 0)
, triples AS (
 SELECT CAST(isbn13 AS VARCHAR) AS subject_isbn, 'WRITTEN_BY' AS relation, {NORM.format("name")} AS object_concept FROM authors_x WHERE trim(name) <> ''
 UNION ALL SELECT CAST(isbn13 AS VARCHAR), 'HAS_CATEGORY', {NORM.format("simple_categories")} FROM imputed
 UNION ALL SELECT CAST(isbn13 AS VARCHAR), 'HAS_THEME', {_pick("themes", "7 * src_ord")} FROM valid
 UNION ALL SELECT CAST(isbn13 AS VARCHAR), 'HAS_THEME', {_pick("themes", "11 * src_ord")} FROM valid WHERE src_ord % 2 = 0
 UNION ALL SELECT CAST(isbn13 AS VARCHAR), 'SET_IN', 'place-' || CAST(CAST(floor(src_ord / 16) AS BIGINT) AS VARCHAR) FROM valid WHERE src_ord % 4 = 1
 UNION ALL SELECT CAST(isbn13 AS VARCHAR), 'HAS_MOOD', {_pick("moods", "src_ord")} FROM valid WHERE src_ord % 2 = 1
 UNION ALL SELECT CAST(isbn13 AS VARCHAR), 'HAS_TROPE', {_pick("tropes", "src_ord")} FROM valid WHERE src_ord % 3 = 0
 UNION ALL SELECT CAST(isbn13 AS VARCHAR), 'HAS_FORM', {_pick("forms", "src_ord")} FROM valid WHERE src_ord % 5 = 0)"""
)
_PREFIX = "CASE relation WHEN 'SET_IN' THEN 'location' WHEN 'WRITTEN_BY' THEN 'author' WHEN 'HAS_CATEGORY' THEN 'category' ELSE 'concept' END"
_CLUSTER = "CASE substr(node_id, 9) " + " ".join(f"WHEN '{c}' THEN '{k}'" for k, v in CLUSTERS.items() for c in v) + " ELSE 'unknown' END"
EDGES = TRIPLES + f", edges AS (SELECT 'book:' || subject_isbn AS src, {_PREFIX} || ':' || object_concept AS dst, max(relation) AS relation FROM triples GROUP BY 1, 2)"
NODES = (
    EDGES
    + f""", nodes AS (SELECT 'book:' || CAST(isbn13 AS VARCHAR) AS node_id, 'book' AS node_type, CAST(NULL AS VARCHAR) AS cluster, title, authors, average_rating, simple_categories FROM imputed
 UNION ALL SELECT node_id, split_part(node_id, ':', 1), CASE WHEN split_part(node_id, ':', 1) = 'concept' THEN {_CLUSTER} END, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT dst AS node_id FROM edges))"""
)
