"""Readers of books, document lines, extraction caches and graphs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.functions.text import leading_isbn, strip

BOOKS = "isbn13 long, title string, subtitle string, authors string, categories string, thumbnail string, description string, published_year double, average_rating double, num_pages double"
CLEANED = "isbn13 long, title string, authors string, categories string, thumbnail string, description string, published_year double, average_rating double, num_pages double, title_and_subtitle string, tagged_description string"
CATEGORISED = CLEANED + ", simple_categories string"
EMOTIONAL = CATEGORISED + ", anger double, disgust double, fear double, joy double, sadness double, surprise double, neutral double"
EXTRACTION = "isbn13 long, themes array<string>, settings array<string>, moods array<string>, tropes array<string>, forms array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_books_csv(spark: SparkSession, path: str, schema: str = BOOKS) -> DataFrame:
    """RFC 4180: doubled quotes, line ends inside quotes. NaN becomes null, so that it sorts and counts as missing."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document for each line that isn't blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("content")).where("content <> ''")


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """The cache of extractions, empty if there is none."""
    return spark.read.schema(EXTRACTION).parquet(path) if exists(spark, path) else spark.createDataFrame([], EXTRACTION)


def read_extraction_json(spark: SparkSession, path: str) -> DataFrame:
    """A cache kept as JSON objects, isbn13 to extraction: one over the whole file, or one a line. Empty if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], EXTRACTION)
    record = EXTRACTION.replace("long", "string", 1)
    # a file that starts with a whole record is one a line
    lines = spark.read.text(path)
    by_line = lines.where(F.col("value").rlike(r"^\{.*\}$")).limit(1).count() > 0
    whole = lines if by_line else spark.read.text(path, wholetext=True)
    entry = F.explode(F.map_values(F.from_json("value", f"map<string, struct<{', '.join(x.replace(' ', ': ', 1) for x in record.split(', '))}>>")))
    return whole.select(entry.alias("x")).select(F.col("x.isbn13").cast("long").alias("isbn13"), *[f"x.{f}" for f in ("themes", "settings", "moods", "tropes", "forms")])


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML document, in one file or in parts: attributes by the names that its keys declare.

    Where each node and edge is a line, as writers.write_graphml() makes them, lines are parsed by themselves, so parts need no root; else files are parsed as XML."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    element = F.regexp_extract("value", "^<(node|edge)[ >]", 1)
    by_line = lines.where((element != "") & ~F.col("value").rlike("</(node|edge)>$|/>$")).isEmpty()
    data = "data array<struct<_VALUE: string, _key: string>>"

    def read(tag: str, schema: str) -> DataFrame:
        if by_line:
            return lines.where(element == tag).select(F.from_xml("value", schema).alias("x")).select("x.*")
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    found = F.explode(F.regexp_extract_all("value", F.lit("<key ([^>]*)>"), F.lit(1))).alias("key")
    keys = lines.where(F.col("value").contains("<key ")).select(found).select(F.regexp_extract("key", 'id="([^"]*)"', 1).alias("id"), F.regexp_extract("key", 'attr.name="([^"]*)"', 1).alias("name"))
    keys = {r.id: r["name"] for r in keys.collect()}  # a handful
    of = lambda name: F.filter("data", lambda d: d["_key"].isin([k for k, v in keys.items() if v == name]))
    first = lambda name: F.when(F.size(of(name)) > 0, F.element_at(of(name), 1)["_VALUE"])
    names = ("node_type", "cluster", "title", "authors", "average_rating", "simple_categories")
    nodes = read("node", f"_id string, {data}").select(F.col("_id").alias("node_id"), *[first(n).alias(n) for n in names]).withColumn("average_rating", F.col("average_rating").cast("double"))
    edges = read("edge", f"_source string, _target string, {data}").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), first("relation").alias("relation"))
    return nodes, edges


def read_vector_store(spark: SparkSession, path: str) -> DataFrame:
    """(isbn13, content, embedding): the key is the first word of the content."""
    return spark.read.parquet(path).select(leading_isbn(F.col("content")).alias("isbn13"), "content", "embedding")


def load_graph(spark: SparkSession, path: str) -> tuple[tuple[DataFrame, DataFrame] | None, str | None]:
    """((nodes, edges), None) of a graph that writers.write_graph() wrote, or (None, why not): a missing or broken graph doesn't stop the search."""
    if not exists(spark, path):
        return None, f"no knowledge graph at {path}"
    try:
        return (spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")), None
    except AnalysisException as e:
        return None, f"knowledge graph at {path} can't be read: {e.getCondition()}"
