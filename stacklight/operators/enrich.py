"""Batch enrichment: cleaning, statistics, categories and emotions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stacklight.config import DEFAULTS
from stacklight.functions import text as T
from stacklight.functions.providers import best_label, stub_emotions, stub_zero_shot
from stacklight.ontology import CATEGORIES, EMOTIONS, GENRES, TONES, literal_map
from stacklight.operators.ranges import cumulated
from stacklight.session import written

REQUIRED = ("description", "num_pages", "average_rating", "published_year")


def flagged(books: DataFrame, year: int = DEFAULTS.reference_year) -> DataFrame:
    return books.withColumns({"missing_description": F.col("description").isNull().cast("int"), "age_of_book": F.lit(year) - F.col("published_year")})


def complete(books: DataFrame) -> DataFrame:
    """Rows with all required values, and their numbers of words."""
    return books.dropna(subset=list(REQUIRED)).withColumn("words_in_description", T.word_count(F.col("description")))


def title_and_subtitle() -> Column:
    return F.when(F.col("subtitle").isNull(), F.col("title")).otherwise(F.concat("title", F.lit(": "), "subtitle"))


def tagged_description() -> Column:
    return F.concat_ws(" ", F.col("isbn13").cast("string"), "description")


def large_thumbnail() -> Column:
    return F.coalesce(F.concat("thumbnail", F.lit("&fife=w800")), F.lit("cover-not-found.jpg"))


def clean_books(books: DataFrame, min_words: int = DEFAULTS.min_description_words) -> DataFrame:
    """Complete rows with long enough descriptions, tagged; helper columns dropped. One scan, no shuffle."""
    d = complete(books).where(F.col("words_in_description") >= min_words)
    return d.withColumns({"title_and_subtitle": title_and_subtitle(), "tagged_description": tagged_description()}).drop("subtitle", "missing_description", "age_of_book", "words_in_description")


def word_buckets(books: DataFrame, bounds: tuple[tuple[int, int], ...] = ((1, 4), (5, 14), (15, 24), (25, 34))) -> DataFrame:
    """(bucket, isbn13, description) of the complete rows whose number of words lies in a bucket."""
    case = None
    for lo, hi in bounds:
        inside = F.col("words_in_description").between(lo, hi)
        case = F.when(inside, f"{lo}-{hi}") if case is None else case.when(inside, f"{lo}-{hi}")
    return complete(books).withColumn("bucket", case).where("bucket IS NOT NULL").select("bucket", "isbn13", "description")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, present): one pass over all columns."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns], F.count("*").alias("__n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("missing")) for c in columns])).alias("x")
    return sums.select(pairs, "__n").select("x.column", "x.missing", (F.col("__n") - F.col("x.missing")).alias("present"))


def frequencies(df: DataFrame, column: str, more_than: int | None = None) -> DataFrame:
    """(value, count), nulls left out; most frequent first, ties by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    out = out if more_than is None else out.where(F.col("count") > more_than)
    return out.orderBy(F.desc("count"), "value")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) for each pair: rank correlation over the rows where both are there, ties at their average rank; null if a side is constant or no row is complete.

    Rows become counts of distinct value pairs in one pass for all pairs of columns; ranks are running sums over distinct values, in ranges."""
    spark = df.sparkSession
    pairs = [*combinations(columns, 2)]
    if not pairs:
        return spark.createDataFrame([], "a string, b string, rho double")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)])).alias("p")
    joint = written(df.select(each).select("p.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(F.count("*").alias("n")), "value-pairs")
    rows = joint.groupBy("pair").agg(F.sum("n").alias("total"))
    for c in ("x", "y"):
        before = cumulated(joint.groupBy("pair", c).agg(F.sum("n").alias("m")), [F.col("pair"), F.col(c)], F.col("m"), "before")
        start = before.groupBy("pair").agg(F.min("before").alias("start"))
        rank = before.join(start, "pair").select("pair", c, (F.col("before") - F.col("start") + (F.col("m") + 1) / 2).alias(f"r{c}"))
        joint = joint.join(rank, ["pair", c])
    d = joint.join(rows, "pair").withColumns({f"d{c}": F.col(f"r{c}") - (F.col("total") + 1) / 2 for c in ("x", "y")})
    product = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    got = d.groupBy("pair").agg(F.try_divide(product("dx", "dy"), F.sqrt(product("dx", "dx")) * F.sqrt(product("dy", "dy"))).alias("rho"))
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return names.join(got, "pair", "left").select("a", "b", "rho")


def with_simple_categories(books: DataFrame) -> DataFrame:
    return books.withColumn("simple_categories", literal_map(CATEGORIES)[F.col("categories")])


def genre_filter(books: DataFrame) -> DataFrame:
    return books.where(F.lower("categories").isin(*GENRES))


def imputed(books: DataFrame, labels: tuple[str, ...] = ("Fiction", "Nonfiction"), provider=stub_zero_shot) -> DataFrame:
    """Missing simple categories predicted from the description; a column, so no join and no second pass."""
    guess = best_label(provider(F.col("isbn13"), F.col("description"), list(labels)))
    return with_simple_categories(books).withColumn("simple_categories", F.coalesce("simple_categories", guess))


def evaluation(books: DataFrame, rows: int = DEFAULTS.evaluation_rows, labels: tuple[str, ...] = ("Fiction", "Nonfiction"), provider=stub_zero_shot) -> DataFrame:
    """(isbn13, actual, predicted, correct) for the first rows of each class; top-k per class keeps no more than k rows a task."""
    ranked = with_simple_categories(books).where(F.col("simple_categories").isin(*labels))
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("simple_categories").orderBy("src_ord"))).where(F.col("rn") <= rows)
    guess = best_label(provider(F.col("isbn13"), F.col("description"), list(labels)))
    return ranked.select("isbn13", F.col("simple_categories").alias("actual"), guess.alias("predicted")).withColumn("correct", (F.col("actual") == F.col("predicted")).cast("int"))


def accuracy(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.count("*").alias("n"), (F.sum("correct") / F.count("*")).alias("accuracy"))


def with_emotions(books: DataFrame, provider=stub_emotions, positional: bool = False, model=None) -> DataFrame:
    """A column for each emotion: its greatest score over the sentences of the description.

    provider: scores of a sentence as columns; model: instead, an Arrow-batched column function (providers.emotion_model) of the description.
    positional: scores of labels in alphabetical order are given to the emotions in their listed order, by place instead of by name."""
    if model is not None:
        found = model(F.col("description"))
        return books.withColumn("emotion_scores", found).withColumns({e: F.col("emotion_scores")[e] for e in EMOTIONS}).drop("emotion_scores")
    s = T.sentences(F.col("description"))
    names = sorted(EMOTIONS) if positional else EMOTIONS
    score = lambda label: lambda x: provider(x)[label]
    return books.withColumns({e: F.array_max(F.transform(s, score(label))) for e, label in zip(EMOTIONS, names, strict=True)})


def subset_row(books: DataFrame, column: str, value: str, place: int = 0) -> DataFrame:
    """The row at that place (from 0) of the rows whose column has the value, in table order."""
    ranked = books.where(F.col(column) == value).withColumn("rn", F.row_number().over(Window.partitionBy(column).orderBy("src_ord")))
    return ranked.where(F.col("rn") <= place + 1).where(F.col("rn") == place + 1).drop("rn")


def first_rows(books: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows in table order."""
    return books.orderBy("src_ord").limit(n)


def lookup(books: DataFrame, isbn13: int) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return books.where(F.col("isbn13") == isbn13)


def tone_choices(spark: SparkSession) -> DataFrame:
    """(ord, tone): 'All', then the tones in their order."""
    return spark.createDataFrame([*enumerate(("All", *TONES))], "ord int, tone string")


def category_choices(books: DataFrame) -> DataFrame:
    """(ord, category): 'All', then the sorted categories."""
    found = books.where("simple_categories IS NOT NULL").select(F.col("simple_categories").alias("category")).distinct()
    every = books.sparkSession.createDataFrame([(0, "All")], "ord int, category string")
    return every.unionByName(found.select(F.row_number().over(Window.orderBy("category")).alias("ord"), "category"))
