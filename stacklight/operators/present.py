"""Cards, galleries and explanations for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.functions.text import author_prose, first_words, node_label, node_type

NONE_FOUND = "<p><em>No knowledge graph connections found.</em></p>"


def caption() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" by "), F.coalesce(author_prose(F.col("authors")), F.lit("")), F.lit(": "), first_words(F.coalesce("description", F.lit(""))))


def cards(books: DataFrame) -> DataFrame:
    """(isbn13, thumbnail, caption)."""
    cover = F.coalesce("large_thumbnail", F.lit("cover-not-found.jpg")) if "large_thumbnail" in books.columns else F.lit("cover-not-found.jpg")
    return books.select("isbn13", cover.alias("thumbnail"), caption().alias("caption"))


def explanation_lines(explained: DataFrame, books: DataFrame) -> DataFrame:
    """(target, html) for (target, seed, path, via); titles of the last row of an isbn, 'Unknown' if there is none. Nothing is escaped."""
    titles = books.groupBy(F.concat(F.lit("book:"), F.col("isbn13").cast("string")).alias("id")).agg(F.max_by("title", "src_ord").alias("t"))
    d = explained.join(titles.select(F.col("id").alias("target"), F.col("t").alias("target_title")), "target", "left")
    d = d.join(titles.select(F.col("id").alias("seed"), F.col("t").alias("seed_title")), "seed", "left")
    label = lambda n: F.concat(F.lit("<strong>"), node_label(n), F.lit("</strong> ("), node_type(n), F.lit(")"))
    via = F.when(F.size("via") > 0, F.array_join(F.transform("via", label), " &rarr; ")).otherwise("direct")
    name = lambda c: F.coalesce(c, F.lit("Unknown"))
    return d.select("target", F.concat(F.lit('<p>&bull; <em>"'), name("target_title"), F.lit('"</em> discovered via: '), via, F.lit(' &mdash; shared with <em>"'), name("seed_title"), F.lit('"</em></p>')).alias("html"))


def explanation_html(lines: DataFrame) -> DataFrame:
    """One row: the lines, in the order of their targets' rank, inside one element; a message if there are none. A page of results is a few rows."""
    order = "rank" if "rank" in lines.columns else "target"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "html"))), lambda x: x["html"]), "\n")
    start, end = '<div style="font-size: 14px; line-height: 1.8;">\n', "\n</div>"
    return lines.agg(F.when(F.count("*") > 0, F.concat(F.lit(start), body, F.lit(end))).otherwise(NONE_FOUND).alias("html"))
