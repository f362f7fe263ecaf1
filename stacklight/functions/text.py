"""Text functions with the semantics of Python's str methods, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space at both ends: tabs, line ends and no-break spaces too, which trim() keeps."""
    return F.regexp_replace(x, r"^(?U:\s)+|(?U:\s)+$", "")


def normalised(x: Column) -> Column:
    """Stripped, in lower case, spaces as hyphens; a double space gives a double hyphen."""
    return F.replace(F.lower(strip(x)), F.lit(" "), F.lit("-"))


def words(x: Column) -> Column:
    """Runs of anything but white space; none for a blank text, null for null."""
    return F.when(x.isNull(), F.lit(None)).otherwise(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


def word_count(x: Column) -> Column:
    return F.when(x.isNotNull(), F.size(words(x)))


def sentences(x: Column) -> Column:
    """Pieces between full stops, the empty ones too."""
    return F.split(x, "[.]")


def is_blank(x: Column) -> Column:
    return x.isNull() | (strip(x) == "")


def first_words(x: Column, n: int = 30) -> Column:
    """The first words, joined by one space, and three dots, which come even if nothing is cut."""
    return F.concat(F.array_join(F.slice(words(x), 1, n), " "), F.lit("..."))


def author_prose(authors: Column) -> Column:
    """'A and B' for two authors, 'A, B, and C' for more; names aren't trimmed."""
    a = F.split(authors, ";")
    n = F.size(a)
    return F.when(n == 2, F.concat(a[0], F.lit(" and "), a[1])).when(n > 2, F.concat(F.array_join(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(a, -1))).otherwise(authors)


def title_case(x: Column) -> Column:
    """A letter is a capital unless it follows a letter: O'Brien J.R.R., unlike initcap()."""
    step = lambda s, c: F.struct(F.concat(s["out"], F.when(s["letter"], F.lower(c)).otherwise(F.upper(c))).alias("out"), c.rlike(r"\p{L}").alias("letter"))
    return F.aggregate(F.split(x, ""), F.struct(F.lit("").alias("out"), F.lit(False).alias("letter")), step, lambda s: s["out"])


def leading_isbn(x: Column) -> Column:
    """The first word of a document line as a number, quotes removed."""
    return F.element_at(words(F.btrim(x, F.lit('"'))), 1).cast("long")


def node_type(node: Column) -> Column:
    return F.when(node.contains(":"), F.substring_index(node, ":", 1)).otherwise("concept")


def node_label(node: Column) -> Column:
    """What follows the first colon, hyphens as spaces, in title case."""
    return title_case(F.replace(F.element_at(F.split(node, ":", 2), -1), F.lit("-"), F.lit(" ")))
