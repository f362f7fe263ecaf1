"""Triples from metadata and from validated extractions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.functions.text import is_blank, normalised
from stacklight.ontology import CAPS, RELATIONS, literal_array, vocabulary

VALIDATED = ("themes", "moods", "tropes", "forms")


def author_triples(books: DataFrame) -> DataFrame:
    """A WRITTEN_BY triple for each author that isn't blank."""
    names = F.posexplode(F.split("authors", ";")).alias("pos", "name")
    return books.where(~is_blank(F.col("authors"))).select("src_ord", "isbn13", names).select(F.col("isbn13").cast("string").alias("subject_isbn"), F.lit("WRITTEN_BY").alias("relation"), normalised(F.col("name")).alias("object_concept"), F.struct(F.lit(0).alias("tier"), "src_ord", "pos").alias("ord")).where("object_concept <> ''")


def category_triples(books: DataFrame) -> DataFrame:
    return books.where(~is_blank(F.col("simple_categories"))).select(F.col("isbn13").cast("string").alias("subject_isbn"), F.lit("HAS_CATEGORY").alias("relation"), normalised(F.col("simple_categories")).alias("object_concept"), F.struct(F.lit(1).alias("tier"), "src_ord", F.lit(0).alias("pos")).alias("ord"))


def metadata_triples(books: DataFrame) -> DataFrame:
    return author_triples(books).unionByName(category_triples(books))


def _known(field: str) -> Callable[[Column], Column]:
    return lambda x: F.array_contains(literal_array(vocabulary(field)), x)


def _unknown(field: str) -> Callable[[Column], Column]:
    return lambda x: ~_known(field)(x)


def _as_item(field: str, place: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.lit(RELATIONS[field]).alias("relation"), x.alias("object_concept"), (i + F.lit(1000 * place)).alias("pos"))


def _valid() -> Column:
    """Whether every item of every closed field is in its vocabulary, the items beyond the cap too."""
    return reduce(lambda a, b: a & b, [F.forall(F.coalesce(f, F.array().cast("array<string>")), _known(f)) for f in VALIDATED])


def normalised_extractions(raw: DataFrame) -> DataFrame:
    return raw.withColumns({f: F.transform(F.coalesce(f, F.array().cast("array<string>")), normalised) for f in CAPS})


def validated(raw: DataFrame) -> DataFrame:
    """Normalised records whose closed fields hold known concepts only, lists cut to their caps; repeats inside a list stay."""
    return normalised_extractions(raw).where(_valid()).withColumns({f: F.slice(f, 1, n) for f, n in CAPS.items()})


def rejected(raw: DataFrame) -> DataFrame:
    """Records that validation rejects, with the concepts that it doesn't know."""
    d = normalised_extractions(raw).where(~_valid())
    unknown = F.concat(*[F.filter(f, _unknown(f)) for f in VALIDATED])
    return d.select("isbn13", F.array_join(unknown, "|").alias("unknown"))


def extraction_triples(valid: DataFrame) -> DataFrame:
    """One row for each item: themes, settings, moods, tropes, forms in turn."""
    items = F.flatten(F.array(*[F.transform(f, _as_item(f, t)) for t, f in enumerate(CAPS)]))
    d = valid.select("isbn13", F.explode(items).alias("x"))
    return d.select(F.col("isbn13").cast("string").alias("subject_isbn"), "x.relation", "x.object_concept", F.struct(F.lit(2).alias("tier"), F.col("isbn13").alias("src_ord"), "x.pos").alias("ord"))


def apply_mapping(triples: DataFrame, mapping: DataFrame, relations: tuple[str, ...] | None = None) -> DataFrame:
    """Objects replaced by their canonical concepts, in all relations by default."""
    m = mapping.select(F.col("concept").alias("object_concept"), "canonical")
    swap = F.coalesce("canonical", "object_concept")
    if relations:
        swap = F.when(F.col("relation").isin(*relations), swap).otherwise(F.col("object_concept"))
    return triples.join(m, "object_concept", "left").withColumn("object_concept", swap).select(*triples.columns)
