"""The concept ontology, relations, and category and tone dictionaries, as dimension tables and literal columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Clusters and their concepts.
CLUSTERS = {
    "psychological_states": ("identity", "grief", "trauma", "obsession", "loneliness", "guilt", "madness", "desire", "jealousy", "shame", "resilience", "self-discovery"),
    "interpersonal_themes": ("forbidden-love", "betrayal", "friendship", "family-dynamics", "mentor-student", "rivalry", "forgiveness", "sacrifice", "loyalty", "revenge"),
    "societal_themes": ("class-struggle", "racism", "colonialism", "war", "revolution", "justice", "corruption", "censorship", "immigration", "gender-roles", "religious-conflict", "surveillance"),
    "philosophical_themes": ("free-will", "mortality", "good-vs-evil", "existentialism", "faith", "truth-vs-illusion", "nature-vs-nurture", "power", "redemption", "absurdism"),
    "narrative_tropes": ("coming-of-age", "quest", "unreliable-narrator", "time-travel", "dystopia", "utopia", "chosen-one", "forbidden-knowledge", "double-life", "survival", "escape", "transformation"),
    "settings_atmosphere": ("small-town", "urban-decay", "wilderness", "gothic", "maritime", "wartime", "post-apocalyptic", "academic", "domestic", "underworld"),
    "literary_moods": ("satirical", "elegiac", "whimsical", "noir", "pastoral", "claustrophobic", "dreamlike", "epic"),
    "subject_domains": ("science", "art", "music", "politics", "crime", "spirituality", "technology", "nature", "history", "mythology"),
    "audience_form": ("autobiographical", "epistolary", "allegorical", "metafiction", "bildungsroman", "magical-realism"),
}
# Which clusters make up which vocabulary.
VOCABULARIES = {
    "themes": ("psychological_states", "interpersonal_themes", "societal_themes", "philosophical_themes", "subject_domains"),
    "moods": ("literary_moods",),
    "tropes": ("narrative_tropes",),
    "settings": ("settings_atmosphere",),
    "forms": ("audience_form",),
}
# How many concepts of each field count, the relation of each field, and the node prefix of each relation.
CAPS = {"themes": 5, "settings": 2, "moods": 2, "tropes": 2, "forms": 2}
RELATIONS = {"themes": "HAS_THEME", "settings": "SET_IN", "moods": "HAS_MOOD", "tropes": "HAS_TROPE", "forms": "HAS_FORM"}
PREFIXES = {"HAS_THEME": "concept", "HAS_MOOD": "concept", "HAS_TROPE": "concept", "HAS_FORM": "concept", "SET_IN": "location", "WRITTEN_BY": "author", "HAS_CATEGORY": "category"}
# Raw category to simple category.
CATEGORIES = {
    "Fiction": "Fiction",
    "Juvenile Fiction": "Children's Fiction",
    "Biography & Autobiography": "Nonfiction",
    "History": "Nonfiction",
    "Literary Criticism": "Nonfiction",
    "Philosophy": "Nonfiction",
    "Religion": "Nonfiction",
    "Comics & Graphic Novels": "Fiction",
    "Drama": "Fiction",
    "Juvenile Nonfiction": "Children's Nonfiction",
    "Science": "Nonfiction",
    "Poetry": "Fiction",
}
# Tone to emotion column, the emotions, and the genres of the genre filter.
TONES = {"Happy": "joy", "Surprising": "surprise", "Angry": "anger", "Suspenseful": "fear", "Sad": "sadness"}
EMOTIONS = ("anger", "disgust", "fear", "joy", "sadness", "surprise", "neutral")
GENRES = ("romance", "science fiction", "scifi", "fantasy", "horror", "mystery", "thriller", "comedy", "crime", "historical")


def concepts(*clusters: str) -> list[str]:
    """Concepts of the clusters (all by default), sorted."""
    return sorted(chain.from_iterable(CLUSTERS[c] for c in clusters or CLUSTERS))


def vocabulary(field: str) -> list[str]:
    return concepts(*VOCABULARIES[field])


def ontology(spark: SparkSession) -> DataFrame:
    """(cluster, concept), 90 rows."""
    return spark.createDataFrame([(k, c) for k, v in CLUSTERS.items() for c in v], "cluster string, concept string")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def cluster_of(concept: Column) -> Column:
    return F.coalesce(literal_map({c: k for k, v in CLUSTERS.items() for c in v})[concept], F.lit("unknown"))


def prompt_lists(spark: SparkSession) -> DataFrame:
    """(vocabulary, prompt): each vocabulary sorted and joined by commas, and all concepts."""
    o = ontology(spark)
    rows = spark.createDataFrame([(f, c) for f, cs in {**VOCABULARIES, "all": tuple(CLUSTERS)}.items() for c in cs], "vocabulary string, cluster string")
    return o.join(F.broadcast(rows), "cluster").groupBy("vocabulary").agg(F.array_join(F.array_sort(F.collect_set("concept")), ", ").alias("prompt"))
