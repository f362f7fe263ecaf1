"""All queries of the catalogue, by name, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stacklight.config import DEFAULTS
from stacklight.ontology import CLUSTERS, GENRES, TONES, VOCABULARIES, concepts, ontology, prompt_lists, vocabulary
from stacklight.operators import dedup, enrich, graph, paths, present, spreading, triples, vector
from stacklight.plans import fixtures as X
from stacklight.plans import pipelines
from stacklight.plans.recommend import recommend, san_search
from stacklight.session import work_path, written
from stacklight.sources import readers, writers
from stacklight.streaming.incremental import pending

FLAGSHIP = "recommend"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_B, _I, _T, _E, _N = (f"WITH {x} " for x in (X.BOOKS, X.IMPUTED, X.TRIPLES, X.EDGES, X.NODES))
_NOTNULL = "description IS NOT NULL AND num_pages IS NOT NULL AND average_rating IS NOT NULL AND published_year IS NOT NULL"
_WC = "len(list_filter(string_split_regex(description, '\\s+'), lambda x: x <> ''))"


@query(_B + f"SELECT isbn13, title, authors, categories, thumbnail, description, published_year, average_rating, num_pages, CASE WHEN subtitle IS NULL THEN title ELSE title || ': ' || subtitle END AS title_and_subtitle, CAST(isbn13 AS VARCHAR) || ' ' || description AS tagged_description FROM books WHERE {_NOTNULL} AND {_WC} >= 25")
def clean_books(spark, sf_dir):
    names = [c.split()[0] for c in readers.CLEANED.split(", ")]
    return enrich.clean_books(X.books(spark, sf_dir)).select(*names)


@query(_B + "SELECT isbn13, CAST(CASE WHEN description IS NULL THEN 1 ELSE 0 END AS INTEGER) AS missing_description, 2024 - published_year AS age_of_book FROM books")
def missing_flags(spark, sf_dir):
    return enrich.flagged(X.books(spark, sf_dir)).select("isbn13", "missing_description", "age_of_book")


_COLUMNS = ["subtitle", "authors", "thumbnail", "description", "published_year", "average_rating", "num_pages", "embedding"]


@query(_B + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count({c}) AS present FROM books" for c in _COLUMNS))
def missingness(spark, sf_dir):
    return enrich.missingness(X.books(spark, sf_dir), _COLUMNS)


_RHO = ["num_pages", "age_of_book", "missing_description", "average_rating"]


def _spearman_sql() -> str:
    parts = []
    for i, a in enumerate(_RHO):
        for b in _RHO[i + 1 :]:
            rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS rho FROM (SELECT {rank.format('x')} AS ra, {rank.format('y')} AS rb FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL))")
    return _B.rstrip() + ", f AS (SELECT *, CASE WHEN description IS NULL THEN 1 ELSE 0 END AS missing_description, 2024 - published_year AS age_of_book FROM books) SELECT a, b, CASE WHEN isnan(rho) THEN NULL ELSE rho END AS rho FROM (" + " UNION ALL ".join(parts) + ")"


@query(_spearman_sql())
def spearman(spark, sf_dir):
    return enrich.spearman(enrich.flagged(X.books(spark, sf_dir)), _RHO).select("a", "b", F.round("rho", 6).alias("rho"))


@query(_B + f"SELECT CASE WHEN n <= 4 THEN '1-4' WHEN n <= 14 THEN '5-14' WHEN n <= 24 THEN '15-24' ELSE '25-34' END AS bucket, isbn13, description FROM (SELECT *, {_WC} AS n FROM books WHERE {_NOTNULL}) WHERE n BETWEEN 1 AND 34")
def word_buckets(spark, sf_dir):
    return enrich.word_buckets(X.books(spark, sf_dir))


@query(_B + "SELECT isbn13, CASE WHEN subtitle IS NULL THEN title ELSE title || ': ' || subtitle END AS title_and_subtitle FROM books")
def title_and_subtitle(spark, sf_dir):
    return X.books(spark, sf_dir).select("isbn13", enrich.title_and_subtitle().alias("title_and_subtitle"))


@query(_B + "SELECT isbn13, CAST(isbn13 AS VARCHAR) || ' ' || description AS tagged_description FROM books WHERE description IS NOT NULL")
def tagged_description(spark, sf_dir):
    return X.books(spark, sf_dir).where("description IS NOT NULL").select("isbn13", enrich.tagged_description().alias("tagged_description"))


@query(_B + "SELECT isbn13, coalesce(thumbnail || '&fife=w800', 'cover-not-found.jpg') AS large_thumbnail FROM books")
def large_thumbnail(spark, sf_dir):
    return X.books(spark, sf_dir).select("isbn13", enrich.large_thumbnail().alias("large_thumbnail"))


@query(_B + f'SELECT categories AS value, count(*) AS "count" FROM books WHERE {_NOTNULL} GROUP BY 1')
def category_counts(spark, sf_dir):
    return enrich.frequencies(enrich.complete(X.books(spark, sf_dir)), "categories")


@query(_B + 'SELECT categories AS value, count(*) AS "count" FROM books GROUP BY 1 HAVING count(*) > 50')
def category_counts_having(spark, sf_dir):
    return enrich.frequencies(X.books(spark, sf_dir), "categories", DEFAULTS.category_min_count)


@query(_B + f"SELECT isbn13, {X._CASE} AS simple_categories FROM books")
def simple_categories(spark, sf_dir):
    return enrich.with_simple_categories(X.books(spark, sf_dir)).select("isbn13", "simple_categories")


@query(_B + "SELECT isbn13, categories FROM books WHERE lower(categories) IN (" + ", ".join(f"'{g}'" for g in GENRES) + ")")
def genre_filter(spark, sf_dir):
    return enrich.genre_filter(X.books(spark, sf_dir)).select("isbn13", "categories")


@query(_I + "SELECT isbn13, simple_categories FROM imputed")
def impute_categories(spark, sf_dir):
    return enrich.imputed(X.books(spark, sf_dir)).select("isbn13", "simple_categories")


_EVAL = f"SELECT isbn13, c AS actual, CASE WHEN isbn13 % 2 = 0 THEN 'Fiction' ELSE 'Nonfiction' END AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY src_ord) AS rn FROM (SELECT *, {X._CASE} AS c FROM books) WHERE c IN ('Fiction', 'Nonfiction')) WHERE rn <= 300"


@query(_B + f"SELECT count(*) AS n, round(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM ({_EVAL})")
def zero_shot_accuracy(spark, sf_dir):
    return enrich.accuracy(enrich.evaluation(X.books(spark, sf_dir))).select("n", F.round("accuracy", 6).alias("accuracy"))


@query(_B + f"SELECT *, CAST(CASE WHEN actual = predicted THEN 1 ELSE 0 END AS INTEGER) AS correct FROM ({_EVAL})")
def evaluation_sample(spark, sf_dir):
    return enrich.evaluation(X.books(spark, sf_dir))


def _emotion_sql(pairs) -> str:
    each = ", ".join(f"round(list_max(list_transform(string_split(description, '.'), lambda x: (length(x) - length(replace(x, '{c}', ''))) / CAST(length(x) + 1 AS DOUBLE))), 6) AS {e}" for e, c in pairs)
    return _B + f"SELECT isbn13, {each} FROM books WHERE description IS NOT NULL"


def _emotions(spark, sf_dir, positional):
    b = enrich.with_emotions(X.books(spark, sf_dir).where("description IS NOT NULL"), positional=positional)
    return b.select("isbn13", *[F.round(e, 6).alias(e) for e in enrich.EMOTIONS])


@query(_emotion_sql([("anger", "a"), ("disgust", "d"), ("fear", "f"), ("joy", "j"), ("sadness", "s"), ("surprise", "u"), ("neutral", "n")]))
def emotion_max(spark, sf_dir):
    return _emotions(spark, sf_dir, False)


@query(_emotion_sql([("anger", "a"), ("disgust", "d"), ("fear", "f"), ("joy", "j"), ("sadness", "n"), ("surprise", "s"), ("neutral", "u")]))
def emotion_positional(spark, sf_dir):
    return _emotions(spark, sf_dir, True)


@query(_I + "SELECT 0 AS ord, 'All' AS category UNION ALL SELECT CAST(row_number() OVER (ORDER BY c) AS INTEGER), c FROM (SELECT DISTINCT simple_categories AS c FROM imputed)")
def category_dropdown(spark, sf_dir):
    return enrich.category_choices(enrich.imputed(X.books(spark, sf_dir)))


@query(" UNION ALL ".join(f"SELECT '{v}' AS vocabulary, '{', '.join(concepts(*c))}' AS prompt" for v, c in {**VOCABULARIES, "all": tuple(CLUSTERS)}.items()))
def ontology_prompt(spark, sf_dir):
    return prompt_lists(spark)


@query(" UNION ALL ".join(f"SELECT '{v}' AS vocabulary, unnest([{', '.join(chr(39) + c + chr(39) for c in vocabulary(v))}]) AS concept" for v in VOCABULARIES))
def ontology_subsets(spark, sf_dir):
    rows = spark.createDataFrame([(v, c) for v, cs in VOCABULARIES.items() for c in cs], "vocabulary string, cluster string")
    return ontology(spark).join(F.broadcast(rows), "cluster").select("vocabulary", "concept").distinct()


_TC = ["subject_isbn", "relation", "object_concept"]
_TS = "SELECT subject_isbn, relation, object_concept FROM triples WHERE relation "


@query(_T + _TS + "= 'WRITTEN_BY'")
def author_triples(spark, sf_dir):
    return triples.author_triples(X.books(spark, sf_dir)).select(*_TC)


@query(_T + _TS + "= 'HAS_CATEGORY'")
def category_triples(spark, sf_dir):
    return triples.category_triples(enrich.imputed(X.books(spark, sf_dir))).select(*_TC)


@query(_T + _TS + "IN ('WRITTEN_BY', 'HAS_CATEGORY')")
def metadata_triples(spark, sf_dir):
    return triples.metadata_triples(enrich.imputed(X.books(spark, sf_dir))).select(*_TC)


def _field_sql(f: str) -> str:
    p = X._pick
    return {
        "themes": f"CASE WHEN src_ord % 2 = 0 THEN {p('themes', '7 * src_ord')} || '|' || {p('themes', '11 * src_ord')} ELSE {p('themes', '7 * src_ord')} END",
        "settings": "CASE WHEN src_ord % 4 = 1 THEN 'place-' || CAST(CAST(floor(src_ord / 16) AS BIGINT) AS VARCHAR) ELSE '' END",
        "moods": f"CASE WHEN src_ord % 2 = 1 THEN {p('moods', 'src_ord')} ELSE '' END",
        "tropes": f"CASE WHEN src_ord % 3 = 0 THEN {p('tropes', 'src_ord')} ELSE '' END",
        "forms": f"CASE WHEN src_ord % 5 = 0 THEN {p('forms', 'src_ord')} ELSE '' END",
    }[f]


_FIELDS = ("themes", "settings", "moods", "tropes", "forms")


@query(_B + "SELECT isbn13, " + ", ".join(f"{_field_sql(f)} AS {f}" for f in _FIELDS) + " FROM books WHERE src_ord % 29 <> 0")
def validate_extractions(spark, sf_dir):
    return triples.validated(X.raw_extractions(X.books(spark, sf_dir))).select("isbn13", *[F.array_join(f, "|").alias(f) for f in _FIELDS])


@query(_B + "SELECT isbn13, 'not-a-theme' AS unknown FROM books WHERE src_ord % 29 = 0")
def rejects(spark, sf_dir):
    return triples.rejected(X.raw_extractions(X.books(spark, sf_dir)))


@query(_T + _TS + "NOT IN ('WRITTEN_BY', 'HAS_CATEGORY')")
def extraction_triples(spark, sf_dir):
    return triples.extraction_triples(triples.validated(X.raw_extractions(X.books(spark, sf_dir)))).select(*_TC)


@query(_B + "SELECT isbn13, title FROM books WHERE src_ord % 3 <> 0")
def incremental_extraction(spark, sf_dir):
    b = X.books(spark, sf_dir)
    return pending(b, b.where("src_ord % 3 = 0").select("isbn13")).select("isbn13", "title")


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_COS = f"({_DOT.format(a='{a}', b='{b}')} / (sqrt({_DOT.format(a='{a}', b='{a}')}) * sqrt({_DOT.format(a='{b}', b='{b}')})))"
_PAIRS = "cv AS (SELECT 'c' || CAST(vec_id AS VARCHAR) AS concept, vec_id AS ord, CAST(embedding AS DOUBLE[]) AS v, vec_id * 37 % 11 AS n FROM embeddings), pairs AS (SELECT * FROM (SELECT x.concept AS a, y.concept AS b, list_cosine_similarity(x.v, y.v) AS similarity FROM cv x JOIN cv y ON x.ord < y.ord) WHERE similarity >= 0.4)"
_CLUSTERS = ", sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT concept AS a, concept AS b FROM cv UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a), comp AS (SELECT a AS concept, min(b) AS component FROM reach GROUP BY 1), mapping AS (SELECT concept, first_value(concept) OVER (PARTITION BY component ORDER BY n DESC, length(concept), ord) AS canonical FROM comp JOIN cv USING (concept))"


@query("WITH " + _PAIRS + " SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def similar_pairs(spark, sf_dir):
    return vector.similar_pairs(X.concepts(spark, sf_dir), 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("WITH RECURSIVE " + _PAIRS + _CLUSTERS + " SELECT concept, canonical FROM mapping")
def dedup_mapping(spark, sf_dir):
    return dedup.dedup_mapping(X.concepts(spark, sf_dir), 0.4)


@query("SELECT 'c' || CAST(vec_id AS VARCHAR) AS concept, 'c' || CAST(vec_id AS VARCHAR) AS canonical FROM embeddings")
def dedup_mapping_default(spark, sf_dir):
    return dedup.dedup_mapping(X.concepts(spark, sf_dir))


@query("WITH RECURSIVE " + _PAIRS + _CLUSTERS + " SELECT count(*) AS concepts, count(DISTINCT canonical) AS canonical_forms, count(*) - count(DISTINCT canonical) AS merged FROM mapping")
def dedup_stats(spark, sf_dir):
    return dedup.dedup_stats(dedup.dedup_mapping(X.concepts(spark, sf_dir), 0.4))


_MAPPING = [("identity", "desire"), ("quest", "escape"), ("place-1", "place-2")]


@query(_T + "SELECT subject_isbn, relation, CASE object_concept " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _MAPPING) + " ELSE object_concept END AS object_concept FROM triples")
def apply_dedup(spark, sf_dir):
    m = spark.createDataFrame(_MAPPING, "concept string, canonical string")
    return triples.apply_mapping(X.all_triples(X.books(spark, sf_dir)), m).select(*_TC)


@query(_N + "SELECT node_id, node_type, cluster, title, authors, average_rating, simple_categories FROM nodes")
def kg_nodes(spark, sf_dir):
    b = X.books(spark, sf_dir)
    return X.nodes(b, X.edges(b))


@query(_E + "SELECT src, dst, relation FROM edges")
def kg_edges(spark, sf_dir):
    return X.edges(X.books(spark, sf_dir))


@query(_E + "SELECT dst AS neighbor FROM edges WHERE src = 'book:9780000000041'")
def book_neighbors(spark, sf_dir):
    return graph.book_neighbors(X.edges(X.books(spark, sf_dir)), "9780000000041")


@query(_E + "SELECT dst AS neighbor FROM edges WHERE src = 'book:9780000000041' AND relation = 'HAS_THEME'")
def book_neighbors_by_relation(spark, sf_dir):
    return graph.book_neighbors(X.edges(X.books(spark, sf_dir)), "9780000000041", "HAS_THEME")


@query(_E + "SELECT replace(src, 'book:', '') AS isbn13 FROM edges WHERE dst = 'concept:identity'")
def concept_books(spark, sf_dir):
    return graph.concept_books(X.edges(X.books(spark, sf_dir)), "identity")


@query(_B + "SELECT CAST(isbn13 AS VARCHAR) AS isbn13 FROM books")
def all_books(spark, sf_dir):
    b = X.books(spark, sf_dir)
    return graph.all_books(X.nodes(b, X.edges(b)))


@query(_N + "SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def kg_node_types(spark, sf_dir):
    b = X.books(spark, sf_dir)
    return graph.node_types(X.nodes(b, X.edges(b)))


@query(_E + "SELECT relation, count(*) AS n FROM edges GROUP BY 1")
def kg_edge_types(spark, sf_dir):
    return graph.edge_types(X.edges(X.books(spark, sf_dir)))


@query(_N + "SELECT nodes, edges, round(2.0 * edges / (CAST(nodes AS DOUBLE) * (nodes - 1)), 9) AS density FROM (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges)")
def kg_density(spark, sf_dir):
    b = X.books(spark, sf_dir)
    e = written(X.edges(b), "edges")
    return graph.density(X.nodes(b, e), e).select("nodes", "edges", F.round("density", 9).alias("density"))


# every node's name spreads to the greater ones that it reaches; the least that arrives names the component
_COMPONENTS = _N.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", sy AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), reach(node_id, root) AS (SELECT node_id, node_id FROM nodes UNION SELECT sy.b, reach.root FROM reach JOIN sy ON sy.a = reach.node_id AND reach.root < sy.b), comp AS (SELECT node_id, min(root) AS component FROM reach GROUP BY 1) "


@query(_COMPONENTS + "SELECT node_id, component FROM comp")
def kg_components(spark, sf_dir):
    b = X.books(spark, sf_dir)
    e = written(X.edges(b), "edges")
    return graph.components(X.nodes(b, e), e)


def _counts_json(column: str, table: str) -> str:
    """SQL for the numbers of rows by the values of a column, as a JSON object with sorted keys."""
    return f"""(SELECT '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' FROM (SELECT coalesce({column}, 'unknown') AS k, count(*) AS n FROM {table} GROUP BY 1))"""



@query(_COMPONENTS + "SELECT nodes, edges, " + _counts_json("node_type", "nodes") + " AS node_types, " + _counts_json("relation", "edges") + " AS relations, round(2.0 * edges / (CAST(nodes AS DOUBLE) * (nodes - 1)), 9) AS density, components FROM (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT component) FROM comp) AS components)")
def kg_stats(spark, sf_dir):
    b = X.books(spark, sf_dir)
    e = written(X.edges(b), "edges")
    return graph.stats(X.nodes(b, e), e).select("nodes", "edges", F.to_json("node_types").alias("node_types"), F.to_json("relations").alias("relations"), F.round("density", 9).alias("density"), "components")


_KNN = ", q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), knn AS (SELECT isbn13, " + _COS.format(a="embedding", b="qe") + " AS similarity FROM {t}, q WHERE embedding IS NOT NULL ORDER BY similarity DESC, isbn13 LIMIT 50)"


@query(_B + _KNN.format(t="books") + " SELECT isbn13, round(similarity, 6) AS similarity FROM knn")
def knn_topk(spark, sf_dir):
    return vector.knn(X.books(spark, sf_dir), X.query_vector(spark, sf_dir), DEFAULTS.initial_top_k).select("isbn13", F.round("similarity", 6).alias("similarity"))


_RESULT = ["isbn13", "title", "simple_categories"]
_FOUND = _I + _KNN.format(t="imputed") + ", found AS (SELECT i.* FROM imputed i JOIN knn USING (isbn13) {w} ORDER BY src_ord LIMIT 16) SELECT isbn13, title, simple_categories FROM found"


def _search(spark, sf_dir, **options):
    return vector.vector_search(enrich.imputed(X.books(spark, sf_dir)), X.query_vector(spark, sf_dir), **options).select(*_RESULT)


@query(_FOUND.format(w=""))
def vector_search(spark, sf_dir):
    return _search(spark, sf_dir)


@query(_FOUND.format(w="WHERE simple_categories = 'Fiction'"))
def vector_search_category(spark, sf_dir):
    return _search(spark, sf_dir, category="Fiction")


@query(_FOUND.format(w="").replace("SELECT isbn13, title, simple_categories FROM found", "SELECT isbn13, title, simple_categories, CAST(row_number() OVER (ORDER BY joy DESC NULLS LAST, src_ord) AS INTEGER) AS rank FROM found"))
def vector_search_tone(spark, sf_dir):
    d = vector.vector_search(enrich.imputed(X.books(spark, sf_dir)), X.query_vector(spark, sf_dir), tone="Happy")
    return d.select(*_RESULT, F.row_number().over(Window.orderBy(F.desc_nulls_last(TONES["Happy"]), "src_ord")).alias("rank"))


@query(_B + _KNN.format(t="books") + " SELECT isbn13, title FROM books JOIN knn USING (isbn13)")
def semantic_all_hits(spark, sf_dir):
    return vector.all_hits(X.books(spark, sf_dir), X.query_vector(spark, sf_dir)).select("isbn13", "title")


def _fixture_seeds(spark):
    return spark.createDataFrame([(0, f"book:{9780000000000 + n}", i) for i, n in enumerate(X.SEEDS)], "query_id int, node_id string, pos int")


def _san_sql(before: str, seeds: str) -> str:
    """Activation in DuckDB. before: tables made so far, with edges; seeds: a query of (node_id, pos)."""
    steps = "".join(f", s{i} AS (SELECT dst AS node_id, sum(v * w) * 0.95 AS v FROM s{i - 1} JOIN w ON node_id = src GROUP BY 1 HAVING sum(v * w) * 0.95 >= 0.01)" for i in range(1, 11))
    return before.rstrip() + f", seeds AS ({seeds}), sy AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), deg AS (SELECT src, count(*) AS d FROM sy GROUP BY 1), w AS (SELECT sy.src, dst, 0.4 / d AS w FROM sy JOIN deg ON sy.src = deg.src UNION ALL SELECT src, src, 0.6 FROM deg), s0 AS (SELECT node_id, CAST(100 AS DOUBLE) AS v FROM seeds WHERE node_id IN (SELECT src FROM deg)){steps}"


_FIXED_SEEDS = "SELECT col0 AS node_id, col1 AS pos FROM (VALUES " + ", ".join(f"('book:{9780000000000 + n}', {i})" for i, n in enumerate(X.SEEDS)) + ")"
_SAN = _san_sql(_E, _FIXED_SEEDS)
_BOOKS_FOUND = ", found AS (SELECT replace(node_id, 'book:', '') AS isbn13, v FROM s10 WHERE node_id LIKE 'book:%' AND v >= 0.1 AND node_id NOT IN (SELECT node_id FROM s0) ORDER BY round(v, 6) DESC, isbn13 LIMIT {k})"
#: Shortest paths of two and four edges from seeds to targets(target), which books of one search always have; the least path, node by node, then the first seed.
_WHY = """, two AS (SELECT target, x.src AS seed, pos, 2 AS n, min(x.dst) AS mid FROM seeds JOIN sy x ON x.src = seeds.node_id JOIN sy y ON y.src = x.dst JOIN targets ON y.dst = target WHERE target <> seeds.node_id GROUP BY 1, 2, 3)
, four AS (SELECT target, seed, pos, 4 AS n, min(mid || chr(1) || x.dst) AS mid FROM (SELECT seeds.node_id AS seed, pos, b.dst AS turn, min(a.dst || chr(1) || b.dst) AS mid FROM seeds JOIN sy a ON a.src = seeds.node_id JOIN sy b ON b.src = a.dst GROUP BY 1, 2, 3) JOIN sy x ON x.src = turn JOIN sy y ON y.src = x.dst JOIN targets ON y.dst = target GROUP BY 1, 2, 3)
, why AS (SELECT target, seed, string_split(mid, chr(1)) AS mids FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n, pos) AS best FROM (SELECT * FROM two UNION ALL SELECT * FROM four)) WHERE best = 1)"""
_EXPLAINED = _SAN + _BOOKS_FOUND.format(k=16) + ", targets AS (SELECT 'book:' || isbn13 AS target FROM found)" + _WHY
_VIA = "list_filter(mids, lambda x: NOT starts_with(x, 'book:'))"


@query(_SAN + " SELECT node_id, round(v, 6) AS activation FROM s10")
def san_status(spark, sf_dir):
    return spreading.activate(X.edges(X.books(spark, sf_dir)), _fixture_seeds(spark)).select("node_id", F.round("activation", 6).alias("activation"))


@query(_SAN + _BOOKS_FOUND.format(k=20) + " SELECT isbn13, round(v, 6) AS activation FROM found")
def san_books(spark, sf_dir):
    seeds = _fixture_seeds(spark)
    return spreading.activated_books(spreading.activate(X.edges(X.books(spark, sf_dir)), seeds), seeds).select("isbn13", F.round("activation", 6).alias("activation"))


@query(_SAN + _BOOKS_FOUND.format(k=48) + " SELECT i.isbn13, title, simple_categories, round(v, 6) AS activation_score FROM found f JOIN imputed i ON CAST(i.isbn13 AS VARCHAR) = f.isbn13 WHERE simple_categories = 'Fiction' ORDER BY round(v, 6) DESC, i.isbn13 LIMIT 16")
def san_search_category(spark, sf_dir):
    b = X.books(spark, sf_dir)
    return san_search(enrich.imputed(b), X.edges(b), _fixture_seeds(spark), category="Fiction").select(*_RESULT, F.round("activation_score", 6).alias("activation_score"))


_SEED_IDS = ", ".join(f"'book:{9780000000000 + n}'" for n in X.SEEDS)


@query(_E + f"SELECT x.src AS a, y.src AS b, count(*) AS shared, min(x.dst) AS first_shared FROM edges x JOIN edges y ON x.dst = y.dst AND x.src <> y.src WHERE x.src IN ({_SEED_IDS}) GROUP BY 1, 2")
def shared_concepts(spark, sf_dir):
    """The seeds, a stated query set, against all books."""
    e = written(X.edges(X.books(spark, sf_dir)), "edges")
    x = e.where(F.col("src").isin([f"book:{9780000000000 + n}" for n in X.SEEDS])).select(F.col("src").alias("a"), "dst")
    return x.join(e.select(F.col("src").alias("b"), "dst"), "dst").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("dst").alias("first_shared"))


def _explained(spark, sf_dir):
    b = X.books(spark, sf_dir)
    e = written(X.edges(b), "edges")
    seeds = _fixture_seeds(spark)
    found = written(spreading.activated_books(spreading.activate(e, seeds), seeds, DEFAULTS.san_top_k), "found")
    targets = found.select(F.concat(F.lit("book:"), "isbn13").alias("target"))
    return b, paths.explanations(e, seeds, targets)


@query(_EXPLAINED + f" SELECT target, seed, seed || ' > ' || array_to_string(mids, ' > ') || ' > ' || target AS path, array_to_string({_VIA}, ' > ') AS via FROM why")
def explain(spark, sf_dir):
    return _explained(spark, sf_dir)[1].select("target", "seed", F.array_join("path", " > ").alias("path"), F.array_join("via", " > ").alias("via"))


# a letter is a capital unless it follows a letter
_LABEL = "array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr({x}, i - 1, 1), '\\p{{L}}') THEN lower(substr({x}, i, 1)) ELSE upper(substr({x}, i, 1)) END), '')"
_NAMED = "'<strong>' || " + _LABEL.format(x="replace(substr(v, strpos(v, ':') + 1), '-', ' ')") + " || '</strong> (' || split_part(v, ':', 1) || ')'"
_LINES_SQL = f"""lines AS (SELECT target, '<p>&bull; <em>"' || t.title || '"</em> discovered via: ' || CASE WHEN len({_VIA}) > 0 THEN array_to_string(list_transform({_VIA}, lambda v: {_NAMED}), ' &rarr; ') ELSE 'direct' END || ' &mdash; shared with <em>"' || s.title || '"</em></p>' AS html
 FROM why JOIN nodes_t t ON t.node_id = target JOIN nodes_t s ON s.node_id = seed)"""


@query(_EXPLAINED + ", nodes_t AS (SELECT 'book:' || CAST(isbn13 AS VARCHAR) AS node_id, title FROM books), " + _LINES_SQL + """ SELECT '<div style="font-size: 14px; line-height: 1.8;">' || chr(10) || string_agg(html, chr(10) ORDER BY target, html) || chr(10) || '</div>' AS html FROM lines""")
def explanation_html(spark, sf_dir):
    b, found = _explained(spark, sf_dir)
    return present.explanation_html(present.explanation_lines(found, b))


_AUTHORS_SQL = "CASE WHEN len(string_split(authors, ';')) = 2 THEN string_split(authors, ';')[1] || ' and ' || string_split(authors, ';')[2] WHEN len(string_split(authors, ';')) = 3 THEN string_split(authors, ';')[1] || ', ' || string_split(authors, ';')[2] || ', and ' || string_split(authors, ';')[3] ELSE coalesce(authors, '') END"


@query(_B + f"SELECT isbn13, coalesce(thumbnail || '&fife=w800', 'cover-not-found.jpg') AS thumbnail, title || ' by ' || {_AUTHORS_SQL} || ': ' || coalesce(array_to_string(list_slice(list_filter(string_split_regex(description, '\\s+'), lambda x: x <> ''), 1, 30), ' '), '') || '...' AS caption FROM books")
def book_cards(spark, sf_dir):
    return present.cards(X.books(spark, sf_dir).withColumn("large_thumbnail", enrich.large_thumbnail()))


_HITS = ", hits AS (SELECT i.*, knn.similarity FROM imputed i JOIN knn USING (isbn13) ORDER BY src_ord LIMIT 16)"
_RECOMMENDED = (
    _san_sql(_E.rstrip() + _KNN.format(t="imputed") + _HITS, "SELECT 'book:' || CAST(isbn13 AS VARCHAR) AS node_id, row_number() OVER (ORDER BY src_ord) AS pos FROM hits ORDER BY src_ord LIMIT 5")
    + _BOOKS_FOUND.format(k=48)
    + ", san AS (SELECT i.*, f.v FROM found f JOIN imputed i ON CAST(i.isbn13 AS VARCHAR) = f.isbn13 ORDER BY round(v, 6) DESC, i.isbn13 LIMIT 16), targets AS (SELECT 'book:' || CAST(isbn13 AS VARCHAR) AS target FROM san)"
    + _WHY
)


@query(_RECOMMENDED + f" SELECT 'vector' AS kind, isbn13, title, simple_categories, round(similarity, 6) AS score, NULL AS seed, NULL AS via FROM hits UNION ALL SELECT 'activated', isbn13, title, simple_categories, round(v, 6), seed, array_to_string({_VIA}, ' > ') FROM san LEFT JOIN why ON target = 'book:' || CAST(isbn13 AS VARCHAR)")
def recommend_flagship(spark, sf_dir):
    b = X.books(spark, sf_dir)
    e = written(X.edges(b), "edges")
    r = recommend(enrich.imputed(b), X.query_vector(spark, sf_dir), e)
    keep = lambda d, kind, score: d.select(F.lit(kind).alias("kind"), "isbn13", "title", "simple_categories", score.alias("score"))
    san = keep(r.activated, "activated", F.round("activation_score", 6)).withColumn("target", F.concat(F.lit("book:"), F.col("isbn13").cast("string")))
    why = r.explanations.select("target", "seed", F.array_join("via", " > ").alias("via"))
    return keep(r.vector, "vector", F.round("similarity", 6)).withColumns({"seed": F.lit(None).cast("string"), "via": F.lit(None).cast("string")}).unionByName(san.join(why, "target", "left").drop("target"))


QUERIES["recommend"] = QUERIES.pop("recommend_flagship")
ORACLE_SQL["recommend"] = ORACLE_SQL.pop("recommend_flagship")


@query(_E + "SELECT src, dst, relation FROM edges")
def graphml_roundtrip(spark, sf_dir):
    b = X.books(spark, sf_dir)
    e = written(X.edges(b), "edges")
    path = work_path(spark, "graphml")
    writers.write_graphml(X.nodes(b, e), e, path)
    return readers.read_graphml(spark, path)[1]


@query(ORACLE_SQL["clean_books"])
def csv_roundtrip(spark, sf_dir):
    path = work_path(spark, "csv")
    writers.write_csv(clean_books(spark, sf_dir), path)
    return readers.read_books_csv(spark, path, readers.CLEANED)


@query(_B + f"SELECT CAST(isbn13 AS VARCHAR) || ' ' || trim(regexp_replace(description, '[\\r\\n]+', ' ', 'g')) AS content, isbn13 FROM books WHERE {_NOTNULL} AND {_WC} >= 25")
def document_lines(spark, sf_dir):
    from stacklight.functions.text import leading_isbn

    path = work_path(spark, "lines")
    writers.write_lines(clean_books(spark, sf_dir), path)
    return readers.read_lines(spark, path).select("content", leading_isbn(F.col("content")).alias("isbn13"))


@query(_I + "SELECT isbn13, simple_categories FROM imputed WHERE isbn13 IN (SELECT 9780000000000 + p_partkey FROM part WHERE p_size > 25)")
def large_books(spark, sf_dir):
    """Semi-join with a pushed-down filter."""
    from stacklight.session import table

    keys = table(spark, sf_dir, "part").where("p_size > 25").select((F.lit(9780000000000) + F.col("p_partkey")).alias("isbn13"))
    return enrich.imputed(X.books(spark, sf_dir)).join(keys, "isbn13", "left_semi").select("isbn13", "simple_categories")





@query(_I + f"SELECT isbn13, title, simple_categories FROM imputed WHERE {_NOTNULL} AND {_WC} >= 25")
def categorise_pipeline(spark, sf_dir):
    """Clean, write, read, impute, write, read."""
    cleaned = work_path(spark, "cleaned")
    writers.write_csv(clean_books(spark, sf_dir), cleaned)
    return pipelines.categorised(spark, cleaned, work_path(spark, "categorised")).select("isbn13", "title", "simple_categories")


@query(_emotion_sql([("anger", "a"), ("disgust", "d"), ("fear", "f"), ("joy", "j"), ("sadness", "s"), ("surprise", "u"), ("neutral", "n")]) + f" AND {_NOTNULL} AND {_WC} >= 25")
def emotion_pipeline(spark, sf_dir):
    """The categorised table of the pipeline before, scored, written and read."""
    cleaned, with_categories = work_path(spark, "cleaned"), work_path(spark, "categorised")
    writers.write_csv(clean_books(spark, sf_dir), cleaned)
    pipelines.categorised(spark, cleaned, with_categories)
    b = pipelines.emotional(spark, with_categories, work_path(spark, "emotional"))
    return b.select("isbn13", *[F.round(e, 6).alias(e) for e in enrich.EMOTIONS])


_LETTER_COUNTS = "[" + ", ".join(f"CAST(length({{x}}) - length(replace({{x}}, '{c}', '')) AS DOUBLE)" for c in "abcdefghijklmnopqrstuvwxyz0123456789") + "]"
_MERGED = (
    _T.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + ", con AS (SELECT object_concept AS concept, count(*) AS n FROM triples WHERE relation NOT IN ('WRITTEN_BY', 'HAS_CATEGORY') GROUP BY 1), cv AS (SELECT *, "
    + _LETTER_COUNTS.format(x="concept")
    + " AS v FROM con), pairs AS (SELECT x.concept AS a, y.concept AS b FROM cv x JOIN cv y ON x.concept <> y.concept WHERE list_cosine_similarity(x.v, y.v) >= 0.92 - 1e-12), reach(concept, root) AS (SELECT concept, concept FROM cv UNION SELECT pairs.b, reach.root FROM reach JOIN pairs ON pairs.a = reach.concept)"
    + ", comp AS (SELECT concept, min(root) AS component FROM reach GROUP BY 1), mapping AS (SELECT concept, first_value(concept) OVER (PARTITION BY component ORDER BY n DESC, length(concept), concept) AS canonical FROM comp JOIN con USING (concept))"
    + ", merged AS (SELECT subject_isbn, relation, CASE WHEN relation IN ('WRITTEN_BY', 'HAS_CATEGORY') THEN object_concept ELSE coalesce(canonical, object_concept) END AS object_concept FROM triples LEFT JOIN mapping ON concept = object_concept)"
)


@query(_MERGED + f" SELECT 'book:' || subject_isbn AS src, {X._PREFIX} || ':' || object_concept AS dst, max(relation) AS relation FROM merged GROUP BY 1, 2")
def kg_build(spark, sf_dir):
    """Metadata and extraction triples, near-duplicate concepts merged, the graph built, saved and loaded."""
    b = X.books(spark, sf_dir)
    return pipelines.build_graph(enrich.imputed(b), X.raw_extractions(b), work_path(spark, "graph"))[1]


_CARDS_SQL = f"SELECT isbn13, coalesce(thumbnail || '&fife=w800', 'cover-not-found.jpg') AS thumbnail, title || ' by ' || {_AUTHORS_SQL} || ': ' || coalesce(array_to_string(list_slice(list_filter(string_split_regex(description, '\\s+'), lambda x: x <> ''), 1, 30), ' '), '') || '...' AS caption"


@query(_FOUND.format(w="").replace("SELECT isbn13, title, simple_categories FROM found", f"SELECT *, '{pipelines.NOT_ENABLED}' AS html FROM ({_CARDS_SQL} FROM found)"))
def recommend_degraded(spark, sf_dir):
    """The page where no graph has been built: vector results and a message."""
    b = enrich.imputed(X.books(spark, sf_dir)).withColumn("large_thumbnail", enrich.large_thumbnail())
    left, _, html = pipelines.handled(pipelines.started(spark, b, work_path(spark, "no-graph")), X.query_vector(spark, sf_dir))
    return left.crossJoin(F.broadcast(html))  # one row


_STORE_Q = "a quest for identity and freedom in a wartime town"


@query(_B + f", docs AS (SELECT isbn13, lower(CAST(isbn13 AS VARCHAR) || ' ' || trim(regexp_replace(description, '[\\r\\n]+', ' ', 'g'))) AS x FROM books WHERE {_NOTNULL} AND {_WC} >= 25), q AS (SELECT '{_STORE_Q}' AS y) SELECT isbn13, round(similarity, 6) AS similarity FROM (SELECT isbn13, list_cosine_similarity({_LETTER_COUNTS.format(x='x')}, {_LETTER_COUNTS.format(x='y')}) AS similarity FROM docs, q) ORDER BY round(similarity, 9) DESC, isbn13 LIMIT 10")
def vector_store_search(spark, sf_dir):
    """A store of the document lines, built, saved and read, and the ten lines nearest to a text."""
    from stacklight.functions.providers import stub_embedding

    lines, store = work_path(spark, "lines"), work_path(spark, "store")
    writers.write_lines(clean_books(spark, sf_dir), lines)
    writers.write_vector_store(readers.read_lines(spark, lines), store, stub_embedding)
    q = spark.createDataFrame([(_STORE_Q,)], "text string").select(stub_embedding(F.col("text")).alias("q_embedding"))
    return vector.knn(readers.read_vector_store(spark, store), q, 10).select("isbn13", F.round("similarity", 6).alias("similarity"))


@query(ORACLE_SQL["validate_extractions"])
def extraction_json_roundtrip(spark, sf_dir):
    """The cache of valid extractions as JSON, written and read."""
    path = work_path(spark, "cache-json")
    writers.write_extraction_json(triples.validated(X.raw_extractions(X.books(spark, sf_dir))), path)
    return readers.read_extraction_json(spark, path).select("isbn13", *[F.array_join(f, "|").alias(f) for f in _FIELDS])


@query(_B + "SELECT isbn13, title, authors FROM books WHERE isbn13 = 9780000000041")
def point_lookup(spark, sf_dir):
    return enrich.lookup(X.books(spark, sf_dir), 9780000000041).select("isbn13", "title", "authors")


@query(_B + f"SELECT isbn13, description FROM (SELECT *, {X._CASE} AS c FROM books) WHERE c = 'Fiction' ORDER BY src_ord LIMIT 1")
def first_fiction(spark, sf_dir):
    return enrich.subset_row(enrich.with_simple_categories(X.books(spark, sf_dir)), "simple_categories", "Fiction").select("isbn13", "description")


@query(_B + "SELECT isbn13, title FROM books ORDER BY src_ord LIMIT 10")
def first_rows(spark, sf_dir):
    return enrich.first_rows(X.books(spark, sf_dir)).select("isbn13", "title")


@query("SELECT * FROM (VALUES (0, 'All'), (1, 'Happy'), (2, 'Surprising'), (3, 'Angry'), (4, 'Suspenseful'), (5, 'Sad')) t(ord, tone)")
def tone_dropdown(spark, sf_dir):
    return enrich.tone_choices(spark)


@query("SELECT string_agg(prompt || chr(10), '' ORDER BY vocabulary) AS content FROM (" + ORACLE_SQL["ontology_prompt"] + ")")
def whole_text(spark, sf_dir):
    """A text file as one document."""
    path = work_path(spark, "vocabularies")
    prompt_lists(spark).coalesce(1).sortWithinPartitions("vocabulary").select("prompt").write.text(path)
    return readers.read_whole_text(spark, path)


@query("SELECT 0::BIGINT AS n")
def empty_cache(spark, sf_dir):
    """A cache that isn't there is empty, in both forms."""
    path = work_path(spark, "no-cache")
    return readers.read_extractions(spark, path).unionByName(readers.read_extraction_json(spark, path)).agg(F.count("*").alias("n"))


@query(_B + "SELECT isbn13, 'Title: ' || coalesce(title, '') || chr(10) || 'Description: ' || substr(description, 1, 2000) AS prompt FROM books WHERE trim(regexp_replace(description, '\\s+', ' ', 'g')) <> ''")
def extraction_prompts(spark, sf_dir):
    from stacklight.functions.providers import human_prompt
    from stacklight.functions.text import is_blank

    return X.books(spark, sf_dir).where(~is_blank(F.col("description"))).select("isbn13", human_prompt(F.col("title"), F.col("description")).alias("prompt"))


def _answer(title: str, description: str) -> dict | None:
    """A stand-in for a chat model: fails, refuses or answers by the length of the text."""
    n = len(description) % 7
    if n == 0:
        raise TimeoutError("no answer")
    return None if n == 1 else {"themes": ["grief"], "settings": [f"place-{n}"]}


_BLANK_SQL = "description IS NULL OR trim(regexp_replace(description, '\\s+', ' ', 'g')) = ''"
_N7 = "length(substr(description, 1, 2000)) % 7"


@query(_B + f"SELECT isbn13, CASE WHEN {_BLANK_SQL} THEN 'blank' WHEN {_N7} = 0 THEN 'failed' WHEN {_N7} = 1 THEN 'refused' ELSE 'extracted' END AS outcome, CAST(CASE WHEN {_BLANK_SQL} THEN 0 WHEN {_N7} = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN NOT ({_BLANK_SQL}) AND {_N7} = 0 THEN 'TimeoutError: no answer' END AS error FROM books")
def extraction_outcomes(spark, sf_dir):
    """What came of each book, failures told apart from refusals."""
    from stacklight.functions.providers import outcomes

    return outcomes(X.books(spark, sf_dir), _answer).select("isbn13", "outcome", "attempts", "error")


@query(_B + f"SELECT isbn13, 'grief' AS themes, 'place-' || {_N7} AS settings FROM books WHERE NOT ({_BLANK_SQL}) AND {_N7} > 1")
def extraction_cache(spark, sf_dir):
    """The cache after a run over a third of the books and one over all: nothing is asked for twice."""
    from stacklight.streaming.incremental import extend_cache

    b, path = X.books(spark, sf_dir), work_path(spark, "cache")
    extend_cache(spark, b.where("src_ord % 3 = 0"), path, _answer)
    return extend_cache(spark, b, path, _answer).select("isbn13", F.array_join("themes", "|").alias("themes"), F.array_join("settings", "|").alias("settings"))


@query(_B + f"SELECT isbn13, coalesce({X._CASE}, CASE WHEN length(coalesce(description, '')) % 2 = 0 THEN 'Fiction' ELSE 'Nonfiction' END) AS simple_categories FROM books")
def zero_shot_model(spark, sf_dir):
    """Imputation by a model that is called with Arrow batches."""
    from stacklight.functions.providers import zero_shot_model as hook

    score = hook(lambda: lambda texts, labels: [[0.75, 0.25] if len(t) % 2 == 0 else [0.25, 0.75] for t in texts])
    return enrich.imputed(X.books(spark, sf_dir), provider=score).select("isbn13", "simple_categories")


@query(ORACLE_SQL["emotion_max"])
def emotion_model(spark, sf_dir):
    """Emotions by a model that is called with Arrow batches of sentences."""
    from stacklight.functions.providers import LETTERS
    from stacklight.functions.providers import emotion_model as hook

    feel = hook(lambda: lambda sentences: [{e: t.count(c) / (len(t) + 1) for e, c in LETTERS.items()} for t in sentences])
    b = enrich.with_emotions(X.books(spark, sf_dir).where("description IS NOT NULL"), model=feel)
    return b.select("isbn13", *[F.round(e, 6).alias(e) for e in enrich.EMOTIONS])


@query(_B + "SELECT isbn13, CAST(length(coalesce(description, '')) AS DOUBLE) AS first, CAST(length(coalesce(description, '')) - length(replace(coalesce(description, ''), 'e', '')) AS DOUBLE) AS second FROM books")
def embedding_model(spark, sf_dir):
    """Vectors by a model that is called with Arrow batches."""
    from stacklight.functions.providers import embedding_model as hook

    embed = hook(lambda: lambda texts: [[len(t), t.count("e")] for t in texts])
    return X.books(spark, sf_dir).select("isbn13", embed(F.col("description")).alias("v")).select("isbn13", F.col("v")[0].cast("double").alias("first"), F.col("v")[1].cast("double").alias("second"))


_TWO_QUERIES = {0: X.SEEDS, 1: (7, 50)}


def _batch_sql() -> str:
    each = []
    for q, ids in _TWO_QUERIES.items():
        seeds = "SELECT col0 AS node_id, col1 AS pos FROM (VALUES " + ", ".join(f"('book:{9780000000000 + n}', {i})" for i, n in enumerate(ids)) + ")"
        each.append(f"SELECT {q} AS query_id, * FROM ({_san_sql(_E, seeds)}{_BOOKS_FOUND.format(k=20)} SELECT isbn13, round(v, 6) AS activation FROM found)")
    return " UNION ALL ".join(each)


@query(_batch_sql())
def san_batch(spark, sf_dir):
    """Two queries in one run, each with its own top books."""
    seeds = spark.createDataFrame([(q, f"book:{9780000000000 + n}") for q, ids in _TWO_QUERIES.items() for n in ids], "query_id int, node_id string")
    return spreading.activated_books(spreading.activate(X.edges(X.books(spark, sf_dir)), seeds), seeds).select("query_id", "isbn13", F.round("activation", 6).alias("activation"))


@query(_RECOMMENDED + f" SELECT 'vector' AS kind, * FROM ({_CARDS_SQL} FROM hits) UNION ALL SELECT 'activated', * FROM ({_CARDS_SQL} FROM san)")
def recommend_page(spark, sf_dir):
    """The galleries of the page, with the graph built, saved and loaded."""
    x = X.books(spark, sf_dir)
    e = written(X.edges(x), "edges")
    path = work_path(spark, "graph")
    writers.write_graph(X.nodes(x, e), e, path)
    b = enrich.imputed(x).withColumn("large_thumbnail", enrich.large_thumbnail())
    left, right, _ = pipelines.handled(pipelines.started(spark, b, path), X.query_vector(spark, sf_dir))
    return left.select(F.lit("vector").alias("kind"), "*").unionByName(right.select(F.lit("activated").alias("kind"), "*"))
