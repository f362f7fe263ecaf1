"""Golden cases and properties of the operators."""

from __future__ import annotations

import random
import types
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight import session
from stacklight.functions import providers
from stacklight.functions import text as T
from stacklight.functions.providers import extract
from stacklight.operators import dedup, enrich, graph, paths, present, spreading, triples, vector
from stacklight.operators.components import connected_components
from stacklight.operators.ranges import cumulated
from stacklight.plans import fixtures as X
from stacklight.plans import pipelines
from stacklight.plans.recommend import page, recommend
from stacklight.session import work_path
from stacklight.sources import readers, writers
from stacklight.streaming import incremental
from stacklight.streaming.incremental import extend_cache, stream_cache


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, "\t a  b\n", T.normalised) == "a--b"
    assert one(spark, " a b \tc", T.word_count) == 3
    assert one(spark, "", T.word_count) == 0
    assert one(spark, None, T.word_count) is None
    assert one(spark, "a.b.", T.sentences) == ["a", "b", ""]
    assert one(spark, "", T.sentences) == [""]
    assert one(spark, "o'brien j.r.r. 1960s", T.title_case) == "O'Brien J.R.R. 1960S"
    assert one(spark, "concept:self-discovery", T.node_label) == "Self Discovery"
    assert one(spark, "plain", T.node_type) == "concept"
    assert one(spark, '"978 a text"', T.leading_isbn) == 978
    assert [one(spark, a, T.author_prose) for a in ("A", "A;B", "A;B;C", None)] == ["A", "A and B", "A, B, and C", None]
    assert one(spark, " a  b ", T.first_words) == "a b..."


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "HAS_THEME") for a, b in pairs], "src string, dst string, relation string")


def test_components_against_union_find(spark):
    r = random.Random(3)
    for n, m in ((60, 40), (200, 150), (30, 200)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
        parent: dict[int, int] = {}

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        got = {x.node: x.component for x in connected_components(spark.createDataFrame([*pairs, (None, 1)], "src long, dst long")).collect()}
        assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_paths(spark):
    e = edges(spark, [("book:1", "concept:a"), ("book:2", "concept:a"), ("book:2", "concept:b"), ("book:3", "concept:b"), ("book:9", "concept:z"), ("book:1", "author:x"), ("book:2", "author:x")])
    pairs = spark.createDataFrame([("book:1", "book:3"), ("book:1", "book:1"), ("book:1", "book:9"), ("book:7", "book:1"), ("book:1", "book:2")], "source string, target string")
    got = {(x.source, x.target): x.path for x in paths.shortest_paths(e, pairs).collect()}
    assert got == {("book:1", "book:3"): ["book:1", "author:x", "book:2", "concept:b", "book:3"], ("book:1", "book:1"): ["book:1"], ("book:1", "book:2"): ["book:1", "author:x", "book:2"]}
    seeds = spark.createDataFrame([("book:3", 1), ("book:1", 0)], "node_id string, pos int")
    got = paths.explanations(e, seeds, spark.createDataFrame([("book:2",)], "target string")).first()
    assert got.seed == "book:1" and got.via == ["author:x"]


def test_activation(spark):
    e = edges(spark, [("book:1", "concept:a"), ("book:2", "concept:a"), ("book:3", "concept:b")])
    seeds = spark.createDataFrame([(0, "book:1"), (0, "book:none"), (1, "book:3")], "query_id int, node_id string")
    got = {(x.query_id, x.node_id): x.activation for x in spreading.activate(e, seeds).collect()}
    state = {"book:1": 100.0}
    near = {"book:1": ["concept:a"], "book:2": ["concept:a"], "concept:a": ["book:1", "book:2"]}
    for _ in range(10):
        new: dict[str, float] = {}
        for n, v in state.items():
            new[n] = new.get(n, 0) + 0.6 * v
            for m in near[n]:
                new[m] = new.get(m, 0) + 0.4 * v / len(near[n])
        state = {n: v * 0.95 for n, v in new.items() if v * 0.95 >= 0.01}
    assert {n: round(v, 9) for (q, n), v in got.items() if q == 0} == {n: round(v, 9) for n, v in state.items()}
    assert sum(state.values()) <= 100 * 0.95**10 + 1e-9
    assert spreading.activate(e, seeds.where("query_id > 5")).count() == 0


def test_validation_and_triples(spark):
    six = ["identity", "grief", "trauma", "obsession", "guilt", "madness"]
    rows = [(1, [*six], [], [], [], []), (2, [*six[:5], "nonsense"], [], [], [], []), (3, [" Self Discovery", "grief", "grief"], ["Old  Town"], None, [], [])]
    raw = spark.createDataFrame(rows, readers.EXTRACTION)
    valid = {x.isbn13: x for x in triples.validated(raw).collect()}
    assert set(valid) == {1, 3} and valid[1].themes == six[:5]
    assert [x.unknown for x in triples.rejected(raw).collect()] == ["nonsense"]
    t = triples.extraction_triples(triples.validated(raw))
    assert t.where("subject_isbn = '3'").count() == 4
    assert graph.build_edges(t).where("src = 'book:3'").count() == 3
    last = spark.createDataFrame([("1", "HAS_THEME", "x", 1), ("1", "HAS_MOOD", "x", 2)], "subject_isbn string, relation string, object_concept string, ord int")
    e = graph.build_edges(last)
    assert [x.relation for x in e.collect()] == ["HAS_MOOD"]
    books = spark.createDataFrame([], "isbn13 long, src_ord long, title string, authors string, average_rating double, simple_categories string")
    n = graph.build_nodes(books, e)
    assert {x.node_type: x.n for x in graph.node_types(n).collect()} == {"concept": 1, "unknown": 1}
    s = graph.stats(n, e).first()
    assert (s.nodes, s.edges, s.components, s.density) == (2, 1, 1, 1.0)


def test_dedup(spark):
    v = {"a": [1.0, 0.0], "b": [0.9, 0.4], "cc": [0.6, 0.8], "far": [-1.0, 0.0], "zero": [0.0, 0.0]}
    d = spark.createDataFrame([(k, i, x, n) for i, ((k, x), n) in enumerate(zip(v.items(), (1, 3, 3, 0, 0), strict=True))], "concept string, ord int, embedding array<float>, count int")
    assert {x.concept: x.canonical for x in dedup.dedup_mapping(d, 0.85).collect()} == {"a": "b", "b": "b", "cc": "b", "far": "far", "zero": "zero"}
    assert dedup.dedup_mapping(d.limit(1)).count() == 1


def test_pairs_over_blocks(spark):
    r = random.Random(1)
    d = spark.createDataFrame([(f"c{i}", i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)], "concept string, ord int, embedding array<double>")
    few, many = ({(x.a, x.b) for x in vector.similar_pairs(d, 0.7, block=n).collect()} for n in (1000, 7))
    assert few == many and few


def test_links_of_pairs(spark, monkeypatch):
    """Few links, of one copy of a vector, with the components of all pairs; a row is dealt to no more than DEALT pairs of blocks; zero vectors are no copies."""
    r = random.Random(4)
    rows = [[r.gauss(0, 1) for _ in range(6)] for _ in range(90)] + [[0.0] * 6] * 3
    rows += rows[:1] * 100 + [[x * 2 for x in rows[1]]] * 20
    d = spark.createDataFrame([(f"c{i}", i, v, i % 7) for i, v in enumerate(rows)], "concept string, ord int, embedding array<double>, count int")
    pairs = vector.similar_pairs(d, 0.8)
    want = {x.node: x.component for x in connected_components(pairs, "a", "b").collect()}
    monkeypatch.setattr(vector, "TILE", 8)
    links = vector.similar_links(d, 0.8, block=5)
    assert {x.node: x.component for x in connected_components(links, "a", "b").collect()} == want and not {"c90", "c91", "c92"} & set(want)
    assert links.count() < 1000 < pairs.count()
    dealt = []
    monkeypatch.setattr(vector, "_blocked", lambda x, *a, real=vector._blocked: (dealt.append(x.agg(F.max("blocks")).first()[0]), real(x, *a))[1])
    assert {(x.a, x.b) for x in vector.similar_pairs(d, 0.8, block=1).collect()} == {(x.a, x.b) for x in pairs.collect()} and dealt == [vector.DEALT]


def test_pairs_by_bands(spark):
    """Sign bands find the pairs that comparing all finds."""
    r = random.Random(2)
    rows = [[r.gauss(0, 1) for _ in range(24)] for _ in range(120)]
    rows += [[x + r.gauss(0, 0.2) for x in v] for v in rows[:60]]
    d = spark.createDataFrame([(f"c{i}", i, v) for i, v in enumerate(rows)], "concept string, ord int, embedding array<double>")
    full = {(x.a, x.b): round(x.similarity, 9) for x in vector.similar_pairs(d, 0.92).collect()}
    some = {(x.a, x.b): round(x.similarity, 9) for x in vector.similar_pairs(d, 0.92, block=16, lsh=True).collect()}
    assert some.items() <= full.items() and len(some) >= 0.98 * len(full) > 30


def test_search_and_page(spark, sf_dir):
    b = enrich.imputed(X.books(spark, sf_dir))
    r = recommend(b, X.query_vector(spark, sf_dir), X.edges(X.books(spark, sf_dir)), tone="Happy")
    left, right, html = page(r, b)
    assert left.count() == 16 and right.count() == r.activated.count() > 0
    assert html.first().html.startswith("<div") and "discovered via" in html.first().html
    assert recommend(b, X.query_vector(spark, sf_dir), None).activated is None
    assert present.explanation_html(present.explanation_lines(r.explanations.limit(0), b)).first().html == present.NONE_FOUND
    assert vector.vector_search(b, X.query_vector(spark, sf_dir), rank_mode="similarity", category=None).count() == 16


def test_extraction_cache_and_stream(spark, sf_dir):
    b = spark.createDataFrame([(1, "t", "text"), (2, "t", " "), (3, "bad", "x")], "isbn13 long, title string, description string")

    def provider(title, description):
        if title == "bad":
            raise ValueError("no answer")
        return {"themes": ["grief"]}

    assert [x.isbn13 for x in extract(b, provider).collect()] == [1]
    path = work_path(spark, "cache")
    assert extend_cache(spark, b, path, provider).count() == 1
    assert extend_cache(spark, b, path, provider).count() == 1
    source = work_path(spark, "stream")
    b.write.parquet(source)
    stream_cache(spark.readStream.schema(b.schema).parquet(source), path, work_path(spark, "progress"), lambda t, d: {"themes": ["war"]}).awaitTermination(60)
    assert readers.read_extractions(spark, path).count() == 2


def test_steps_of_the_cache(spark, monkeypatch):
    """A fast model's cache grows in a few steps whatever its size; a slow model's by save_every books a core."""
    steps, cores = [], spark.sparkContext.defaultParallelism
    monkeypatch.setattr(incremental, "append_extractions", lambda df, path: (steps.append(path), writers.append_extractions(df, path)))
    b = spark.range(2000).select(F.col("id").alias("isbn13"), F.lit("t").alias("title"), F.lit("text").alias("description"))
    for seconds, rows, want in ((1e9, 2000, (2000 // cores).bit_length()), (0.0, 24, -(-24 // cores))):
        path = work_path(spark, "cache")
        config = providers.ExtractorConfig(save_every=1, step_seconds=seconds)
        assert sorted(x.isbn13 for x in extend_cache(spark, b.limit(rows), path, lambda t, d: {"themes": ["war"]}, config).collect()) == list(range(rows))
        assert steps.count(path) == want


def test_csv_and_graphml(spark):
    d = spark.createDataFrame([(1, 'a "b", c', None, "x\ny", None)], "isbn13 long, title string, subtitle string, description string, num_pages double")
    path = work_path(spark, "csv")
    writers.write_csv(d, path)
    assert readers.read_books_csv(spark, path, "isbn13 long, title string, subtitle string, description string, num_pages double").first() == d.first()
    e = edges(spark, [("book:1", 'concept:a&"b<')])
    n = graph.build_nodes(spark.createDataFrame([(1, 0, "T & <U>\nV", None, 4.5, "Fiction")], "isbn13 long, src_ord long, title string, authors string, average_rating double, simple_categories string"), e)
    path = work_path(spark, "graph")
    writers.write_graphml(n, e, path)
    nodes, back = readers.read_graphml(spark, path)
    assert back.first() == e.first()
    assert {(x.node_id, x.title, x.average_rating) for x in nodes.collect()} == {(x.node_id, x.title, x.average_rating) for x in n.collect()}


def test_graphml_of_others(spark):
    """A pretty-printed document, elements over several lines."""
    path = work_path(spark, "xml")
    text = '<?xml version="1.0"?>\n<graphml>\n  <key id="d0" for="node" attr.name="title" attr.type="string"/>\n  <key id="d1" for="edge" attr.name="relation" attr.type="string"/>\n  <graph edgedefault="undirected">\n    <node id="book:1">\n      <data key="d0">A</data>\n    </node>\n    <node id="concept:x"/>\n    <edge source="book:1" target="concept:x">\n      <data key="d1">HAS_THEME</data>\n    </edge>\n  </graph>\n</graphml>'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    nodes, e = readers.read_graphml(spark, path)
    assert {(x.node_id, x.title) for x in nodes.collect()} == {("book:1", "A"), ("concept:x", None)}
    assert [tuple(x) for x in e.collect()] == [("book:1", "concept:x", "HAS_THEME")]


def test_spearman_of_constants(spark):
    d = spark.createDataFrame([(1.0, 5.0, None, 1.0), (2.0, 5.0, None, 1.0), (3.0, 5.0, 1.0, 4.0), (3.0, None, 2.0, 9.0)], "a double, b double, c double, d double")
    got = {(x.a, x.b): x.rho for x in enrich.spearman(d, ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"] is None and got["b", "c"] is None and got["a", "c"] is None and abs(got["c", "d"] - 1) < 1e-9
    assert abs(got["a", "d"] - 0.8944271909999159 * 0.9486832980505138 / 0.8944271909999159) < 0.06
    assert enrich.spearman(d.limit(0), ["a", "b"]).first().rho is None and enrich.spearman(d, ["a"]).count() == 0


def test_activation_of_batches(spark):
    """Each query gets its own top rows."""
    a = spark.createDataFrame([(q, f"book:{i}", 10.0 - i - q) for q in (0, 1) for i in range(5)], "query_id int, node_id string, activation double")
    seeds = spark.createDataFrame([(0, "book:0"), (1, "book:4")], "query_id int, node_id string")
    got = sorted((x.query_id, x.isbn13) for x in spreading.activated_books(a, seeds, 3).collect())
    assert got == [(0, "1"), (0, "2"), (0, "3"), (1, "0"), (1, "1"), (1, "2")]


def test_long_paths(spark):
    """No bound on length by default, on a chain, with ties and a bound."""
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("n00", "m01"), ("m01", "n02"), ("x", "y")]
    pairs = spark.createDataFrame([("n00", "n30"), ("n30", "n00"), ("n05", "n09"), ("n00", "x")], "source string, target string")
    got = {(x.source, x.target): x.path for x in paths.shortest_paths(edges(spark, chain), pairs).collect()}
    down = ["n00", "m01", *[f"n{i:02}" for i in range(2, 31)]]
    assert got == {("n00", "n30"): down, ("n30", "n00"): down[::-1], ("n05", "n09"): [f"n{i:02}" for i in range(5, 10)]}
    assert {x.target for x in paths.shortest_paths(edges(spark, chain), pairs, 4).collect()} == {"n09"}
    seeds = spark.createDataFrame([(0, "n02", 0), (0, "n06", 1), (1, "n06", 0)], "query_id int, node_id string, pos int")
    found = paths.explanations(edges(spark, chain), seeds, spark.createDataFrame([(0, "n04"), (1, "n04")], "query_id int, target string"))
    assert {(x.query_id, x.seed) for x in found.collect()} == {(0, "n02"), (1, "n06")}


def test_extraction_outcomes(spark):
    b = spark.createDataFrame([(1, "t", "text"), (2, "t", " "), (3, "bad", "x"), (4, None, "none"), (5, "t", None)], "isbn13 long, title string, description string")
    calls = []

    def client(messages):
        calls.append(messages)
        title = messages[1][1].split("\n")[0]
        if title == "Title: bad":
            raise ValueError("no answer")
        return None if messages[1][1].endswith("none") else {"themes": ["grief"]}

    got = {x.isbn13: (x.outcome, x.attempts, x.error, x.themes) for x in providers.outcomes(b, providers.prompted(lambda config: client)).collect()}
    assert got == {1: ("extracted", 1, None, ["grief"]), 2: ("blank", 0, None, []), 3: ("failed", 3, "ValueError: no answer", []), 4: ("refused", 1, None, []), 5: ("blank", 0, None, [])}
    system, human = providers.prompt("A", "x" * 3000)
    assert "self-discovery" in system[1] and len(human[1]) == len("Title: A\nDescription: ") + 2000
    path = work_path(spark, "cache")
    extend_cache(spark, b, path, lambda t, d: {"themes": ["war"]}, providers.ExtractorConfig(save_every=1))
    assert readers.read_extractions(spark, path).count() == 3
    again = work_path(spark, "json")
    assert readers.read_extraction_json(spark, again).count() == 0
    writers.write_extraction_json(readers.read_extractions(spark, path), again)
    assert sorted(x.isbn13 for x in readers.read_extraction_json(spark, again).collect()) == [1, 3, 4]
    whole = work_path(spark, "json-whole")
    spark.createDataFrame([('{\n  "7": {\n    "isbn13": "7",\n    "themes": ["war"]\n  }\n}',)], "value string").coalesce(1).write.text(whole)
    assert readers.read_extraction_json(spark, whole).first().themes == ["war"]


def test_models(spark):
    """Arrow-batched models instead of the stubs."""
    b = spark.createDataFrame([(1, 0, "Other", "good. bad"), (2, 1, "Other", "bad"), (3, 2, "Fiction", None)], "isbn13 long, src_ord long, categories string, description string")
    score = providers.zero_shot_model(lambda: lambda texts, labels: [[0.9, 0.1] if "good" in t else [0.2, 0.8] for t in texts])
    assert {x.isbn13: x.simple_categories for x in enrich.imputed(b, provider=score).collect()} == {1: "Fiction", 2: "Nonfiction", 3: "Fiction"}
    feel = providers.emotion_model(lambda: lambda texts: [{e: 0.5 + ("good" in t) * 0.25 for e in enrich.EMOTIONS} for t in texts])
    assert {x.isbn13: x.joy for x in enrich.with_emotions(b, model=feel).collect()} == {1: 0.75, 2: 0.5, 3: None}
    embed = providers.embedding_model(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert b.select(embed(F.col("description")).alias("e")).first().e == [9.0, 1.0]


def test_graph_of_many_like_names(spark, monkeypatch, tmp_path):
    """Building a graph embeds each concept once, on several tasks, and compares one name of each vector; its edges are those of brute force over all names."""
    names = [f"{'north' if i % 3 else 'sea'}-{i}" for i in range(300)]
    b = spark.createDataFrame([(i, i, "t", None, "Fiction", 1.0) for i in range(300)], "isbn13 long, src_ord long, title string, authors string, simple_categories string, average_rating double")
    x = spark.createDataFrame([(i, [], [n], [], [], []) for i, n in enumerate(names + names[:5])], readers.EXTRACTION)
    calls, count = str(tmp_path), lambda n: [float(n.count(c)) for c in providers.CHARACTERS]

    def load():
        task = f"{calls}/{uuid.uuid4().hex}"

        def embed(texts):
            with open(task, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz0123456789"] for t in texts]

        return embed

    dealt = []
    monkeypatch.setattr(vector, "_blocked", lambda x, *a, real=vector._blocked: (dealt.append(x.count()), real(x, *a))[1])
    _, edges = pipelines.build_graph(b, x, work_path(spark, "like-names"), providers.embedding_model(load))
    v = np.array([count(n) for n in names])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near, root = v @ v.T >= 0.92 - 1e-12, np.arange(300)
    while ((low := np.where(near, root, 300).min(axis=1)) < root).any():
        root = low
    first = lambda r: min((n for n, y in zip(names, root, strict=True) if y == r), key=lambda n: (-(names + names[:5]).count(n), len(n), n))
    best = {r: first(r) for r in {*root.tolist()}}
    want = {(f"book:{i}", f"location:{best[root[i % 300]]}") for i in range(305)}
    assert {(e.src, e.dst) for e in edges.where("relation = 'SET_IN'").collect()} == want and 1 < len(best) < 300
    parts = [p.read_text().splitlines() for p in tmp_path.iterdir()]
    assert sorted(sum(parts, [])) == sorted(names) and len(parts) > 1
    assert dealt == [len({*map(tuple, map(count, names))})]


def test_emotions_in_bounded_calls(spark):
    """A model gets a bounded number of sentences in a call, and a text's scores are the greatest over all its calls."""
    n = 3 * providers.SENTENCES
    texts = [(0, "." * n + "j"), (1, None), (2, ""), (3, "j" + "." * n), (4, "a.j")]

    def load():
        def score(sentences):
            assert len(sentences) <= n / 3
            return [{e: float("j" in t and e == "joy") for e in enrich.EMOTIONS} for t in sentences]

        return score

    b = enrich.with_emotions(spark.createDataFrame(texts, "isbn13 long, description string").coalesce(1), model=providers.emotion_model(load))
    assert {x.isbn13: (x.joy, x.anger) for x in b.collect()} == {0: (1.0, 0.0), 1: (None, None), 2: (0.0, 0.0), 3: (1.0, 0.0), 4: (1.0, 0.0)}


def test_page_degrades(spark, sf_dir):
    b = enrich.imputed(X.books(spark, sf_dir)).withColumn("large_thumbnail", enrich.large_thumbnail())
    q = X.query_vector(spark, sf_dir)
    path = work_path(spark, "kg")
    assert pipelines.started(spark, b, path).reason.startswith("no knowledge graph")
    pipelines.build_graph(b, X.raw_extractions(X.books(spark, sf_dir)), path)
    engine = pipelines.started(spark, b, path)
    left, right, html = pipelines.handled(engine, q)
    assert left.count() == 16 and right.count() > 0 and "discovered via" in html.first().html
    assert pipelines.handled(engine, q, enabled=False)[2].first().html == pipelines.NOT_ENABLED
    broken = pipelines.Engine(b, (engine.graph[0], engine.graph[1].drop("relation")), None)
    left, right, html = pipelines.handled(broken, q)
    assert left.count() == 16 and right is None and "error" in html.first().html
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}-2/nodes")
    assert "can't be read" in pipelines.started(spark, b, f"{path}-2").reason


def test_shared_folder():
    """A cluster has to name the folder; one machine may do without."""
    named = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: "hdfs://x/y/"), sparkContext=types.SimpleNamespace(master="spark://m"))
    assert session.shared_dir(named) == "hdfs://x/y"
    bare = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: None), sparkContext=types.SimpleNamespace(master="spark://m"))
    with pytest.raises(RuntimeError):
        session.shared_dir(bare)
    bare.sparkContext.master = "local[2]"
    assert session.shared_dir(bare).startswith("file://")


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), r.randrange(50) if r.random() > 0.1 else None, i) for i in range(400)]
    d = spark.createDataFrame(rows, "k string, v int, i int")
    got = {x.i: x.before for x in cumulated(d, [F.col("k"), F.desc("i")], F.coalesce("v", F.lit(0)), "before").collect()}
    total, want = 0, {}
    for _, v, i in sorted(rows, key=lambda x: (x[0], -x[2])):
        want[i] = total
        total += v or 0
    assert got == want
    assert cumulated(d.limit(0), [F.col("k")], F.lit(1), "before").count() == 0


def test_plans(spark, sf_dir):
    """Pushed filters, pruned columns, top-k without a full sort."""
    q = vector.knn(X.books(spark, sf_dir), X.query_vector(spark, sf_dir), 5)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "p_retailprice" not in plan
    assert "WindowGroupLimit" in enrich.evaluation(X.books(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
