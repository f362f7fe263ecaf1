"""Operators of the training-data pipeline against brute force, on nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import os
import random
import re
import types
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stacklight.llm import common, decontaminate, html, jaccard, lm, mixing, quality_model, queries, rules, substring, tokens, warc
from stacklight.llm.common import Texts, gram_hashes, valid_starts
from stacklight.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __w string, score double"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").encode())


def fixture_rows():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "naïve.", "The", " x"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage, rows = make(120), make(70), []
    for i in range(24):
        kind = i % 8
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split()
            for _ in range(1 + i // 8):
                w[r.randrange(len(w))] = "edit"
            t = " ".join(w)
        elif kind == 2:
            t = make(30) + "\n" + passage + " " + make(20)
        elif kind == 3:
            t = passage[: 300 + i] + " " + make(60)
        elif kind == 4:
            t = [None, "", " \t\n"][i // 8]
        elif kind == 5:
            t = ["one", "one two", "one two three four"][i // 8]
        elif kind == 6:
            t = "spam " * (60 + i)
        else:
            t = make(1500)
        rows.append((i, t, "en", [None, "a", "b", "c"][i % 4], 0, "clash", 1.0))
    rows += [rows[0], rows[2], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_hashes():
    texts = ["a b  c\n", None, "", "x", "a b c", " lead", "tail\x0b", "é \x1c ü"]
    t = Texts(pa.array(texts))
    want = [words(x) for x in texts]
    assert [t.word(i) for i in range(len(t.starts))] == [w for x in want for w in x]
    seen = {}
    for i, h in enumerate(t.hashes.tolist()):
        assert seen.setdefault(t.word(i), h) == h
    assert len(set(seen.values())) == len(seen)
    h = np.arange(80, dtype=np.uint64) * np.uint64(77)
    for k in (1, 2, 3, 5, 16, 50):
        assert (gram_hashes(h, k)[9:] == gram_hashes(h[9:], k)).all()
    assert valid_starts(np.asarray([0, 3, 3, 5]), 2, 4).tolist() == [True, True, False, True]


def test_warc(spark):
    rows = [(1, "u", "a"), (2, None, "a"), (3, "v\nx", "b"), (None, "w", "a"), (4, "u", None), (5, "u", ""), (2, None, "a"), (6, "l", "x" * 300_000), (7, "m", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = warc.write_warc(pages, roll_bytes=400)
    got = warc.read_warc(spark, path).collect()
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), i if i is not None else -1)
    want = sorted(((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if largest[h or ""] == i else "revisit", None if largest[h or ""] == i else largest[h or ""]) for i, _, h in rows), key=str)
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=str) == want
    assert all(x.payload.decode() == next((h or "") for i, _, h in rows if i == x.page_id) for x in got if x.record_type == "response")
    again = warc.write_warc(pages.repartition(5), roll_bytes=400)
    files = lambda p: sorted(map(tuple, spark.read.parquet(f"{p}/manifest").collect()))
    assert files(path) == files(again) and len(files(path)) > 3
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted((tuple(x) for x in tokens.token_digests(spark, tokens.write_tokens(docs, queries.tokenizer_path())).collect()), key=lambda x: x[1])
    assert [x[0] for x in got] == sorted([r[0] for r in fixture_rows()], key=lambda i: (i is not None, i))
    want, start = collections.Counter(), 0
    for i, text, *_ in fixture_rows():
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((a, n, c) for a, _, n, c in got) == want
    for _, s, n, _ in got:
        assert s == start
        start += n
    assert tokens.token_digests(spark, tokens.write_tokens(empty, queries.tokenizer_path())).count() == 0
    e = tokens.Encoder(queries.tokenizer_path())
    for s in ("É. don't. DON'T, a.b. <|endoftext|>. <|ENDOFTEXT|> 12. ... .,", "́a b́. \x1ce.\x85f", "ΑΣ. σς, \U0001f600. 中文."):
        assert np.frombuffer(e.encode([s.encode()])[0], "<u4").tolist() == t.encode(s, add_special_tokens=False).ids
    hard = ["It's...", "é.", "é\u0301!", "a÷.", "x.'", "a<|endoftext|>.", "A<|ENDOFTEXT|>!", "ÀÉ...", "a\x01.", "a\x1c.", "1.", "ﬁ.", "ÿ?", "'s.", "İx.", "a….", "##a##", "", " \t", "a,b.!"]
    ids, ends = e.encode_column(pa.array(["x", *hard])[1:])
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [t.encode(s, add_special_tokens=False).ids for s in hard]


def test_token_files(spark, docs):
    """What the files are: dictionaries, bounded row groups, page indexes, and readers that take metadata or a key range alone."""
    from pyarrow import parquet
    from tokenizers import Tokenizer

    path = tokens.write_tokens(docs, queries.tokenizer_path())
    folder = path.removeprefix("file://")
    files = [f"{folder}/{x}" for x in os.listdir(folder) if x.endswith(".parquet")]
    for f in files:
        meta = parquet.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size <= tokens.ROW_GROUP_BYTES * 1.1
            columns = {meta.row_group(g).column(k).path_in_schema.split(".")[0]: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            assert columns["ids"].has_dictionary_page and any("DICTIONARY" in e for e in columns["ids"].encodings)
            assert columns["doc_id"].has_column_index and columns["ids"].has_offset_index
    meta = tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens")
    plan = meta._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    some = tokens.read_tokens(spark, path, 3, 5)
    assert "GreaterThanOrEqual(doc_id,3)" in some._jdf.queryExecution().executedPlan().toString()
    whole = {(x.doc_id, x.start): x.ids for x in tokens.read_tokens(spark, path).collect()}
    assert {(x.doc_id, x.start): x.ids for x in some.collect()} == {k: v for k, v in whole.items() if k[0] in (3, 4, 5)}
    other = tokens.Encoder(queries.tokenizer_path("byte_bpe_50k.json"))  # neither lower case nor split at white space
    library, texts = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), ["It's  A\n test. ", "", "ÀÉ... x", " y"]
    ids, ends = other.encode_column(pa.array(texts))
    assert not other.wordwise and tokens.encoder(queries.tokenizer_path()).wordwise
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_warc_task_that_fails(spark, tmp_path, monkeypatch):
    """A task that dies half way leaves no finished file behind, and its next attempt the same bytes as an undisturbed one."""
    rows = [pa.RecordBatch.from_pylist([{"page_id": i, "kind": 1, "digest": None, "refers_to": None, "url": "u", "html": bytes([65 + i]) * 500} for i in range(k, k + 3)], pa.schema([("page_id", pa.int64()), ("kind", pa.int32()), ("digest", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.binary())])) for k in (0, 3)]
    monkeypatch.setattr(warc.TaskContext, "get", classmethod(lambda cls: types.SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 7)))

    def broken():
        yield rows[0]
        raise OSError("lost")

    with pytest.raises(OSError):
        list(warc._writer(str(tmp_path / "a"), 10**6)(broken()))
    assert os.listdir(tmp_path / "a") == []
    first = [x for b in warc._writer(str(tmp_path / "a"), 10**6)(iter(rows)) for x in b.to_pylist()]
    again = [x for b in warc._writer(str(tmp_path / "b"), 10**6)(iter(rows)) for x in b.to_pylist()]
    assert first == again and sum(x["records"] for x in first) == 6 and os.listdir(tmp_path / "a") == [x["file"] for x in first]


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_jaccard(rows):
    """(doc_id, class_id, n_links) of each row of (doc_id, text)."""
    sets, parent, links = [shingle_set(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(sets):
        for m in range(n + 1, len(rows)):
            if a and len(a & sets[m]) >= 0.8 * len(a | sets[m]):
                links[n] += 1
                links[m] += 1
                parent[root(m)] = root(n)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root(n)] = min(least.get(root(n), math.inf), math.inf if i is None else i)
    return [(i, None if least[root(n)] == math.inf else least[root(n)], links[n]) for n, (i, _) in enumerate(rows)]


def test_jaccard(docs, empty):
    rows = [(i, t) for i, t, *_ in fixture_rows()]
    want = brute_jaccard(rows)
    assert collections.Counter((x.doc_id, x.class_id, x.n_links) for x in jaccard.near_duplicates(docs).collect()) == collections.Counter(want)
    assert jaccard.near_duplicates(empty).count() == 0
    kept = collections.Counter(x.doc_id for x in jaccard.deduplicated(docs).collect())
    wordless = collections.Counter(i for i, t in rows if not words(t))
    assert kept == collections.Counter({c for (i, c, _), (_, t) in zip(want, rows, strict=True) if words(t)}) + wordless
    assert jaccard.deduplicated(docs).columns == docs.columns and jaccard.deduplicated(empty).count() == 0


def test_jaccard_of_repeated_keys(spark):
    """Rows that share a key but not the text are in classes of their own; null keys and repeated rows leave one row of a class."""
    r = random.Random(6)
    a, b, c = ([f"{x}{r.randrange(9**9)}" for _ in range(90)] for x in "abc")
    rows = [(5, a), (5, b), (6, [*a, "x"]), (7, [*b, "y"]), (None, [*b, "z"]), (None, c), (None, [*c, "v"]), (8, a), (8, a), (4, c[:40]), (4, c[:40])]
    rows = [(i, " ".join(w)) for i, w in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_jaccard(rows)
    assert collections.Counter((x.doc_id, x.class_id, x.n_links) for x in jaccard.near_duplicates(d).collect()) == collections.Counter(want)
    kept = sorted((x.doc_id or 0, x.text[0]) for x in jaccard.deduplicated(d).collect())
    assert kept == [(0, "c"), (4, "c"), (5, "a"), (5, "b")]


def test_jaccard_boilerplate(spark, monkeypatch):
    """Many texts that share boilerplate but little else share bands; they end before any set of shingles moves, and near copies among them don't."""
    r = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    own = lambda i: [f"o{i}_{j}" for j in range(90)]
    rows = [(i, " ".join(shared + own(i))) for i in range(400)] + [(1000 + i, " ".join(shared + own(i)[:-1])) for i in range(0, 400, 40)]
    r.shuffle(rows)
    seen = []
    plain = jaccard.candidate_groups
    monkeypatch.setattr(jaccard, "candidate_groups", lambda *x: seen.append(plain(*x)) or seen[-1])
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 16)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_id, x.class_id, x.n_links) for x in jaccard.near_duplicates(d).collect()} == set(brute_jaccard(rows))
    assert seen[0].count() == 20
    t = Texts(pa.array([x for _, x in rows]))
    crowd = collections.Counter(jaccard.bands(jaccard.signatures(*jaccard.shingles(t))).reshape(-1).tolist())
    assert max(crowd.values()) > 16  # a bucket of several blocks


def test_jaccard_blocks(spark, monkeypatch):
    """A group of near copies over many blocks: all links, none twice."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(80)] = f"e{r.randrange(9)}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t) for t in texts]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 9)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    assert [x.n_links for x in jaccard.near_duplicates(d).orderBy("doc_id").collect()] == want


def test_decontamination(spark, docs, empty):
    r = random.Random(9)
    items = [[f"b{r.randrange(300)}" for _ in range(n)] for n in (15, 40, 2, 30)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    edited = list(items[1])
    for p in (5, 11, 19, 30):
        edited[p] = "other"
    del edited[25]
    half = items[3][:10] + ["q"] * 30
    fill = lambda n: [f"f{r.randrange(500)}" for _ in range(n)]
    texts = [fill(50) + items[0] + fill(20), fill(10) + edited + fill(900), fill(400), half, items[2], items[1] * 2]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(7, None), (8, "")], "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(d, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (4, 2), (5, 1)}
    assert got[0, 0].matched == 15 and got[0, 0].end_word == 65 and got[1, 1].matched < 40

    def align(a, b):
        best, above = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(0, above[j] + (1 if x == y else -1), above[j + 1] - 1, row[j] - 1))
            best, above = max(best, *row), row
        return best

    for (i, j), x in got.items():
        assert x.matched == align(items[j], texts[i])
    small = {(x.doc_id, x.item_id) for x in decontaminate.leaks(d, bench, block_words=20).collect()}
    assert small == set(got)
    assert sorted(x.doc_id for x in decontaminate.clean(d, bench).collect()) == [2, 3, 7, 8]
    assert decontaminate.leaks(docs, bench).count() == 0 == decontaminate.leaks(empty, bench).count()
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_of_common_halves(spark):
    """An item of a common and a rare half: all alignments of either half are found, however many documents hold the common one; null and repeated keys are judged by their texts."""
    r = random.Random(3)
    item = [f"c{i}" for i in range(12)] + [f"r{i}" for i in range(12)]
    fill = lambda: [f"f{r.randrange(10**6)}" for _ in range(30)]
    for n in (90, 150):
        rows = [(i, fill() + item[:12] + fill()) for i in range(n)] + [(n, fill() + item[12:] + fill()), (None, item), (7, fill()), (n + 1, fill())]
        d = spark.createDataFrame([(i, "\n".join(w)) for i, w in rows], "doc_id long, text string")
        bench = spark.createDataFrame([(5, "\t".join(item))], "item_id long, text string")
        assert sorted((x.doc_id if x.doc_id is not None else -1, x.matched) for x in decontaminate.leaks(d, bench).collect()) == [(-1, 24), *[(i, 12) for i in range(n + 1)]]
        assert sorted(x.doc_id for x in decontaminate.clean(d, bench).collect()) == [7, n + 1]


def test_decontamination_recall(spark, sf_dir):
    """Against alignment of all documents with all items of the small table: the seeds lose nothing."""
    docs, bench = (table(spark, sf_dir, t).collect() for t in ("documents", "benchmark"))
    d, b = (decontaminate.Folded(pa.array([x.text for x in rows])) for rows in (docs, bench))
    want = set()
    for j in range(b.n):
        item = b.hashes[b.bounds[j] : b.bounds[j + 1]]
        if not len(item):
            continue
        common = np.isin(d.hashes, item)
        for i in np.flatnonzero(np.add.reduceat(np.append(common, False), np.minimum(d.bounds[:-1], len(common))) * (d.counts > 0) >= 0.5 * len(item)):  # no score is above it
            text = d.hashes[d.bounds[i] : d.bounds[i + 1]]
            score = int(decontaminate.local_score(item, text[None, :], np.asarray([len(text)]))[0][0])
            if score >= 0.5 * len(item):
                want.add((docs[i].doc_id, bench[j].item_id, score))
    got = {(x.doc_id, x.item_id, x.matched) for x in decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).collect()}
    assert got == want and want


def test_decontamination_of_common_copies(spark, monkeypatch):
    """Edited copies keep under half of their seeds and stand in many documents, beside unlike documents with one common seed: each copy is found, in portions also."""
    r = random.Random(3)
    items = [[f"b{i}_{j}" for j in range(n)] for i, n in enumerate((40, 15))]
    edited = [["other" if j in at else w for j, w in enumerate(x)] for x, at in zip(items, (range(3, 36, 4), (3, 7, 11)), strict=True)]
    edited[0][35] = items[0][35]
    fill = lambda n: [f"f{r.randrange(500)}" for _ in range(n)]
    texts = [fill(20) + edited[i % 2] + fill(r.randrange(30)) for i in range(300)] + [fill(30) + items[0][:3] + fill(60) for _ in range(150)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    score = {0: 40 - 2 * 8, 1: 15 - 2 * 3}
    want = {(i, i % 2, score[i % 2]) for i in range(300)}
    assert {(x.doc_id, x.item_id, x.matched) for x in decontaminate.leaks(d, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "HITS", 10)
    index = decontaminate.Index([" ".join(w) for w in items], [0, 1], 3)
    index.rare[:] = False
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "fp": list(range(len(texts))), "text": [" ".join(w) for w in texts]})
    made = [x for b in decontaminate._aligned(types.SimpleNamespace(value=index), 0.5)(iter([batch])) for x in b.to_pylist()]
    assert {(x["doc_id"], x["item_id"], x["matched"]) for x in made} == want


def test_decontamination_folds(spark):
    """Copies in capitals or with other marks at word ends count as the passage; positions count all words."""
    item = "Él dijo: «la Straße ñandú está aquí», (y) don't stop -- C3 = x ¿qué? 世界。"
    n = len(item.split())
    bare = "él dijo la straße ñandú está aquí y don't stop -- c3 = x qué 世界"
    again = "“Él”, dijo... *la* Straße; ñandú! está_ aquí... [y] ‘don't’ ’stop’ -- #C3 = x, qué! “世界”"
    texts = ["a b " + item.upper() + " z", bare, again, "-- == !! ?? -- == !! ??", item.replace("dijo", "dice").upper()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, "-- == !! ??")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.matched, x.end_word) for x in decontaminate.leaks(d, bench).collect()}
    assert got == {(0, 0): (n, n + 2), (1, 0): (n, n), (2, 0): (n, n), (3, 1): (4, 4), (4, 0): (n - 2, n)}
    t = decontaminate.Folded(pa.array([b"\xffabc, (\xc3", None, b"(ABC) --", b"-"], pa.binary()))
    plain = decontaminate.Folded(pa.array(["abc", "--", "-"])).hashes
    assert t.bounds.tolist() == [0, 2, 2, 4, 5] and t.hashes[2:].tolist() == plain.tolist()


def brute_model(train, order):
    """Interpolated modified Kneser-Ney by dictionaries: p(words before, word)."""
    counts = collections.defaultdict(collections.Counter)  # by order
    for ws in train:
        line = ["<s>", *ws, "</s>"]
        for j in range(1, len(line)):
            gram = tuple(line[max(0, j - order + 1) : j + 1])
            counts[len(gram)][gram] += 1  # the longest at its place: of full length, or from the begin on
    for k in range(order, 1, -1):
        for gram in list(counts[k]):
            counts[k - 1][gram[1:]] += 1
    of = lambda c: [sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]
    ds = {k: lm.discounts(of(counts[k])) for k in range(1, order + 1)}
    cut = lambda n, d: max(0.0, n - (0, *d)[min(n, 3)])
    follow, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for k in range(2, order + 1):
        for gram, n in counts[k].items():
            follow[gram[:-1]] += n
            kinds[gram[:-1]][min(n, 3) - 1] += 1
    types, size = len(counts[2]), len({w for ws in train for w in ws}) + 1
    low = counts[1].values()
    gamma = (ds[1][0] * sum(n == 1 for n in low) + ds[1][1] * sum(n == 2 for n in low) + ds[1][2] * sum(n >= 3 for n in low)) / types

    def prob(before, w):
        p = cut(counts[1][w,], ds[1]) / types + gamma / (size + 1)
        for k in range(2, min(order, len(before) + 1) + 1):
            u = tuple(before[len(before) - k + 1 :])
            if follow[u]:
                p = (cut(counts[k][(*u, w)], ds[k]) + sum(a * b for a, b in zip(ds[k], kinds[u], strict=True)) * p) / follow[u]
        return p

    return prob


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, docs, monkeypatch, order):
    monkeypatch.setattr(lm, "TOKENS_A_PART", 2000)
    monkeypatch.setattr(lm, "WORDS_A_PART", 50)
    monkeypatch.setattr(lm, "BUCKET", 8)
    if order == 4:
        monkeypatch.setattr(lm, "COARSE", 3)
    got = collections.Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in lm.train_and_score(docs, order).collect())
    rows = [(i, [w.lower() for w in words(t)]) for i, t, *_ in fixture_rows()]
    held = lambda i: zlib.crc32(b"null" if i is None else str(i).encode()) % 7 == 2
    train = [w for i, w in rows if not held(i)]
    c = collections.Counter(w for ws in train for w in ws)
    c["end"] = len(train)
    total, size, prob = sum(c.values()), len(c), brute_model(train, order)
    want = collections.Counter()
    for i, ws in rows:
        out, line = [*ws, "end"], ["<s>", *ws]
        score = sum(math.log10(prob(line[: j + 1], w)) for j, w in enumerate([*ws, "</s>"]))
        want[i, held(i), len(out), sum(c[w] > 0 for w in out), total, round(sum(math.log10((c[w] + 1) / (total + size + 1)) for w in out), 6), round(score, 6)] += 1
    assert got == want
    # for any context, known words and one unknown sum to 1
    known = [*(w for w in c if w != "end"), "</s>", "unseen"]
    for line in (["<s>"], ["<s>", train[0][0]], ["<s>", *train[0][:5]]):
        assert abs(sum(prob(line, w) for w in known) - 1) < 1e-6
    nothing = lm.train_and_score(docs.where("doc_id = 0").withColumn("doc_id", F.lit(next(i for i in range(99) if held(i))).cast("long")), order).first()
    assert nothing.n_known == 0 and math.isfinite(nothing.score)


def test_arrays_of_a_store(tmp_path, monkeypatch):
    """Files of a store that isn't mounted: written under temporary names, read by mapped copies."""
    from pyarrow import fs

    (tmp_path / "bucket").mkdir()
    monkeypatch.setattr(lm, "filesystem", lambda path: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), path.removeprefix("store://")))
    monkeypatch.setattr(lm.TaskContext, "get", classmethod(lambda cls: types.SimpleNamespace(taskAttemptId=lambda: 3)))
    arrays = {"a": np.arange(10, dtype=np.uint32), "b": np.zeros((0, 4), np.int64), "c": np.arange(6).reshape(3, 2)}
    lm.saved("store://bucket/x", "part", arrays)
    assert sorted(os.listdir(tmp_path / "bucket" / "x")) == ["part.a.npy", "part.b.npy", "part.c.npy"]
    for k, a in arrays.items():
        got = lm.loaded("store://bucket/x", "part", k)
        assert got.dtype == a.dtype and got.tolist() == a.tolist()


def test_language_model_arrays():
    """Large values, many ids and blobs, and words with ids beyond 32 bits."""
    r = np.random.Generator(np.random.PCG64(3))
    columns = [r.integers(0, 1 << b, 5000) for b in (3, 40, 9)]
    counts = r.integers(1, 1 << 40, 5000)
    rows = lambda c, n: collections.Counter(zip(*[x.tolist() for x in c], n.tolist(), strict=True))
    assert rows(*lm.unpacked(lm.packed(columns, counts))) == rows(columns, counts)
    one = lm.distinct([np.concatenate([c, c]) for c in columns], np.concatenate([counts, counts]))
    again = lm.distinct(columns, counts)
    assert rows(*one) == rows(again[0], 2 * again[1])
    small = lm.coded([np.asarray([1, 15, 16, 3]), np.asarray([1, 2, 3, 15]), np.asarray([0, 7, 1, 1]), np.asarray([0, 7, 0, 9])])
    assert small["over"].tolist() == [2, 3] and small["large"].tolist() == [[16, 3, 1, 0], [3, 15, 1, 9]]


def test_html(spark):
    shell = lambda body, n: f"<html><head><title>t{n}</title><style>p{{}}</style><script>var a='</p>'</script></head><body><nav><ul><li><a href='/'>Home{n}</a></ul></nav><!-- x --><div class='cookie-notice'>We use cookies</div>{body}<aside>side</aside><section id=comments><p>first!</section><form><label>Mail<input></form><footer>&copy; site</footer></body></html>"
    article = "<article><h1>A &amp; B</h1><p><b>one<br>two<p>fo<i>ur</i>&nbsp;\n five<div class='share'>Share</div></article>"
    pages = [(1, "http://a/1", shell(article, 1)), (2, "http://a/2", shell(article.replace("one", "uno"), 2)), (3, "http://b/1", None), (4, None, ""), (5, "http://c/", "plain <b>text"), (6, "http://d/1", "<body><div>Top story</div><p>x1 y</p></body>"), (7, "http://d/2", "<body><div>Top story</div><p>x2 y</p></body>"), (8, "http://e/", "<p>same</p>"), (9, "http://e/2", "<p>same</p>"), (9, "http://e/2", "<p>same</p>"), (10, "http://f/", "<article><p title=\"a>open <b class='x>quote</b></article>")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = collections.Counter((x.page_id, x.text, x.n_chars) for x in html.main_texts(d).collect())
    text = {1: "A & B one two four five", 2: "A & B uno two four five", 3: "", 4: "", 5: "plain text", 6: "x1 y", 7: "x2 y", 8: "same", 9: "same", 10: "open quote"}
    assert got == collections.Counter((i, text[i], len(text[i])) for i, *_ in pages)
    assert html.main_texts(d.limit(0)).count() == 0


def test_html_mixed_host(spark):
    """Null, empty and foreign pages, and one that repeats a text, leave the template of a host as it is; texts that come twice belong to it."""
    page = lambda i, menu="<div>Site menu</div>": f"<body>{menu}<p>x{i} <b>and</b> y{i}{' <b>and</b> z' * (i % 3)}</p><div>More</div><p>end{i}</p><div>More</div></body>"
    pages = [page(i) for i in range(11)] + [page(11, "<div>Site menu</div>" * 2), None, "", " ", "<p>odd one</p>"]
    d = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    want = {i: f"x{i} and y{i}{' and z' * (i % 3)} end{i}" for i in range(12)} | {12: "", 13: "", 14: "", 15: "odd one"}
    assert {x.page_id: x.text for x in html.main_texts(d).collect()} == want


def test_html_template(spark):
    """Classes against whole occurrence vectors; slots of a host without an article element, menus without a role, template text inside the article, roles that hold the text."""
    menu = lambda i: "<ul>" + "".join(f"<li><a href='{i}-{j}'>link {i} {j}</a></li>" for j in range(2 + i % 3)) + "</ul>"
    comments = lambda i: "".join(f"<div class='comment'><b>r{i}{j}</b></div>" for j in range(i % 3))
    pages = []
    for i in range(12):  # no article: the deepest container with most of the text
        pages.append(("plain", f"<body><div id='top'>Site of ours</div>{menu(i)}<div class='c{i % 2}'><div id='post-{i}' class='form'><p>story {i} {'word ' * 40}</p>{comments(i)}<p>Call us now</p><div>Buy our book</div></div></div><div id='low'>Imprint {i}</div></body>"))
    for i in range(8):  # with an article: a slogan and a menu of its own inside
        pages.append(("news", f"<body><nav>Home {i}</nav><article><h1>T{i}</h1><p>text {i}</p><p>as always</p><div><p>Share this</p></div>{menu(i)}<div class='related'>{'own part of the article ' * 9}{i}</div></article><aside>x</aside></body>"))
    pages += [("news", None), ("news", "<h1>404</h1>"), ("news", "<article>alone"), ("plain", "<body><p>gone</p></body>"), ("one", "<body><p>only 'page\" here</p></body>")]
    d = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html.main_texts(d).collect()}
    for i in range(12):
        assert got[i] == f"story {i} {'word ' * 40}".strip()
    for i in range(8):
        assert got[12 + i] == f"T{i} text {i} as always {'own part of the article ' * 9}{i}"
    assert [got[20 + k] for k in range(5)] == ["", "404", "alone", "gone", "only 'page\" here"]
    marked = d.select(html.host_of().alias("host"), F.xxhash64("page_id").alias("mark"), "html")
    made = {x.host: x for x in html.templates(marked).collect()}
    for host in ("plain", "news"):
        counts = [c for h, p in pages if h == host and (c := html.counted(p or ""))]
        vectors = collections.defaultdict(set)
        for key in {k for c in counts for k in c if k[0] not in ("=", "@", "")}:
            v = tuple(c.get(key, 0) for c in counts)
            if sum(map(bool, v)) >= html.SUPPORT * len(counts):
                vectors[v, key[1].startswith("#")].add(key)
        root = {t for (v, text), keys in vectors.items() if not text and max(v) == 1 and sum(v) >= html.SHARE * len(counts) for t, _ in keys}
        texts = {t for (v, text), keys in vectors.items() if text and sum(map(bool, v)) >= html.SHARE * len(counts) for t, _ in keys}
        assert made[host].n_pages == len(counts) and set(made[host].root) == root and {x.token for x in made[host].texts} == texts
        nested = {(min(p for _, p in keys), frozenset(t for t, _ in keys)) for (v, text), keys in vectors.items() if not text and sum(v) > sum(map(bool, v)) and len(keys) > 1 and all(html.below(p, min(q for _, q in keys)) for _, p in keys)}
        assert {(x.container, frozenset(x.tokens)) for x in made[host].nested} == nested and nested


def brute_rules(t):
    w = [x.decode() for x in words(t)]
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)


def brute_failed(t):
    """The names of all rules that reject the text."""
    n, chars, symbols, dup, again = brute_rules(t)
    t = t or ""
    lines = [x for x in t.split("\n")]
    letters, capitals = sum(c.isalpha() and unicodedata.category(c)[0] == "L" for c in t), sum(unicodedata.category(c) == "Lu" for c in t)
    full = [x for x in lines if words(x)]
    checks = {
        "too_few_words": n < 50, "repeated_words": 100 * again > 50 * n, "word_length": chars < 2 * n or chars > 15 * n, "symbols": 10 * symbols > n, "repeated_lines": dup >= 3 and 20 * dup > n,
        "shouting": 5 * t.count("!") > n, "few_letters": 2 * letters < chars, "capitals": 2 * capitals > letters, "digits": 5 * sum(c in "0123456789" for c in t) > chars,
        "long_word": max([len(x.decode()) for x in words(t)], default=0) > 1000, "bullets": 10 * sum(bool(re.match("[ \t]*[-*\u2022]", x)) for x in lines) > 9 * len(full), "ellipses": 10 * sum(bool(re.search("([.][.][.]|\u2026)[ \t\r]*$", x)) for x in lines) > 3 * len(full),
    }
    return {k for k, v in checks.items() if v}


def test_rules(spark, docs, empty):
    r = random.Random(1)
    fill = lambda n: " ".join(f"w{chr(97 + r.randrange(26)) * 3}{r.randrange(9)}" for _ in range(n))
    odd = ["a b c a b c a b", "x\nx\n \ny # | <>", "é é é\x1cb", fill(60).upper(), fill(60) + " " + "x" * 1200, "\n".join("- " + fill(9) for _ in range(9)), "\n".join(fill(9) + "... " for _ in range(9)), " ".join(str(i) for i in range(999)), "ß! " * 70, fill(80).replace("w", "=="), "\n".join(["same line of words"] * 9 + [fill(30)] * 2), fill(70)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(90 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    order = rules.estimated_order(d)
    assert {x["rule"] for x in order} == set(rules.RULES) and all(x["cost"] > 0 for x in order)
    seen = set()
    for a in (order, order[::-1]):  # the order changes no verdict
        for x in rules.judged(d, a).collect():
            failed = brute_failed(x.text)
            assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_rules(x.text)
            assert (x.failed_rule is None) == (not failed) and (x.failed_rule is None or x.failed_rule in failed)
            assert not failed & {"too_few_words", "repeated_words"} or x.failed_rule in ("too_few_words", "repeated_words")
            seen |= failed
    assert seen == {x.name for x in rules.BASE + rules.RULES}
    want = collections.Counter(i for i, t, *_ in fixture_rows() if not brute_failed(t))
    kept = rules.filtered(docs)
    assert kept.columns == docs.columns and collections.Counter(x.doc_id for x in kept.collect()) == want
    assert rules.filtered(empty).count() == 0 and rules.judged(empty, rules.estimated_order(empty)).count() == 0


def test_rules_of_hash_neighbours(spark):
    """Windows with equal heads of their hashes don't hide each other: the whole hashes are compared, whatever lies between in their order."""
    r = random.Random(12)
    w = [f"n{r.randrange(60)}" for _ in range(4000)]
    texts = [" ".join(w), " ".join(["a b c"] * 2 + [f"u{i}" for i in range(70_000)] + ["a b c"])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in rules.judged(d, []).collect():
        assert x.n_repeat_words == brute_rules(x.text)[4]


def test_rule_order_is_conditional(monkeypatch):
    """A rule whose rejections an earlier one has taken comes after one that rejects anew."""
    a, b, c = rules.Rule("a", "{n_words} < 9"), rules.Rule("b", "{n_words} < 8"), rules.Rule("c", "{n_marks} > 9")
    monkeypatch.setattr(rules, "measured", lambda *x: ([[True] * 5 + [False] * 5, [True] * 4 + [False] * 6, [False] * 9 + [True]], [1e-6, 1e-6, 2e-6]))
    assert [x["rule"].name for x in rules.estimated_order(None, (b, c, a))] != ["b", "c", "a"]
    monkeypatch.setattr(rules, "measured", lambda *x: ([[True] * 4 + [False] * 6, [False] * 9 + [True], [True] * 5 + [False] * 5], [1e-6, 2e-6, 1e-6]))
    assert [x["rule"].name for x in rules.estimated_order(None, (b, c, a))] == ["a", "c", "b"]


def test_mixing(spark, docs, empty):
    got = mixing.mixed(docs).collect()
    size = lambda t: len(words(t))
    source = collections.Counter()
    for _, t, _, s, *_ in fixture_rows():
        source[s] += size(t)
    order = sorted((s for s in source if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(order, (5, 2, 1, 5), strict=True))
    target, rest, left = {}, 1.5 * sum(source.values()), set(order)
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if share[s] > 2 * source[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * source[s] for s in full}
        rest -= sum(2 * source[s] for s in full)
        left -= full
    by_key = {i: (s, size(t)) for i, t, _, s, *_ in fixture_rows()}
    taken = collections.Counter()
    for x in got:
        if x.doc_id is not None:
            s, n = by_key[x.doc_id]
            assert (x.size, x.source_size) == (n, source[s]) and abs(x.target - target[s]) < 1e-6
        assert 0 <= x.taken <= 2 * x.size
        taken[next(s for s in order if abs(target[s] - x.target) < 1e-6)] += x.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mixed(empty).count() == 0 and mixing.mixed_rows(docs).columns == docs.columns


def test_mixing_repeats(spark):
    """A document that is repeated is as many rows; equal rows of the mix are as many, whatever their partitions, and columns stay with their rows."""
    rows = [(1, "a b c " * 40, "x", "en")] * 50 + [(1, "a b c " * 40, "x", "fr")] * 3 + [(2, "d " * 70, "x", None), (None, "e", None, "en"), (None, "e", None, "en"), (3, None, "y", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, __row string")
    got = mixing.mixed(d.repartition(4)).collect()
    assert collections.Counter((x.doc_id, x.size) for x in got) == collections.Counter((i, len(words(t))) for i, t, *_ in rows)
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    made = [collections.Counter(map(tuple, mixing.mixed_rows(d.repartition(n)).collect())) for n in (1, 6)]
    assert made[0] == made[1] and set(made[0]) <= set(rows)
    assert all(n <= 2 * rows.count(x) for x, n in made[0].items()) and sum(made[0].values()) > len(rows)


def brute_taken(a, blocks, source_size, seats, shards, first):
    """Words taken of the first a words of a stream, block by block."""
    left = {}
    for j in range(shards):
        p, q = j * blocks // shards, (j + 1) * blocks // shards
        quota = seats * q // blocks - seats * p // blocks
        for k in range(p, q):
            left[k] = quota // (q - p) + ((k - p - first[j] % (q - p)) % (q - p) < quota % (q - p))
    return sum(n * max(0, min(a, 64 * k + 64, source_size) - 64 * k) for k, n in left.items())


def test_words_taken(spark):
    """The closed form against blocks one by one, over many shards."""
    r = random.Random(7)
    cases = []
    for o in range(1, 30):
        size = r.randrange(1, 3000)
        blocks = -(-size // 64)
        cases.append((o, blocks, size, r.randrange(0, 2 * blocks + 1), r.randrange(1, min(blocks, 7) + 1), r.randrange(0, size + 1)))
    cases += [(o, b, s, e, h, s) for o, b, s, e, h, _ in cases]
    d = spark.createDataFrame(cases, "ord long, blocks long, source_size long, seats long, shards long, a long")
    first = lambda o, j: int(hashlib.md5(f"20|shard|{o}|{j}".encode()).hexdigest()[:12], 16)
    for x in mixing.words_taken(d, "a", "t").collect():
        assert x.t == brute_taken(x.a, x.blocks, x.source_size, x.seats, x.shards, [first(x.ord, j) for j in range(x.shards)])


def test_apportionment_is_highest_quotients(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 20)
    r = random.Random(4)
    t = [(f"s{i:02}", i + 1, 1, 10**9, 1, float(r.randrange(1, 100_000))) for i in range(15)] + [(f"t{i}", 20 + i, 1, 70, 1, 140.0) for i in range(40)]
    d = spark.createDataFrame(t, "source string, ord long, n_docs long, source_size long, weight int, target double")
    got = {x.source: x.seats for x in mixing.apportioned(d).collect()}
    seats = dict.fromkeys(got, 0)
    for _ in range(round(sum(x[5] for x in t) / mixing.BLOCK_WORDS)):
        best = max((x for x in t if seats[x[0]] < 2 * -(-x[3] // 64)), key=lambda x: (x[5] / (2 * seats[x[0]] + 1), -x[1]))[0]
        seats[best] += 1
    assert got == seats


def test_many_sources(spark):
    """100,000 sources: ranks and quotas are sums, not windows over all."""
    d = spark.range(100_000).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("source"), F.lit(1).cast("long").alias("n_docs"), (F.col("id") % 997 * 10).alias("source_size"))
    t = mixing.source_targets(d)
    x = mixing.apportioned(t).agg(F.sum("seats").alias("seats"), F.sum("target").alias("target"), F.max("ord").alias("ord"), F.count_if(F.col("target") > 2 * F.col("source_size")).alias("above")).first()
    assert x.seats == round(x.target / 64) and x.ord == 100_000 and x.above == 0
    assert abs(x.target / d.agg(F.sum("source_size")).first()[0] - 1.5) < 1e-9


def test_substring(docs, empty):
    rows = [(i, words(t)) for i, t, *_ in fixture_rows()]
    first = {}
    for i, w in rows:
        if i is not None:
            for p in range(len(w) - 49):
                g = tuple(w[p : p + 50])
                first[g] = min(first.get(g, i), i)
    want = collections.Counter()
    for i, w in rows:
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()] += 1
    assert collections.Counter(map(tuple, substring.without_repeats(docs).collect())) == want
    assert any(x[2] for x in want)
    assert substring.without_repeats(empty).count() == 0


def test_quality_model(spark, sf_dir, docs, empty):
    d, y = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"), table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    got = {x.doc_id: x for x in quality_model.scored(d, y).collect()}
    assert len(got) == d.count()
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for i, x in got.items())
    held = [(got[x.doc_id].predicted, x.quality) for x in y.collect() if got[x.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    small, few = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    runs = [{x.doc_id: x.score for x in quality_model.scored(small.repartition(n), few.union(few)).collect()} for n in (1, 5)]
    assert runs[0] == runs[1]  # whatever the partitions, and with repeated labels
    none = spark.createDataFrame([(0, None)], "doc_id long, quality int")
    assert {x.score for x in quality_model.scored(docs, none).collect()} == {0.5}
    assert quality_model.scored(empty, none).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs, seen = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, docs, sf_dir), "stage")
        seen.append((name, docs, made))
        docs = made
    texts = [{x.doc_id: x.text for x in d.collect()} for _, _, d in seen[:-1]]
    start = {x.doc_id: x.text for x in seen[0][1].collect()}
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, d in seen[:-1])
    assert set(texts[0]) == {i for i, t in start.items() if not brute_failed(t)}
    sets = {i: shingle_set(t) for i, t in texts[0].items()}
    for i in texts[0].keys() - texts[1].keys():
        assert any(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)
    left = sorted(texts[1])
    assert not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for n, i in enumerate(left) for j in left[n + 1 :])
    found = {x.doc_id for x in decontaminate.leaks(seen[2][1], table(spark, sf_dir, "benchmark")).collect()}  # held against all pairs in a test of its own
    assert set(texts[2]) == set(texts[1]) - found and found
    items = [x.text for x in table(spark, sf_dir, "benchmark").collect()]
    assert not any(b in t for t in texts[2].values() for b in items)
    con = duckdb.connect()
    con.register("documents", seen[3][1].toArrow())
    quota = {x[0]: int(x[4] / x[1] + 0.5) for x in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.ORACLE_SQL['op9_mixing']})").fetchall() if x[1]}
    assert collections.Counter(x.doc_id for x in seen[3][2].collect()) == +collections.Counter(quota)
    final = seen[-1][2].orderBy("start").collect()
    assert sorted(x.doc_id for x in final) == sorted(x.doc_id for x in seen[3][2].collect())
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, final))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert collections.Counter(map(tuple, got.select(*want.columns).collect())) == collections.Counter(want.fetchall())


def brute_substring(rows):
    first, want = {}, collections.Counter()
    for i, w in rows:
        for p in range(len(w) - 49):
            if i is not None:
                g = tuple(w[p : p + 50])
                first[g] = min(first.get(g, i), i)
    for i, w in rows:
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()] += 1
    return want


def test_substring_of_repeated_keys(spark, monkeypatch):
    """Rows that share a key but not the text are judged each by its own words; hot passages are salted; spans that only look equal stay."""
    r = random.Random(8)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    p, q = make(100), make(100)
    rows = [(1, p), (5, p + make(20)), (5, q), (5, p[:70] + make(9)), (5, q), (6, q[3:80] + p[10:90]), (6, p)]
    rows += [(10 + i, make(7) + p[i : i + 60] + make(5)) for i in range(40)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    want = brute_substring([(i, [x.encode() for x in w]) for i, w in rows])
    assert collections.Counter(map(tuple, substring.without_repeats(d).collect())) == want
    monkeypatch.setattr(common, "HOT_SHARE", 1e-9)
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    salted = substring.without_repeats(d.repartition(5))
    assert collections.Counter(map(tuple, salted.collect())) == want
    # with fingerprints that all agree, only the words at the source decide
    spans = substring._cut(3)(iter([pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "a b c d", "spans": [{"start": 0, "n": 1, "digest": substring.digest([b"a", b"b", b"x"])}, {"start": 1, "n": 1, "digest": substring.digest([b"b", b"c", b"d"])}]}])]))
    assert [x["n_removed"] for b in spans for x in b.to_pylist()] == [3]
