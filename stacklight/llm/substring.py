"""Removal of long spans that repeat across documents, by compaction of a de Bruijn graph of words.

A window of WINDOW words is an edge of the graph (k-mer). Edges are kept as in minimizer-based compactors (Chikhi et al. 2016, BCALM 2):
consecutive edges of a document that share the least hash of their inner MINIMIZER-grams form one piece, about two pieces per window length
instead of an edge per word. Equal windows always get equal minimizers, so nothing that repeats is missed.

1. Pieces of all documents; minimizers that occur in two documents are kept (partial sums of least and greatest document).
2. Pieces with equal contents are one node. Where every occurrence of a node is followed by one and the same node and that one is always preceded by it,
   the path does not branch; joins of the links compact such paths into repeated spans with the coordinates of their first source.
3. Pieces that share a minimizer but differ (ends of a repeat, edits) are compared window by window, on the documents where they first occur;
   windows that go on side by side in a document and in their source are one span again.
4. Spans are candidates until verified: the words at the source's coordinates are read from its text and digested (BLAKE2b, 128 bits), and a span is removed
   only where the words of the document have that digest.

Windows are judged on the input: a word goes if some window over it also starts in a document with a smaller doc_id.

A document is known by its key and a hash of its text, so rows that share a key but not the text are judged each by its own words. Rows with one key don't cut each other.
Null and empty texts and texts shorter than a window lose nothing. Null keys are neither sources nor cut. Very long texts are rolled whole.
Extra columns aren't read. An empty table gives an empty result. Joins on repeated contents spread hot keys (a passage in a third of all documents) over many tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import Texts, batches, gram_hashes, mix, salted_join, valid_starts
from stacklight.session import dropped, written

WINDOW = 50
MINIMIZER = 16


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values, by doubling."""
    have, done = x, 1
    while done * 2 <= width:
        have = np.minimum(have[: len(have) - done], have[done:])
        done *= 2
    rest = width - done
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class Pieces:
    """The pieces of a batch: runs of windows with one minimizer."""

    def __init__(self, t: Texts, window: int, minimizer: int):
        h = t.hashes
        self.windows = gram_hashes(h, window)
        none = np.zeros(0, np.int64)
        self.start = self.n = self.doc = none
        self.anchor = self.content = np.zeros(0, np.uint64)
        if not len(self.windows):
            return
        least = window_minima(gram_hashes(h, minimizer), window - minimizer + 1)
        ok = valid_starts(t.bounds, window, len(self.windows))
        p = np.flatnonzero(ok)
        if not len(p):
            return
        doc = np.searchsorted(t.bounds, p, "right") - 1
        new = np.ones(len(p), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (least[p[1:]] != least[p[:-1]])
        at = np.flatnonzero(new)
        self.doc = doc[at]
        self.start = p[at] - t.bounds[self.doc]
        self.n = np.diff(np.append(at, len(p)))
        self.anchor = least[p[at]]
        # of all the piece's windows in their order
        place = np.arange(len(p), dtype=np.uint64) - np.repeat(at, self.n).astype(np.uint64)
        self.content = mix(np.add.reduceat(mix(self.windows[p] + place * np.uint64(0x9E3779B97F4A7C15)), at) + self.n.astype(np.uint64))


def _pieces(window: int, minimizer: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text", 4 << 20):
            x = Pieces(Texts(b.column("text")), window, minimizer)
            ids, fps = (b.column(c).take(pa.array(x.doc)) for c in ("doc_id", "fp"))
            yield pa.RecordBatch.from_arrays([pa.array(x.anchor.view(np.int64)), pa.array(x.content.view(np.int64)), ids, fps, pa.array(x.start.astype(np.int32)), pa.array(x.n.astype(np.int32))], ["anchor", "content", "doc_id", "fp", "start", "n"])

    return run


def _windows(window: int):
    """Of (doc_id, fp, text, parts), the windows of those parts: (anchor, hash, doc_id, fp, start)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text", 4 << 20):
            t = Texts(b.column("text"))
            g = gram_hashes(t.hashes, window)
            parts, n_parts = b.column("parts"), np.asarray(b.column("parts").value_lengths())
            flat = parts.flatten()
            start, n, anchor = (np.asarray(flat.field(k)) for k in ("start", "n", "anchor"))
            row = np.repeat(np.arange(t.n), n_parts)
            index = np.repeat(t.bounds[row] + start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows = np.repeat(row, n)
            ids, fps = (b.column(c).take(pa.array(rows)) for c in ("doc_id", "fp"))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(anchor, n)), pa.array(g[index].view(np.int64)), ids, fps, pa.array((index - t.bounds[rows]).astype(np.int32))], ["anchor", "hash", "doc_id", "fp", "start"])

    return run


def digest(words: list[bytes]) -> bytes:
    """Of the words themselves: independent of the hashes by which spans were found."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _source_digests(window: int):
    """Of (doc_id, fp, text, parts), the digest of each part: what its source really says there."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            rows, starts, ns, digests = [], [], [], []
            for i, (text, parts) in enumerate(zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("parts"), strict=True)):
                words = (text or b"").split()
                for start, n in zip(parts.values.field("source_start").to_pylist(), parts.values.field("n").to_pylist(), strict=True):
                    rows.append(i)
                    starts.append(start)
                    ns.append(n)
                    digests.append(digest(words[start : start + n + window - 1]))
            ids, fps = (b.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "fp"))
            yield pa.RecordBatch.from_arrays([ids, fps, pa.array(starts, pa.int32()), pa.array(ns, pa.int32()), pa.array(digests, pa.binary())], ["source", "source_fp", "source_start", "n", "digest"])

    return run


def _cut(window: int):
    """Of (doc_id, text, spans): counts and the digest of what is left. A span counts only if its words have the digest of its source's."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            ids, counts, removed, shas = b.column("doc_id"), [], [], []
            for text, spans in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("spans"), strict=True):
                words = (text or b"").split()
                left, n = words, 0
                if spans.is_valid and len(spans):
                    gone = np.zeros(len(words) + 1, np.int64)
                    for lo, k, want in zip(*(spans.values.field(c).to_pylist() for c in ("start", "n", "digest")), strict=True):
                        hi = lo + k + window - 1
                        if hi <= len(words) and digest(words[lo:hi]) == want:
                            gone[lo] += 1
                            gone[hi] -= 1
                    mask = np.cumsum(gone[:-1]) > 0
                    n = int(mask.sum())
                    if n:
                        left = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                counts.append(len(words))
                removed.append(n)
                shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def compacted(nodes: DataFrame, pieces: DataFrame) -> DataFrame:
    """Repeated spans (anchor, content of their first piece; source coordinates, pieces, n, times) from nodes with source coordinates and all their occurrences.

    A link is the pair of nodes that follow each other in a document. A node's successor is unique if all its occurrences go on to one node;
    the same holds for predecessors. All nodes of a nonbranching path have the same occurrences, so the path lies in one
    stretch of its source document and a window over that document numbers it."""
    nxt = pieces.select(F.col("anchor").alias("next_anchor"), F.col("content").alias("next_content"), "doc_id", "fp", F.col("start").alias("at"))
    here = pieces.select("anchor", "content", "doc_id", "fp", (F.col("start") + F.col("n")).alias("at"))
    links = here.join(nxt, ["doc_id", "fp", "at"]).groupBy("anchor", "content", "next_anchor", "next_content").agg(F.count("*").alias("times"))
    count = nodes.select("anchor", "content", "occurrences")
    plain = links.join(count, ["anchor", "content"]).where("times = occurrences").drop("occurrences")
    into = count.select(F.col("anchor").alias("next_anchor"), F.col("content").alias("next_content"), F.col("occurrences").alias("arrivals"))
    plain = plain.join(into, ["next_anchor", "next_content"]).where("times = arrivals")
    inner = plain.select(F.col("next_anchor").alias("anchor"), F.col("next_content").alias("content"), F.lit(1).alias("inner"))
    x = nodes.join(inner, ["anchor", "content"], "left")
    along = Window.partitionBy("source", "source_fp").orderBy("source_start", "anchor", "content")
    x = x.withColumn("path", F.sum(F.when(F.col("inner").isNull(), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.min(F.struct("source_start", "anchor", "content", "occurrences")).alias("head")
    spans = x.groupBy("source", "source_fp", "path").agg(head, F.count("*").alias("pieces"), F.sum("n").cast("int").alias("n"))
    return spans.select("head.anchor", "head.content", "source", "source_fp", F.col("head.source_start").alias("source_start"), "pieces", "n", F.col("head.occurrences").alias("times"))


def candidates(d: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """(doc_id, fp, start, n, source, source_fp, source_start) of the spans found by their hashes, n in windows; d: (doc_id, fp, text)."""
    all_pieces = written(d.where("doc_id IS NOT NULL").mapInArrow(_pieces(window, minimizer), "anchor long, content long, doc_id long, fp long, start int, n int"), "pieces")
    shared = all_pieces.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("content").alias("c0"), F.max("content").alias("c1"), F.count("*").alias("times"))
    shared = written(shared.where("lo < hi").select("anchor", (F.col("c0") < F.col("c1")).alias("mixed"), "times"), "anchors")
    pieces = written(salted_join(all_pieces, shared, ["anchor"], "times", ["doc_id", "start"]).drop("times"), "shared-pieces")
    dropped(all_pieces, shared)
    nodes = pieces.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "fp", "start")).alias("s"), F.max("doc_id").alias("hi"), F.count("*").alias("occurrences"), F.max("n").alias("n"), F.first("mixed").alias("mixed"))
    nodes = written(nodes.select("anchor", "content", F.col("s.doc_id").alias("source"), F.col("s.fp").alias("source_fp"), F.col("s.start").alias("source_start"), "hi", "occurrences", "n", "mixed"), "nodes")
    # whole pieces: occurrences after the source document, as compacted spans
    repeated = nodes.where("source < hi")
    within = written(salted_join(pieces.select("anchor", "content", "doc_id", "fp", "start", "n"), repeated.select("anchor", "content", "occurrences"), ["anchor", "content"], "occurrences", ["doc_id", "start"]).drop("occurrences"), "repeated-pieces")
    spans = written(compacted(repeated, within), "spans")
    whole = salted_join(within.select("anchor", "content", "doc_id", "fp", "start"), spans.drop("pieces"), ["anchor", "content"], "times", ["doc_id", "start"]).where("doc_id > source")
    # differing pieces of one minimizer: windows where they first occur
    first = pieces.where("mixed").join(nodes.where("mixed").select("anchor", "content", F.col("source").alias("doc_id"), F.col("source_fp").alias("fp")), ["anchor", "content", "doc_id", "fp"])
    by_doc = first.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("parts"))
    windows = written(d.join(by_doc, ["doc_id", "fp"]).select("doc_id", "fp", "text", "parts").mapInArrow(_windows(window), "anchor long, hash long, doc_id long, fp long, start int"), "windows")
    least = windows.groupBy("anchor", "hash").agg(F.min(F.struct("doc_id", "fp", "start")).alias("s"), F.max("doc_id").alias("hi"), F.count("*").alias("times")).where("s.doc_id < hi")
    least = written(least.select("anchor", "hash", F.col("s.doc_id").alias("source"), F.col("s.fp").alias("source_fp"), F.col("s.start").alias("source_start"), "times"), "first-windows")
    single = salted_join(windows, least, ["anchor", "hash"], "times", ["doc_id", "start"]).where("doc_id > source")
    # windows that go on side by side in both documents are one span
    side = Window.partitionBy("doc_id", "fp", "source", "source_fp", "away").orderBy("start")
    single = single.select("doc_id", "fp", "start", "source", "source_fp", (F.col("source_start") - F.col("start")).alias("away")).distinct()
    single = single.withColumn("run", F.col("start") - F.row_number().over(side)).groupBy("doc_id", "fp", "source", "source_fp", "away", "run").agg(F.min("start").alias("start"), F.count("*").cast("int").alias("n"))
    columns = ["doc_id", "fp", "start", "n", "source", "source_fp", "source_start"]
    return written(whole.select(*columns).unionByName(single.withColumn("source_start", F.col("start") + F.col("away")).select(*columns)), "candidates")


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    d = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("fp"), F.col(f"`{text}`").alias("text"))
    found = candidates(d, window, minimizer)
    at = ["source", "source_fp", "source_start", "n"]
    said = found.groupBy(*at).agg(F.count("*").alias("times"))
    parts = said.groupBy(F.col("source").alias("doc_id"), F.col("source_fp").alias("fp")).agg(F.collect_list(F.struct("source_start", "n")).alias("parts"))
    # one of the rows with that key and text speaks for all
    digests = d.join(parts, ["doc_id", "fp"]).select("doc_id", "fp", "text", "parts").mapInArrow(_source_digests(window), "source long, source_fp long, source_start int, n int, digest binary")
    digests = written(digests.dropDuplicates(at).join(said, at), "source-digests")
    spans = salted_join(found, digests, at, "times", ["doc_id", "start"])
    by_doc = written(spans.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "n", "digest")).alias("spans")), "verified")
    dropped(found, digests)
    out = d.join(by_doc, ["doc_id", "fp"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
