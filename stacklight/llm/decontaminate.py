"""Benchmark decontamination: rare n-gram seeds find candidates, Smith-Waterman alignment of words scores them.

1. The benchmark is taken in blocks of a bounded number of words; a block's seeds are broadcast, so the join of passages to items is a lookup where the
   passages are. A block after another passes over all documents, so a benchmark of any size needs bounded memory.
2. A pass counts in how many documents each seed occurs. Seeds are rare if they aren't far above the middle one of the seeds of their
   own item that occur: commonness is relative.
3. A pass joins documents to items through seeds, gathers hits into regions along the alignment diagonal, and aligns each item
   with its regions (match 1, mismatch -1, gap -1). A score of at least THRESHOLD times the item's words is a leak. Regions with a rare
   seed are aligned at once. Regions that only common seeds hit are aligned if enough of their words are the item's to reach the
   threshold, so no count of a seed leaves a leak out.

Words are compared case-folded and without punctuation and symbols at their ends; a word of nothing else is compared whole. All words count in positions.

Null and empty texts and items match nothing; an item of fewer words than a seed is its own seed. Repeated rows are reported each. Of equal scores the first end is told. Very long
texts are read whole. Columns other than key and text aren't read."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import Texts, batches, gram_hashes, span_hashes, valid_starts
from stacklight.session import written

SEED_WORDS = 3
THRESHOLD = 0.5
#: A seed in more documents than this many times those of the item's middle seed (and than so many) isn't rare.
COMMON_TIMES, COMMON_LEAST = 20, 100
#: Pairs of a hit and an item that are laid out at once (those of one document always are).
HITS = 1_000_000
#: Benchmark words in a block; what a job carries is bounded by some 40 bytes a word.
BLOCK_WORDS = 500_000


@functools.cache
def _marks() -> np.ndarray:
    """Is a code point punctuation or a symbol?"""
    return np.fromiter((unicodedata.category(chr(c))[0] in "PS" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def mark_bytes(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes of UTF-8 text that belong to punctuation or symbols. Broken characters are none."""
    marks = _marks()
    ascii_marks = np.zeros(256, bool)
    ascii_marks[:128] = marks[:128]
    out = ascii_marks[data]
    heads = np.flatnonzero(data >= 0xC2)
    for n, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF5)):
        at = heads[(data[heads] >= low) & (data[heads] < high) & (heads + n <= len(data))]
        code, whole = (data[at] & (0xFF >> (n + 1))).astype(np.int64), np.ones(len(at), bool)
        for j in range(1, n):
            whole &= data[at + j] & 0xC0 == 0x80
            code = code << 6 | data[at + j] & 0x3F
        at = at[whole & marks[np.minimum(code, sys.maxunicode)]]
        for j in range(n):
            out[at + j] = True
    return out


class Folded(Texts):
    """Texts whose words are case-folded, and hashed without the marks at their ends."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        fold = lambda x: x if x is None else x.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
        super().__init__(pa.array(map(fold, column.cast(pa.large_binary()).to_pylist()), pa.large_binary()))

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            mark = mark_bytes(self.data)
            edge = np.flatnonzero(np.diff(mark, prepend=False, append=False))
            starts, ends, lo, hi = self.starts.copy(), self.ends.copy(), edge[::2], edge[1::2]  # runs of marks are lo:hi
            head, tail = np.flatnonzero(mark[starts]), np.flatnonzero(mark[ends - 1])
            starts[head] = hi[np.searchsorted(lo, starts[head], "right") - 1]
            ends[tail] = lo[np.searchsorted(lo, ends[tail] - 1, "right") - 1]
            bare = starts >= ends
            starts[bare], ends[bare] = self.starts[bare], self.ends[bare]
            self._hashes = span_hashes(self.data, starts, ends)
        return self._hashes


class Index:
    """Seeds of a block of items: sorted hashes, and for each its item and place."""

    def __init__(self, texts: list[str], ids: list[int], k: int):
        t = Folded(pa.array(texts, pa.string()))
        h, parts = t.hashes, []
        self.ids, self.k = ids, k
        self.words = [h[t.bounds[i] : t.bounds[i + 1]] for i in range(len(ids))]
        for i, w in enumerate(self.words):
            g = gram_hashes(w, min(k, len(w))) if len(w) else w
            parts.append((g, np.full(len(g), i, np.int32), np.arange(len(g), dtype=np.int32)))
        self.hash, self.item, self.place = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0) for j in range(3))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]
        self.rare = np.ones(len(self.hash), bool)
        self.lengths = np.asarray([len(w) for w in self.words], np.int64)
        self.widths = sorted({min(k, len(w)) for w in self.words if len(w)})

    def keep(self, mask: np.ndarray) -> None:
        self.hash, self.item, self.place, self.rare = self.hash[mask], self.item[mask], self.place[mask], self.rare[mask]

    def hits(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(positions of words in the batch, seed hashes there) of all windows that are seeds."""
        at, what = [], []
        unique = np.unique(self.hash)
        if len(unique):
            for width in self.widths:
                g = gram_hashes(t.hashes, width)
                if len(g):
                    found = np.searchsorted(unique, g)
                    found[found == len(unique)] = 0
                    p = np.flatnonzero((unique[found] == g) & valid_starts(t.bounds, width, len(g)))
                    at.append(p)
                    what.append(g[p])
        return (np.concatenate(at), np.concatenate(what)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def local_score(item: np.ndarray, regions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of one item against rows of word hashes (padded): best scores and the first columns where they end.

    Rows of the matrix go one by one; along a row, gaps are a running maximum because their cost is linear."""
    n, width = regions.shape
    ramp = np.arange(width, dtype=np.int32)
    inside = ramp[None, :] < lengths[:, None]
    above = np.zeros((n, width), np.int32)
    best, where = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for w in item:
        diagonal = np.zeros_like(above)
        diagonal[:, 1:] = above[:, :-1]
        row = np.maximum(diagonal + np.where((regions == w) & inside, 1, -1), above - 1)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        top = row.max(axis=1)
        able = np.flatnonzero((top >= best) & (top > 0))
        if len(able):
            at = row[able].argmax(axis=1)
            sooner = (top[able] > best[able]) | (at < where[able])
            where[able[sooner]] = at[sooner]
            best = np.maximum(best, top)
        above = row
    return best, where


def _seed_counts(shared: Broadcast):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        seeds = np.unique(index.hash)
        total = np.zeros(len(seeds), np.int64)
        for b in batches(it, "text"):
            t = Folded(b.column("text"))
            at, what = index.hits(t)
            if len(at):
                doc = np.searchsorted(t.bounds, at, "right") - 1
                pairs = np.unique(np.stack([doc.astype(np.uint64), what], 1), axis=0)
                np.add.at(total, np.searchsorted(seeds, pairs[:, 1]), 1)
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(seeds[some].view(np.int64)), pa.array(total[some])], ["seed", "n"])

    return run


def _portions(index: Index, t: Texts, at: np.ndarray, what: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first entry in the index, number of entries, position) of the hits of whole documents, some HITS entries at a time."""
    order = np.argsort(at, kind="stable")
    at, what = at[order], what[order]
    lo = np.searchsorted(index.hash, what, "left")
    reps = np.searchsorted(index.hash, what, "right") - lo
    doc = np.searchsorted(t.bounds, at, "right") - 1
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    total = np.cumsum(reps)
    i = 0
    while i < len(at):
        fit = np.searchsorted(total, (total[i - 1] if i else 0) + HITS, "right")
        k = np.searchsorted(ends, fit, "right") - 1
        j = int(ends[k]) if k >= 0 and ends[k] > i else int(ends[np.searchsorted(ends, i, "right")])
        yield lo[i:j], reps[i:j], at[i:j]
        i = j


def _align(index: Index, t: Texts, lo: np.ndarray, reps: np.ndarray, at: np.ndarray, threshold: float, found: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Puts the best (score, end, words of the item) of each (document, item) that reaches the threshold into found."""
    # each hit stands for one or more (item, place)
    entry = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    pos = np.repeat(at, reps)
    item, start, rare = index.item[entry], pos - index.place[entry], index.rare[entry]
    doc = np.searchsorted(t.bounds, pos, "right") - 1
    order = np.lexsort((start, item, doc))
    item, start, doc, rare = item[order], start[order], doc[order], rare[order]
    slack = (index.lengths // 2 + 2)[item]
    new = np.ones(len(item), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    rdoc, ritem, length, sure = doc[first], item[first], index.lengths[item[first]], np.logical_or.reduceat(rare, first)
    begin = np.maximum(start[first] - slack[first], t.bounds[rdoc])
    end = np.minimum(start[last] + length + slack[first], t.bounds[rdoc + 1])
    for i in np.unique(ritem):
        mine = np.flatnonzero(ritem == i)
        mine = mine[np.argsort((end - begin)[mine], kind="stable")]
        words, k = index.words[i], 0
        while k < len(mine):
            # regions of like width share a matrix of a bounded size
            m = k + 1
            while m < len(mine) and (m + 1 - k) * (end - begin)[mine[m]] <= 400_000:
                m += 1
            part = mine[k:m]
            k = m
            width = int((end - begin)[part].max())
            cols = begin[part][:, None] + np.arange(width)[None, :]
            regions = t.hashes[np.minimum(cols, len(t.hashes) - 1)]
            # no alignment scores more than the region has words of the item
            most = (np.isin(regions, words) & (cols < end[part][:, None])).sum(axis=1)
            able = sure[part] | (most >= threshold * len(words))
            if not able.any():
                continue
            part, regions = part[able], regions[able]
            score, where = local_score(words, regions, (end - begin)[part])
            for r in np.flatnonzero(score >= threshold * len(words)):
                key, stop = (int(rdoc[part[r]]), int(i)), int(begin[part[r]] + where[r] + 1 - t.bounds[rdoc[part[r]]])
                if key not in found or (-int(score[r]), stop) < (-found[key][0], found[key][1]):
                    found[key] = (int(score[r]), stop, len(words))


def _aligned(shared: Broadcast, threshold: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches(it, "text"):
            t = Folded(b.column("text"))
            at, what = index.hits(t)
            if not len(at):
                continue
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            for lo, reps, part in _portions(index, t, at, what):
                _align(index, t, lo, reps, part, threshold, found)
            if found:
                keys = sorted(found)
                ids, fps = (b.column(c).take(pa.array([d for d, _ in keys])) for c in ("doc_id", "fp"))
                yield pa.RecordBatch.from_arrays(
                    [ids, fps, pa.array([index.ids[i] for _, i in keys], pa.int64()), pa.array([found[x][0] for x in keys], pa.int64()), pa.array([found[x][0] / found[x][2] for x in keys], pa.float64()), pa.array([found[x][1] for x in keys], pa.int64())],
                    ["doc_id", "fp", "item_id", "matched", "score", "end_word"],
                )

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, words = [], [], 0
    for r in benchmark.select(F.col(item).cast("long").alias("i"), F.coalesce(text, F.lit("")).alias("t")).orderBy("i").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        words += len(r.t.split()) + 1
        if words >= most:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


FOUND = "doc_id long, fp long, item_id long, matched long, score double, end_word long"


def aligned(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, fp, item_id, matched, score, end_word): the best alignment of each document and item that reaches the threshold. fp: hash of the text."""
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("fp"), F.col(f"`{text}`").alias("text"))
    out = None
    for ids, texts in _blocks(benchmark, item, item_text, block_words):
        index = Index(texts, ids, seed_words)
        counts = d.mapInArrow(_seed_counts(spark.sparkContext.broadcast(index)), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        counted = counts.toArrow()  # as many rows as the block has seeds at most
        order = np.argsort(np.asarray(counted.column("seed")).view(np.uint64)) if counted.num_rows else np.zeros(0, int)
        seeds, n = np.asarray(counted.column("seed")).view(np.uint64)[order], np.asarray(counted.column("n"))[order]
        place = np.minimum(np.searchsorted(seeds, index.hash), max(0, len(seeds) - 1))
        df = np.where(seeds[place] == index.hash, n[place], 0) if len(seeds) else np.zeros(len(index.hash), np.int64)
        index.keep(df > 0)
        df, middle = df[df > 0], np.zeros(len(ids))
        order = np.argsort(index.item, kind="stable")
        edges = np.searchsorted(index.item[order], np.arange(len(ids) + 1))
        for i in range(len(ids)):
            if edges[i] < edges[i + 1]:
                middle[i] = np.median(df[order[edges[i] : edges[i + 1]]])
        index.rare = (df <= COMMON_LEAST) | (df <= COMMON_TIMES * middle[index.item])
        part = d.mapInArrow(_aligned(spark.sparkContext.broadcast(index), threshold), FOUND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, matched, score, end_word) of each leak, null keys too."""
    return aligned(docs, benchmark, **options).drop("fp")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without a leak. Rows are known by key and text, so those that share a key are judged each, and null keys too."""
    found = written(aligned(docs, benchmark, key=key, text=text, **options).select(F.col("doc_id").alias("__leak"), "fp").distinct(), "leaks")
    return docs.join(found, F.col(f"`{key}`").cast("long").eqNullSafe(found["__leak"]) & (F.xxhash64(F.col(f"`{text}`")) == found["fp"]), "left_anti")
