"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Words are known by 64-bit hashes and numbered by their frequency, so frequent ones have small ids of one or two bytes; an n-gram is a row of ids. A text is a begin,
its words and its end. ORDER is the order by default; any from 2 is built the same way.

1. Word counts: each task sums its words, Spark adds the sums; ranges of the sorted hashes are written as arrays with counts and ids.
2. n-grams: each task sums those of some HELD tokens and ships them as compressed rows, cut by the hash of the context (of both words of a bigram) into
   parts of about TOKENS_A_PART training tokens. A part is merged by one task into sorted hash arrays: counts, and for each context the sum of its
   counts and how many of them are 1, 2, 3 or more. With more than COARSE parts the exchange has two levels, so tasks times parts stays small.
3. The same merge gives the order below: a shorter n-gram's count is the number of different words before it, or what it really occurs if it starts
   with the begin. Words are counted by id in the same manner.
4. Discounts of each order come from its counts of counts, in closed form (Chen & Goodman 1999).
5. Workers map the arrays from the shared folder; the pages that a search touches are loaded, not the model. An array is cut into buckets of some
   64 keys by the upper bits of the hash; in a bucket 32 bits are compared, so an n-gram that training hasn't is taken for another with a probability of 2e-8.

Arrays are committed like the rest: temporary names, renamed when whole, listed by rows that Spark commits. In a store that isn't mounted, workers map copies of those they search.
p(w | u) = max(c(u w) - D(c), 0) / c(u) + gamma(u) * p(w | u without its first word), p(w) = max(N(. w) - D(N), 0) / N(. .) + gamma * 1 / (V + 1).

Null and empty texts are one token, the end. Null keys count as the key 'null' for the fold. Repeated rows count again. An empty training set leaves the uniform
distribution. Very long texts are counted and scored whole. Extra columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import Texts, batches, filesystem, mapped, mix, renamed
from stacklight.operators.ranges import cumulated
from stacklight.session import dropped, work_path, written

ORDER = 3
FOLDS, HELD_OUT = 7, 2
#: Training tokens, and words of the vocabulary, that one merging task gets.
TOKENS_A_PART, WORDS_A_PART = 2_000_000, 1_000_000
#: Tokens whose n-grams, and words, that a task sums before it ships them.
HELD, HELD_WORDS = 1_500_000, 3_000_000
#: Parts of the first level of an exchange.
COARSE = 1024
BUCKET = 64
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)


def lower(t: Texts) -> Texts:
    """The texts with A-Z in lower case."""
    data = t.data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    t.data = data
    return t


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts (1 each by default)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = None if counts is None else np.argsort(keys, kind="stable")
    keys = np.sort(keys) if order is None else keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))) if order is None else np.add.reduceat(counts[order], at)


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of ids."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return h


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal ranges of the upper 32 bits."""
    return (((h >> _SHIFT) * np.uint64(parts)) >> _SHIFT).astype(np.int64)


def route(columns: list[np.ndarray]) -> np.ndarray:
    """The hash that decides where an n-gram is merged: that of its context, or of both words of a bigram, because one word may be the context of a large share."""
    return hashed(columns[: max(2, len(columns) - 1)])


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where equal values beside each other begin and end."""
    edges = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else []
    return [*zip(edges, edges[1:], strict=False)]


def _grouped(x: np.ndarray) -> np.ndarray:
    """An order that brings equal small numbers together, by radix where they have 16 bits."""
    return np.argsort(x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x, kind="stable")


def distinct(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order of their hashes, with the sums of their counts."""
    if not len(counts):
        return columns, counts
    h = hashed(columns)
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return [c[order[at]] for c in columns], np.add.reduceat(counts[order], at)


def _planes(x: np.ndarray) -> bytes:
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def packed(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows in order of their first column: that as gaps, and all by byte planes; compressed."""
    order = np.argsort(columns[0])
    first, *rest = (c[order] for c in columns)
    body = b"".join(map(_planes, [np.diff(first, prepend=0), *rest, counts[order]]))
    return zstandard.ZstdCompressor(level=1).compress(np.asarray([len(columns), len(counts)], "<i8").tobytes() + body)


def unpacked(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    k, n = np.frombuffer(body, "<i8", 2).tolist()
    at, out = 16, []
    for _ in range(k + 1):
        width = body[at]
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(body, np.uint8, width * n, at + 1).reshape(width, n).T
        out.append(x.view("<u8").reshape(n).astype(np.int64))
        at += 1 + width * n
    out[0] = np.cumsum(out[0])
    return out[:-1], out[-1]


def together(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    got = [unpacked(bytes(b)) for b in blobs]
    return [np.concatenate([c[k] for c, _ in got]) for k in range(len(got[0][0]))], np.concatenate([n for _, n in got])


def saved(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Each array as a file of its own, renamed when whole."""
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    for k, a in arrays.items():
        temporary = f"{root}/.{name}.{k}.{TaskContext.get().taskAttemptId()}.tmp"
        with files.open_output_stream(temporary, compression=None) as f:
            np.save(f, a, allow_pickle=False)
        renamed(files, temporary, f"{root}/{name}.{k}.npy")


def loaded(folder: str, name: str, key: str) -> np.ndarray:
    files, root = filesystem(folder)
    return mapped(files, f"{root}/{name}.{key}.npy")


class Sorted:
    """Sorted arrays in files, one after another, searched as one."""

    def __init__(self, folder: str, names: list[str], values: tuple[str, ...]):
        self.keys = [loaded(folder, n, "keys") for n in names]
        self.values = {v: [loaded(folder, n, v) for n in names] for v in values}
        self.first = np.asarray([k[0] if len(k) else 0 for k in self.keys], np.uint64)
        self.base = np.concatenate([[0], np.cumsum([len(k) for k in self.keys])]).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each of the sorted keys in all arrays taken together, or -1."""
        out = np.full(len(keys), -1, np.int64)
        part = np.searchsorted(self.first, keys, "right") - 1
        edges = np.searchsorted(part, np.arange(len(self.keys) + 1))
        for i, a in enumerate(self.keys):
            lo, hi = edges[i], edges[i + 1]
            if hi > lo and len(a):
                at = np.searchsorted(a, keys[lo:hi])
                at[at == len(a)] = 0
                ok = a[at] == keys[lo:hi]
                out[lo:hi][ok] = self.base[i] + at[ok]
        return out

    def take(self, value: str, at: np.ndarray) -> np.ndarray:
        """Values at sorted places."""
        arrays = self.values[value]
        out = np.zeros(len(at), arrays[0].dtype if arrays else np.int64)
        edges = np.searchsorted(at, self.base)
        for i, a in enumerate(arrays):
            lo, hi = edges[i], edges[i + 1]
            if hi > lo:
                out[lo:hi] = a[at[lo:hi] - self.base[i]]
        return out


#: Codes of small values: one number of 8 bits, or four of 4, 4, 3 and 3; the greatest code stands for a row of a list.
_WIDTHS = {1: (8,), 4: (4, 4, 3, 3)}


def coded(values: list[np.ndarray]) -> dict[str, np.ndarray]:
    widths = _WIDTHS[len(values)]
    code, fits, shift = np.zeros(len(values[0]), np.int64), np.ones(len(values[0]), bool), 0
    for v, w in zip(values, widths, strict=True):
        fits &= v < 1 << w
        code |= np.minimum(v, (1 << w) - 1) << shift
        shift += w
    top = 255 if len(values) == 1 else 0xFFFF
    fits &= code < top
    over = np.flatnonzero(~fits)
    code[over] = top
    return {"code": code.astype(np.uint8 if len(values) == 1 else np.uint16), "over": over.astype(np.int64), "large": np.stack([v[over] for v in values], 1).astype(np.int64)}


def arranged(h: np.ndarray, parts: int, values: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Sorted hash arrays of one part: buckets by the upper bits, the lower 32 bits in order, and coded values."""
    n = max(1, -(-len(h) // BUCKET))
    bucket = _bucket(h, parts, n)
    order = np.argsort((bucket.astype(np.uint64) << _SHIFT) | (h & _LOW))
    index = np.searchsorted(bucket[order], np.arange(n + 1)).astype(np.uint32)
    return {"index": index, "low": (h[order] & _LOW).astype(np.uint32), **coded([v[order] for v in values])}


def _bucket(h: np.ndarray, parts: int, n: int) -> np.ndarray:
    return (((((h >> _SHIFT) * np.uint64(parts)) & _LOW) * np.uint64(n)) >> _SHIFT).astype(np.int64)


class Hashed:
    """Arrays of all parts, searched by hashes."""

    def __init__(self, folder: str, name: str, have: tuple[int, ...], parts: int, width: int):
        self.folder, self.name, self.have, self.parts, self.width, self.open = folder, name, frozenset(have), parts, width, {}

    def _arrays(self, part: int) -> dict[str, np.ndarray]:
        if part not in self.open:
            self.open[part] = {k: loaded(self.folder, f"{self.name}-{part:06d}", k) for k in ("index", "low", "code", "over", "large")}
        return self.open[part]

    def take(self, where: np.ndarray, h: np.ndarray, able: np.ndarray) -> list[np.ndarray]:
        """Values of the hashes h in the parts that where hashes to; 0 where it isn't able or there is none."""
        out = np.zeros((len(h), self.width), np.int64)
        rows = np.flatnonzero(able)
        part = part_of(where[rows], self.parts)
        order = _grouped(part)
        rows, part = rows[order], part[order]
        for i, j in _runs(part):
            if int(part[i]) in self.have:
                self._one(self._arrays(int(part[i])), rows[i:j], h[rows[i:j]], out)
        return list(out.T)

    def _one(self, a: dict[str, np.ndarray], rows: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
        bucket, x, low = _bucket(h, self.parts, len(a["index"]) - 1), (h & _LOW).astype(np.uint32), a["low"]
        lo, hi = a["index"][bucket].astype(np.int64), a["index"][bucket + 1].astype(np.int64)
        end = hi.copy()
        for _ in range(int((hi - lo).max()).bit_length() if len(h) else 0):
            middle = (lo + hi) >> 1
            less = (low[np.minimum(middle, len(low) - 1)] < x) & (lo < hi)
            lo, hi = np.where(less, middle + 1, lo), np.where(less, hi, np.maximum(middle, lo))
        hit = np.flatnonzero(lo < end)
        hit = hit[low[lo[hit]] == x[hit]]
        at, code = lo[hit], a["code"][lo[hit]].astype(np.int64)
        shift = 0
        values = np.empty((len(hit), self.width), np.int64)
        for k, w in enumerate(_WIDTHS[self.width]):
            values[:, k] = code >> shift & (1 << w) - 1
            shift += w
        large = np.flatnonzero(code == (255 if self.width == 1 else 0xFFFF))
        values[large] = a["large"][np.searchsorted(a["over"], at[large])]
        out[rows[hit]] = values


def grams(t: Texts, ids: np.ndarray, size: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the n-gram that ends at each token, and where each text's tokens start. The end is size - 1, the begin size, and what lies before it size + 1."""
    n = t.counts + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    words = np.empty(bounds[-1], np.int64)
    last = bounds[1:] - 1
    mask = np.ones(len(words), bool)
    mask[last] = False
    words[mask], words[last] = ids, size - 1
    place = np.arange(len(words)) - np.repeat(bounds[:-1], n)
    columns = [words]
    for k in range(1, order):
        before = np.full(len(words), size + 1, np.int64)
        before[k:] = words[: len(words) - k]
        before[place < k] = size + 1
        before[place == k - 1] = size
        columns.insert(0, before)
    return columns, bounds


def _cut(x: np.ndarray, discounts: tuple) -> np.ndarray:
    return np.maximum(x - np.asarray([0.0, *discounts])[np.minimum(x, 3)], 0.0)


class Model:
    """Ids, and log10 probabilities, from the arrays."""

    def __init__(self, folder: str, m: tuple):
        self.m = m = dict(m)
        self.words = Sorted(folder, [f"words-{i:06d}" for i in m["word_parts"]], ("count", "id"))
        self.size, self.order = m["size"], m["order"]
        if "discounts" in m:
            have = dict(m["files"])
            self.grams = {k: Hashed(folder, f"grams{k}", have.get(k, ()), m["parts"], 1) for k in range(2, self.order + 1)}
            self.contexts = {k: Hashed(folder, f"contexts{k}", have.get(k, ()), m["parts"], 4) for k in range(3, self.order + 1)}
            self.stats = {i: {k: loaded(folder, f"stats-{i:06d}", k) for k in _KINDS} for i in m["stat_parts"]}

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, training count) of each word."""
        unique, back = np.unique(hashes, return_inverse=True)
        at = self.words.find(unique)
        count, ids = np.zeros(len(unique), np.int64), np.full(len(unique), -1, np.int64)
        ok = at >= 0
        count[ok], ids[ok] = self.words.take("count", at[ok]), self.words.take("id", at[ok])
        return ids[back], count[back]

    def _stat(self, ids: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
        """Values of words by id, 0 for unknown ones: parts hold a row for each id of their range."""
        out = [np.zeros(len(ids), np.int64) for _ in kinds]
        rows = np.flatnonzero(ids >= 0)
        part = ids[rows] // self.m["words_a_part"]
        order = _grouped(part)
        rows, part = rows[order], part[order]
        for i, j in _runs(part):
            arrays = self.stats.get(int(part[i]))
            if arrays is not None:
                at = ids[rows[i:j]] - int(part[i]) * self.m["words_a_part"]
                for o, k in zip(out, kinds, strict=True):
                    o[rows[i:j]] = arrays[k][at]
        return out

    def log10(self, columns: list[np.ndarray]) -> np.ndarray:
        """log10 p(last column | those before it), ids being -1 for words that training hasn't."""
        m, pad = self.m, self.size + 1
        (before,) = self._stat(columns[-1], ("before",))
        p = m["low_gamma"] / (self.size + 1) + (_cut(before, m["low_discounts"]) / m["types"] if m["types"] else 0.0)
        for k in range(2, self.order + 1):
            gram = columns[-k:]
            whole = gram[0] != pad
            seen = whole & np.all([c >= 0 for c in gram], axis=0)
            h = hashed(gram)
            if k == 2:
                (count,) = self.grams[k].take(h, h, seen)
                follow, one, two, more = self._stat(np.where(whole, gram[0], -1), _KINDS[:4])
            else:
                context = hashed(gram[:-1])  # also its route
                (count,) = self.grams[k].take(context, h, seen)
                follow, one, two, more = self.contexts[k].take(context, context, whole & np.all([c >= 0 for c in gram[:-1]], axis=0))
            d = m["discounts"][k - 2]
            total = np.maximum(follow, 1)
            gamma = np.where(follow > 0, (d[0] * one + d[1] * two + d[2] * more) / total, 1.0)
            p = np.where(whole, _cut(count, d) / total + gamma * p, p)
        return np.log10(p)


@lru_cache(maxsize=1)
def model(folder: str, parts: tuple) -> Model:
    """The arrays of one model, mapped once by each worker."""
    return Model(folder, parts)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of types seen 1, 2, 3 and 4 times; plain fallbacks where a small corpus leaves them undefined."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        x = k - (k + 1) * y * b / a if a and b else 0.5 * k
        out.append(float(min(max(x, 0.05), k)) if k > 1 else float(min(max(x, 0.05), 0.95)))
    return out[0], out[1], out[2]


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0
    schema = ["word", "n"]

    def flushed() -> pa.RecordBatch:
        k, n = summed(np.concatenate(keys), np.concatenate(counts))
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], schema)

    for b in batches(it, "text", 4 << 20):
        k, n = summed(lower(Texts(b.column("text"))).hashes)
        keys.append(k)
        counts.append(n)
        held += len(k)
        if held > HELD_WORDS:
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [k], [n], len(k)
            if held > HELD_WORDS // 2:
                yield flushed()
                keys, counts, held = [], [], 0
    if keys:
        yield flushed()


def _save_words(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(np.asarray(b.column(c)) for c in ("word", "n", "id")) for b in it]
        if got:
            keys, counts, ids = (np.concatenate([x[k] for x in got]) for k in range(3))
            i = TaskContext.get().partitionId()
            saved(folder, f"words-{i:06d}", {"keys": keys.view(np.uint64) ^ np.uint64(1 << 63), "count": counts, "id": ids})
            yield pa.RecordBatch.from_pylist([{"part": i, "words": len(keys), "tokens": int(counts.sum())}])

    return run


def _shipped(columns: list[np.ndarray], counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A compressed row for each part that the n-grams lie in."""
    where = part_of(route(columns), parts)
    order = _grouped(where)
    some, blobs = [], []
    for i, j in _runs(where[order]):
        rows = order[i:j]
        some.append(int(where[rows[0]]))
        blobs.append(packed([c[rows] for c in columns], counts[rows]))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _count_grams(folder: str, vocabulary: tuple, order: int, parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kept, held = model(folder, vocabulary), [], 0

        def flushed() -> pa.RecordBatch:
            columns = [np.concatenate([x[k] for x in kept]) for k in range(order)]
            return _shipped(*distinct(columns, np.ones(len(columns[0]), np.int64)), parts)

        for b in batches(it, "text", 4 << 20):
            t = lower(Texts(b.column("text")))
            kept.append(grams(t, m.ids(t.hashes)[0], m.size, order)[0])
            held += len(kept[-1][0])
            if held >= HELD:
                yield flushed()
                kept, held = [], 0
        if kept:
            yield flushed()

    return run


def _recut(parts: int):
    """Rows of a coarse part, summed HELD at a time and cut into its parts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for b in it:
            for x in b.column("blob").to_pylist():
                kept.append(x)
                held += unpacked(x)[1].size
                if held >= HELD:
                    yield _shipped(*distinct(*together(kept)), parts)
                    kept, held = [], 0
        if kept:
            yield _shipped(*distinct(*together(kept)), parts)

    return run


_KINDS = ("follow", "one", "two", "more", "before")
MERGED = "part int, kind string, blob binary, n long"


def _merge(folder: str, order: int, size: int, parts: int, words_a_part: int):
    """Of one part's n-grams: arrays in files; rows (part, 'next', blob) of the order below, or (part, kind, blob) of words; (part, 'n1' ...) numbers for the discounts."""

    def by_word(kind: str, ids: np.ndarray, counts: np.ndarray) -> list[tuple]:
        k, n = summed(ids.astype(np.uint64), counts)
        edges = np.searchsorted(k, np.arange(0, int(k[-1]) + 1 + words_a_part, words_a_part).astype(np.uint64)) if len(k) else [0]
        return [(i, kind, packed([k[a:b].astype(np.int64)], n[a:b]), 0) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows.part.iloc[0])
        columns, counts = distinct(*together(list(rows.blob)))
        whole = columns[0] != size + 1
        real, n = [c[whole] for c in columns], counts[whole]
        saved(folder, f"grams{order}-{part:06d}", arranged(hashed(real), parts, [n]))
        out = [(part, f"n{c}", None, int((n == c).sum())) for c in (1, 2, 3, 4)] + [(part, "types", None, len(n))]
        kinds = {"follow": n, "one": (n == 1).astype(np.int64), "two": (n == 2).astype(np.int64), "more": (n >= 3).astype(np.int64)}
        if order == 2:
            for kind, v in kinds.items():
                out += by_word(kind, real[0][v > 0], v[v > 0])
            out += by_word("before", real[1], np.ones(len(n), np.int64))
        else:
            h = hashed(real[:-1])
            by = np.argsort(h)
            at = np.flatnonzero(np.concatenate([[True], np.diff(h[by]) != 0])) if len(h) else np.zeros(0, int)
            saved(folder, f"contexts{order}-{part:06d}", arranged(h[by][at], parts, [np.add.reduceat(v[by], at) if len(at) else v for v in kinds.values()]))
            below = _shipped(*distinct(columns[1:], np.where(whole, 1, counts)), parts)
            out += [(p, "next", b, 0) for p, b in zip(below.column("part").to_pylist(), below.column("blob").to_pylist(), strict=True)]
        return pd.DataFrame(out, columns=["part", "kind", "blob", "n"])

    return run


def _merge_stats(folder: str, words_a_part: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows.part.iloc[0])
        merged = {}
        for kind in _KINDS:
            got = list(rows.blob[rows.kind == kind])
            (ids,), n = together(got) if got else ([np.zeros(0, np.int64)], np.zeros(0, np.int64))
            merged[kind] = summed(ids.astype(np.uint64), n)
        base = part * words_a_part
        arrays = {}
        for kind, (k, n) in merged.items():
            small = not len(n) or n.max() < 1 << 31
            arrays[kind] = np.zeros(words_a_part, np.int32 if small else np.int64)
            arrays[kind][k.astype(np.int64) - base] = n
        saved(folder, f"stats-{part:06d}", arrays)
        before = arrays["before"]
        return pd.DataFrame([(part, *[int((before == c).sum()) for c in (1, 2, 3, 4)], int((before >= 3).sum()))], columns=["part", "n1", "n2", "n3", "n4", "more"])

    return run


def train(df: DataFrame, path: str | None = None, text: str = "text", order: int = ORDER) -> tuple[str, tuple]:
    """Counts the texts and writes the model; returns its folder and what readers need besides the arrays."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = df.sparkSession
    path = path or work_path(spark, "lm")
    d = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counted = d.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # as unsigned numbers in order: the sign bit flipped gives the same order among signed ones
    flipped = written(counted.select(F.col("word").bitwiseXOR(F.lit(-(1 << 63))).alias("word"), "n"), "lm-words")
    known = flipped.count()
    numbered = cumulated(flipped, [F.desc("n"), F.col("word")], F.lit(1), "id").withColumn("id", F.col("id").cast("long"))
    ordered = numbered.repartitionByRange(max(1, -(-known // WORDS_A_PART)), "word").sortWithinPartitions("word")
    files = written(ordered.mapInArrow(_save_words(path), "part long, words long, tokens long"), "lm-word-files").orderBy("part").collect()
    dropped(flipped)
    texts, size = d.count(), known + 1
    tokens = sum(f.tokens for f in files) + texts
    parts = max(1, -(-tokens // TOKENS_A_PART))
    m = {"order": order, "word_parts": tuple(f.part for f in files), "size": size, "texts": texts, "tokens": tokens, "parts": parts, "words_a_part": WORDS_A_PART}
    rows = d.mapInArrow(_count_grams(path, tuple(m.items()), order, parts), "part int, blob binary")
    all_files, all_discounts, made = [], [], None
    for k in range(order, 1, -1):
        if parts > COARSE:
            # neighbouring parts go together first; their rows are summed again and cut further
            rows = rows.repartition(COARSE, F.floor(F.col("part") * COARSE / parts)).mapInArrow(_recut(parts), "part int, blob binary")
        upper, made = made, written(rows.groupBy("part").applyInPandas(_merge(path, k, size, parts, WORDS_A_PART), MERGED), f"lm-grams{k}")
        numbers = {r.kind: r.n for r in made.where("blob IS NULL").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        all_files.append((k, tuple(sorted(r.part for r in made.where("kind = 'types'").select("part").collect()))))
        all_discounts.insert(0, discounts([numbers.get(f"n{c}", 0) for c in (1, 2, 3, 4)]))
        m["types"] = numbers.get("types", 0)
        if upper is not None:
            dropped(upper)
        if k > 2:
            rows = made.where("kind = 'next'").select("part", "blob")
    stats = written(made.where(F.col("kind").isin(*_KINDS)).groupBy("part").applyInPandas(_merge_stats(path, WORDS_A_PART), "part int, n1 long, n2 long, n3 long, n4 long, more long"), "lm-stat-files").orderBy("part").collect()
    dropped(made)
    m["stat_parts"] = tuple(r.part for r in stats)
    low = [sum(r[k] for r in stats) for k in ("n1", "n2", "n3", "n4", "more")]
    m["files"], m["discounts"], m["low_discounts"] = tuple(all_files), tuple(all_discounts), discounts(low[:4])
    d1, d2, d3 = m["low_discounts"]
    m["low_gamma"] = (d1 * low[0] + d2 * low[1] + d3 * low[4]) / m["types"] if m["types"] else 1.0
    return path, tuple(m.items())


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(folder: str, parts: tuple):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(folder, parts)
        total, size, texts = m.m["tokens"], m.size, m.m["texts"]
        for b in batches(it, "text", 4 << 20):
            t = lower(Texts(b.column("text")))
            ids, counts = m.ids(t.hashes)
            columns, bounds = grams(t, ids, size, m.order)
            count = np.full(bounds[-1], texts, np.int64)
            count[columns[-1] != size - 1] = counts
            sums = lambda x, bounds=bounds: np.add.reduceat(x, bounds[:-1])
            base = sums(np.log10((count + 1) / (total + size + 1)))
            known = sums((count > 0).astype(np.int64))
            score = sums(m.log10(columns)) if bounds[-1] else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.diff(bounds)), pa.array(known), pa.array(np.full(t.n, total, np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scored(df: DataFrame, path: str, parts: tuple) -> DataFrame:
    """df(doc_id, held_out, text) scored by the model."""
    return df.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_score(path, parts), SCORES)


def folded(df: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """df with held_out by the crc32 of the key as text."""
    return df.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % folds == held_out)


def train_and_score(df: DataFrame, order: int = ORDER) -> DataFrame:
    """Learns from the documents that aren't held out, scores all."""
    d = folded(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return scored(d, *train(d.where("NOT held_out"), order=order))


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of the model and of the unigram base, by fold."""
    return scores.groupBy("held_out").agg(*[F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens")).alias(a) for c, a in (("score", "perplexity"), ("base_score", "base_perplexity"))])
