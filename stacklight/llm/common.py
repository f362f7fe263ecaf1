"""Word and n-gram hashing over Arrow buffers, and helpers that the operators share.

Words are `[^\\x20\\x09-\\x0D]+` everywhere, taken from the UTF-8 bytes (all six separators are one byte long).
Hashes have 64 bits and depend on the bytes alone, so every worker gets the same ones."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
PIECE = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_byte = _rng.integers(1, 1 << 63, 256, dtype=U) | U(1)
_BASE = 0x9E3779B97F4A7C15 ^ 0x2545F4914F6CDD1C | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(which: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1), U(_BASE if which == "up" else _INVERSE))
        steps[0] = 1
        made = np.multiply.accumulate(steps)
        if n > 4 * PIECE:
            return made  # one very long word: not worth keeping
        _powers[which] = have = made
    return have


def word_spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which words start and end. breaks: positions at which a new text starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_space[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    b = breaks[breaks < n]
    before[b] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[b[b > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, the spans being in order and apart."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = int(ends[j - 1])
        part = _byte[data[lo:hi]]
        part *= _power("up", hi - lo)[: hi - lo]
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        h = (sums[e] - sums[s]) * _power("down", hi - lo)[s]
        out[i:j] = mix(h)
        i = j
    return out


class Texts:
    """The words of a batch of texts. bounds[i]:bounds[i + 1] are the words of text i; null texts have none."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary())
        self.n = len(column)
        if self.n == 0:
            offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        else:
            if column.null_count:
                column = column.fill_null(b"")
            _, off, buf = column.buffers()
            offsets = np.frombuffer(off, np.int64, self.n + 1, column.offset * 8)
            base = int(offsets[0])
            self.data = np.frombuffer(buf, np.uint8, int(offsets[-1]) - base, base) if buf is not None and offsets[-1] > base else np.zeros(0, np.uint8)
            offsets = offsets - base
        self.offsets = offsets
        self.starts, self.ends = word_spans(self.data, offsets[:-1])
        self.bounds = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values; entry p is that of h[p:p + k]. Runs are built by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    a = 0xD6E8FEB86659FD93
    power, have, width = h, None, 1
    done = 0
    rest = k
    while True:
        if rest & 1:
            have = power if have is None else _joined(have, done, power, width, a)
            done += width
        rest >>= 1
        if not rest:
            break
        power = _joined(power, width, power, width, a)
        width *= 2
    return mix(have[:n])


def _joined(left: np.ndarray, wl: int, right: np.ndarray, wr: int, a: int) -> np.ndarray:
    """left[p] covers wl values and right[p + wl] covers the wr after them."""
    n = min(len(left), len(right) - wl)
    return left[:n] * U(pow(a, wr, 1 << 64)) + right[wl : wl + n]


def valid_starts(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over n positions: does a run of k words from here stay inside its text?"""
    ok = np.zeros(n + 1, np.int64)
    lo, hi = bounds[:-1], np.maximum(bounds[1:] - k + 1, bounds[:-1])
    some = hi > lo
    np.add.at(ok, lo[some], 1)
    np.add.at(ok, hi[some], -1)
    return np.cumsum(ok[:-1]) > 0


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text each (a longer text is a part of its own)."""
    n = batch.num_rows
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(size)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def give_back() -> None:
    """Hands memory that is free in this process back to the system. Workers serve one stage after another, and what each leaves behind piles up beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def batches(it: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of all batches; free memory is given back after each."""
    for b in it:
        if b.num_rows:
            for part in slices(b, column, most):
                yield part
                give_back()


#: A key with at least this share of all rows is hot, so there are at most as many hot keys as its inverse; their rows are spread over so many parts.
HOT_SHARE, HOT_LEAST, SALTS = 1 / 2000, 1000, 64


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, spread: list[str]) -> DataFrame:
    """Inner join of big with small, which has one row for each key and in weight the number of rows of big with that key.

    Rows of a hot key are spread over SALTS parts by a hash of the spread columns, and its row of small is repeated. The driver gets hashes of the
    hot keys: 1 / HOT_SHARE at most, whatever the size of the tables. small is read twice, so it should be a table."""
    total = small.agg(F.sum(weight).alias("t")).first().t or 0
    hashed = F.xxhash64(*keys)
    hot = [r.h for r in small.where(F.col(weight) >= max(total * HOT_SHARE, HOT_LEAST)).select(hashed.alias("h")).collect()]
    if not hot:
        return big.join(small, keys)
    right = small.withColumn("__salt", F.explode(F.when(hashed.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    left = big.withColumn("__salt", F.when(hashed.isin(hot), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0))
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def input_parts(df: DataFrame, bytes_a_part: int = 256 << 20) -> int:
    """Shuffle partitions for the rows of df: the session's number, or more if the files that it reads would make parts larger than that.

    The size is the plan's own statistic (that of the files), taken four times because columns are compressed; where it isn't known the session's number stands."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * size // bytes_a_part) if size < 1 << 60 else 0)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path in it: plain and file: paths, and stores that Arrow has a client for (hdfs, s3, gs)."""
    for head in ("file://", "file:"):
        if path.startswith(head):
            return fs.LocalFileSystem(), "/" + path[len(head) :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    for alias in ("s3a://", "s3n://"):
        if path.startswith(alias):
            path = "s3://" + path[len(alias) :]
    return fs.FileSystem.from_uri(path)


def renamed(files: fs.FileSystem, temporary: str, name: str) -> None:
    """Gives a whole file its name. Where the folder is mounted its bytes are on the disk before."""
    if isinstance(files, fs.LocalFileSystem):
        with open(temporary, "rb") as f:
            os.fsync(f.fileno())
    files.move(temporary, name)


def mapped(files: fs.FileSystem, path: str) -> np.ndarray:
    """An array file, memory-mapped: where it lies, or in a store by a copy that this worker keeps as long as it lives."""
    if isinstance(files, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with tempfile.TemporaryFile() as f:  # nameless; the map holds it
        with files.open_input_stream(path) as g:
            while part := g.read(16 << 20):
                f.write(part)
        f.seek(0)
        version = np.lib.format.read_magic(f)
        shape, _, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        return np.memmap(f, dtype, "r", f.tell(), shape) if shape[0] else np.zeros(shape, dtype)
