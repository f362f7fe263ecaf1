"""A quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

1. Tokens are runs of bytes of one class (small letters, capitals, digits, marks, others). Each token has a sparse ternary index vector made from its
   hash; the vector of a token is the sum of the index vectors of its neighbours, over all documents (Sahlgren 2005). Tokens
   share BUCKETS rows by hash, so a task's sums and the model have a fixed size however large the corpus is.
2. A document is the mean and the deviation of its tokens' vectors, with the log of its length and the share of distinct tokens.
3. A numpy network of two layers learns from a bounded sample of labelled rows (SAMPLE, the least hashes); a temperature is fitted
   to a part that it hasn't learned from (Guo et al. 2017).

Empty and null texts have a zero vector and a score like others. Null labels are left out; several labels of one document count by their mean. Without
labels of both kinds all scores are 0.5. Null keys fall into the fold of the key 'null'. Very long texts are pooled whole. Extra columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import Texts, batches, mix, span_hashes

BUCKETS, WIDTH, NONZERO, REACH = 1 << 14, 32, 2, 2
#: Labelled rows that the network learns from, at most.
SAMPLE = 8000
FOLDS, HELD_OUT = 3, 1
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 400, 0.01, 1e-3, 11
_CHUNKS = 16

_class = np.full(256, 4, np.uint8)
_class[[0x20, *range(0x09, 0x0E)]] = 0
_class[97:123], _class[65:91], _class[48:58], _class[128:] = 1, 2, 3, 5


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of one class, and where each text's begin."""
    kind = _class[t.data]
    if not len(kind):
        return np.zeros(0, np.uint64), np.zeros(t.n + 1, np.int64)
    kind = np.where(kind == 5, 1, kind)  # letters beyond ASCII go with the small ones
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[t.offsets[:-1][t.offsets[:-1] < len(kind)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(kind))
    inside = kind[start] > 0
    start, end = start[inside], end[inside]
    return span_hashes(t.data, start, end), np.searchsorted(start, t.offsets)


def _random_index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * WIDTH, np.float64)  # of ones and minus ones: exact below 2 ** 53
    for b in batches(it, "text", 4 << 20):
        h, bounds = tokens(Texts(b.column("text")))
        if len(h) < 2:
            continue
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        row = (h % np.uint64(BUCKETS)).astype(np.int64) * WIDTH
        r = mix(h)
        places = [((r >> np.uint64(8 * k)) % np.uint64(WIDTH)).astype(np.int64) for k in range(NONZERO)]
        signs = [1.0 - 2.0 * ((r >> np.uint64(40 + k)) & np.uint64(1)).astype(np.float64) for k in range(NONZERO)]
        for away in range(1, REACH + 1):
            same = doc[away:] == doc[:-away]
            for k in range(NONZERO):
                total += np.bincount((row[:-away] + places[k][away:])[same], signs[k][away:][same], len(total))
                total += np.bincount((row[away:] + places[k][:-away])[same], signs[k][:-away][same], len(total))
    parts = total.reshape(_CHUNKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array([p.astype(np.int64).tobytes() for p in parts], pa.binary())], ["chunk", "sums"])


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BUCKETS * WIDTH // _CHUNKS, np.int64)  # whole numbers: the same whatever the partitions
    for x in rows.sums:
        total += np.frombuffer(x, np.int64)
    return pd.DataFrame({"chunk": [int(rows.chunk.iloc[0])], "sums": [total.tobytes()]})


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS unit vectors, learned from all texts. Sums are combined a chunk a task; their size is fixed."""
    d = df.select(F.col(f"`{text}`").alias("text"))
    sums = d.mapInArrow(_random_index, "chunk int, sums binary").groupBy("chunk").applyInPandas(_added, "chunk int, sums binary").collect()
    out = np.zeros((_CHUNKS, BUCKETS * WIDTH // _CHUNKS), np.float64)
    for r in sums:
        out[r.chunk] = np.frombuffer(bytes(r.sums), np.int64)
    out = out.reshape(BUCKETS, WIDTH)
    out /= max(1.0, np.abs(out).max())
    out = out.astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9).astype(np.float32)


def pooled(t: Texts, vectors: np.ndarray) -> np.ndarray:
    """The features of each text."""
    h, bounds = tokens(t)
    n = np.diff(bounds)
    out = np.zeros((t.n, 2 * WIDTH + 2), np.float32)
    row = (h % np.uint64(BUCKETS)).astype(np.int64)
    some = np.flatnonzero(n)
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(bounds[some + 1], bounds[some[i]] + 20_000, "right")))
        docs = some[i:j]
        lo, hi = bounds[docs[0]], bounds[docs[-1] + 1]
        v = vectors[row[lo:hi]]
        at = bounds[docs] - lo
        count = n[docs][:, None].astype(np.float32)
        mean = np.add.reduceat(v, at, axis=0) / count
        square = np.add.reduceat(v * v, at, axis=0) / count
        out[docs, :WIDTH] = mean
        out[docs, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
        i = j
    doc = np.repeat(np.arange(t.n, dtype=np.uint64), n)
    # distinct tokens of each text: sorted within the text by one sort over (text, hash)
    order = np.lexsort((h, doc)) if len(h) else np.zeros(0, int)
    hs, ds = h[order], doc[order]
    fresh = np.ones(len(hs), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    kinds = np.bincount(ds.astype(np.int64)[fresh], minlength=t.n)
    out[:, -2] = np.log1p(n)
    out[:, -1] = kinds / np.maximum(n, 1)
    return out


class Network:
    """tanh layer, then a logit; scores are its sigmoid at a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        r = np.random.Generator(np.random.PCG64(SEED))
        self.constant = 0.5 if len(set(y.tolist())) < 2 else None
        self.temperature = 1.0
        if self.constant is not None:
            return
        order = r.permutation(len(y))
        cut = max(1, len(y) // 5)
        fit, rest = order[cut:], order[:cut]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        d = z.shape[1]
        p = [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        a, b = z[fit].astype(np.float64), y[fit].astype(np.float64)
        for step in range(1, EPOCHS + 1):
            hidden = np.tanh(a @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - b) / len(b)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            grads = [a.T @ back + DECAY * p[0], back.sum(0), hidden.T @ error + DECAY * p[2], np.asarray([error.sum()])]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        logit, target = self.logit(x[rest]), y[rest]
        loss = lambda t: np.mean(np.logaddexp(0, np.where(target == 1, -1, 1) * logit / t))
        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fold(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """A network from labelled documents that aren't held out."""
    y = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold("doc_id") != HELD_OUT).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the bound that lets it be broadcast
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            x = pooled(Texts(b.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    # of rows that repeat a key one is taken, so what is collected is bounded by the sample
    found = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").mapInArrow(features, "doc_id long, y int, x binary")
    got = found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.stack([np.frombuffer(r, np.float32) for r in got.x]) if len(got) else np.zeros((0, 2 * WIDTH + 2), np.float32)
    return Network(x, got.y.to_numpy())


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = word_vectors(d)
    shared = d.sparkSession.sparkContext.broadcast((vectors, learn(d, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), vectors, sample)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, network = shared.value
        for b in batches(it, "text"):
            s = network.score(pooled(Texts(b.column("text")), v)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return d.withColumn("held_out", fold("doc_id") == HELD_OUT).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
