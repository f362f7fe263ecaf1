"""Exact vector search: cosine similarity in the JVM, top-k as TakeOrderedAndProject, similar pairs by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.config import DEFAULTS
from stacklight.ontology import TONES
from stacklight.session import measured, written

#: Pairs of blocks that a row is dealt to, before blocks reach BLOCK_NUMBERS numbers; rows on each side of one product.
DEALT, BLOCK_NUMBERS, TILE = 12, 1 << 22, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; null if either is null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).when(norms == 0, F.lit(0.0))


def knn(vectors: DataFrame, query: DataFrame, k: int, key: str = "isbn13") -> DataFrame:
    """(key, similarity): the k nearest to the one row of query(q_embedding). Each task keeps k rows; nothing else moves."""
    scored = vectors.where("embedding IS NOT NULL").crossJoin(F.broadcast(query.limit(1)))
    return scored.select(key, cosine(F.col("embedding"), F.col("q_embedding")).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def vector_search(books: DataFrame, query: DataFrame, category: str | None = "All", tone: str | None = "All", initial_top_k: int = DEFAULTS.initial_top_k, final_top_k: int = DEFAULTS.final_top_k, rank_mode: str = "source") -> DataFrame:
    """The books nearest to the query, cut after the category filter, then sorted by tone.

    rank_mode 'source' cuts in the order of the table, 'similarity' by nearness. The filter stays above the first cut: fewer than final_top_k rows may come."""
    hits = knn(books, query, initial_top_k)
    found = books.join(F.broadcast(hits), "isbn13")  # at most initial_top_k rows
    if category not in (None, "All"):
        found = found.where(F.col("simple_categories") == category)
    first = [F.col("src_ord")] if rank_mode == "source" else [F.desc("similarity"), F.col("isbn13")]
    found = found.orderBy(*first).limit(final_top_k)
    return found.orderBy(F.desc_nulls_last(TONES[tone]), "src_ord") if tone in TONES else found


def all_hits(books: DataFrame, query: DataFrame, k: int = DEFAULTS.initial_top_k) -> DataFrame:
    return books.join(F.broadcast(knn(books, query, k).select("isbn13")), "isbn13", "left_semi")


def _blocks(n: Column, block: int, width: int) -> Column:
    """How many blocks n rows of so many numbers make: DEALT at most, so what is shuffled grows as the rows do, until a block would hold more than BLOCK_NUMBERS."""
    return F.least(F.ceil(n / block), F.greatest(F.lit(DEALT), F.ceil(n / max(block, BLOCK_NUMBERS // max(width, 1)))))


def _units(rows: pa.Table) -> np.ndarray:
    """The vectors at length 1; zero vectors stay zero."""
    v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["embedding"].chunks]).astype(np.float64).reshape(rows.num_rows, -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _tiles(rows: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity), a tile at a time, of the pairs of a block, or of two, that reach the threshold. Products are taken in single precision with room for its error, and what is left in double."""
    v, side = _units(rows), rows["right"].to_numpy()
    short = v.astype(np.float32)
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    same = not len(right) and rows["lo"][0] == rows["hi"][0]
    if same:
        right = left
    near = np.float32(threshold - 1e-6 - 2.5e-7 * v.shape[1])
    for x in range(0, len(left), TILE):
        p = left[x : x + TILE]
        for y in range(x if same else 0, len(right), TILE):
            q = right[y : y + TILE]
            i, j = np.divmod(np.flatnonzero(short[p] @ short[q].T >= near), len(q))
            if same and x == y:
                i, j = i[i < j], j[i < j]
            if len(i) > p.size * q.size // 32:
                s = (v[p] @ v[q].T)[i, j]
            else:
                s = np.einsum("ij,ij->i", v[p[i]], v[q[j]])
            if (ok := s >= threshold - 1e-12).any():
                yield p[i[ok]], q[j[ok]], s[ok]


def _found_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        ids, ords = rows["id"].combine_chunks(), rows["ord"].to_numpy()
        names = ids.to_numpy(zero_copy_only=False)
        for a, b, s in _tiles(rows, threshold):
            swap = ords[a] > ords[b]
            tie = np.flatnonzero(ords[a] == ords[b])
            swap[tie] = names[a[tie]] > names[b[tie]]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s)], ["a", "b", "similarity"])

    return run


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least place of each class) once the places a and b are linked."""
    a, b = label[a], label[b]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
        label, a, b = root[label], root[a], root[b]
    return label


def _found_links(threshold: float):
    """Of each class of a pair of blocks, a link from its first row to each other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        ids, label = rows["id"].combine_chunks(), np.arange(rows.num_rows)
        some, n = [], 0
        for a, b, _ in _tiles(rows, threshold):
            some.append((a, b))
            n += len(a)
            if n > TILE * TILE:
                label, some, n = _joined(label, *map(np.concatenate, zip(*some, strict=True))), [], 0
        if some:
            label = _joined(label, *map(np.concatenate, zip(*some, strict=True)))
        b = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(label[b])), ids.take(pa.array(b))], ["a", "b"])

    return run


def _tasks(n: int, block: int) -> int:
    """Partitions for the pairs of blocks of n rows, so that a task has few of them however little they are to shuffle."""
    return min(DEALT * (DEALT + 1) // 2, (n // block + 1) ** 2)


def _blocked(x: DataFrame, keys: list[str], run, schema: str, tasks: int = 0) -> DataFrame:
    """What run finds in rows (keys, id, ord, embedding, blocks), each pair of blocks of a key on one task.

    Only what it finds become rows, a tile at a time, and memory is bounded by two blocks."""
    x = x.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x = x.select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("right"), "id", "ord", "embedding")
    x = x.repartition(tasks, *keys, "lo", "hi") if tasks else x
    return x.groupBy(*keys, "lo", "hi").applyInArrow(run, schema)


def sign_bands(bands: int, bits: int, seed: int = 5):
    """A column function: for each band a number made of the sides of bits seeded planes that a vector lies on."""

    @F.pandas_udf("array<long>")
    def run(vectors: pd.Series) -> pd.Series:
        v = np.stack([np.asarray(e, np.float64) for e in vectors])
        planes = np.random.Generator(np.random.PCG64(seed)).normal(size=(v.shape[1], bands * bits))
        side = (v @ planes >= 0).reshape(len(v), bands, bits)
        numbers = (side * (1 << np.arange(bits))).sum(axis=2) + np.arange(bands) * (1 << bits)
        return pd.Series(list(numbers.astype(np.int64)))

    return run


def bands_for(threshold: float, miss: float = 1e-3, bits: int = 12) -> int:
    """How many bands of so many signs miss a pair at the threshold with at most that probability: two vectors at an angle lie on one side of a plane with probability 1 - angle / pi."""
    agree = (1 - np.arccos(min(1.0, max(-1.0, threshold))) / np.pi) ** bits
    return int(np.ceil(np.log(miss) / np.log1p(-agree)))


def similar_pairs(vectors: DataFrame, threshold: float = DEFAULTS.dedup_threshold, key: str = "concept", order: str = "ord", block: int = 1024, lsh: bool = False, miss: float = 1e-3) -> DataFrame:
    """(a, b, similarity) of all pairs at least that similar, a before b in order.

    By default all pairs are compared: rows are dealt into blocks (of so many rows at least), so work is exact and quadratic, and spread evenly. lsh: only rows that share a band of signs are,
    in blocks of each band's bucket, and verified exactly; a pair at the threshold is missed with probability miss at most. That pays for high thresholds and millions of rows."""
    d = vectors.where("embedding IS NOT NULL").select(F.col(key).cast("string").alias("id"), F.col(order).cast("long").alias("ord"), "embedding")
    run, schema = _found_pairs(threshold), "a string, b string, similarity double"
    n, width = d.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not lsh:
        return _blocked(d.withColumn("blocks", _blocks(F.lit(n), block, width or 1)), [], run, schema, _tasks(n, block))
    banded = written(d.select("id", F.explode(sign_bands(bands_for(threshold, miss), 12)(F.col("embedding"))).alias("band")), "bands")
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", _blocks(F.col("n"), block, width or 1).alias("blocks"))
    x = banded.join(sizes, "band").join(d, "id")
    return _blocked(x, ["band"], run, schema).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def similar_links(vectors: DataFrame, threshold: float = DEFAULTS.dedup_threshold, key: str = "concept", block: int = 1024) -> DataFrame:
    """(a, b): links between similar rows whose connected components are those of all similar_pairs().

    Copies of a vector are linked to one of them, which alone is compared with others; of the pairs of two blocks those of a spanning forest are left, so there are DEALT links a row at most where pairs grow with the square."""
    length = dot(F.col("embedding"), F.col("embedding"))
    alike = (length > 0) & (length < float("inf")) & (threshold <= 1)  # else not even copies are similar, or all rows are
    d = vectors.where("embedding IS NOT NULL").select(F.col(key).cast("string").alias("id"), "embedding", F.coalesce(alike, F.lit(False)).alias("alike"))
    one = d.groupBy("embedding", F.when(~F.col("alike"), F.col("id")).alias("own")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    one, (n, rows, width) = measured(one, "vectors", F.count("*"), F.sum("copies"), F.max(F.size("embedding")))
    x = one.select("id", F.lit(0).cast("long").alias("ord"), "embedding", _blocks(F.lit(n), block, width or 1).alias("blocks"))
    links = _blocked(x, [], _found_links(threshold), "a string, b string", _tasks(n, block))
    if (rows or 0) > n:
        many = one.where("own IS NULL AND copies > 1").select("embedding", F.col("id").alias("a"))
        links = links.union(d.where("alike").join(many, "embedding").where("a <> id").select("a", F.col("id").alias("b")))
    return links
