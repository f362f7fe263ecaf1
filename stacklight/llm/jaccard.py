"""N-gram Jaccard self-join with Bayesian candidate pruning (after Satuluri & Parthasarathy 2012).

1. Texts with the same words form a copy class with a number of its own, so thousands of copies cost one row of later steps. A class is known by 128 bits of its
   words; keys are labels only, so rows that share a key but not the text are in classes of their own.
2. MinHash signatures (128 values) of the shingles of each class are cut into 32 bands of 4. Classes that share a band are candidates. At a similarity of 0.8 a pair
   misses all bands with probability (1 - 0.8 ** 4) ** 32 < 5e-8. Buckets with the same members are one.
3. Pairs within a bucket compare their MinHash values (8 bits each) 16 at a time; after each round a pair is dropped when the posterior probability that its
   similarity reaches the threshold, given the matches so far, is below TOLERANCE. Small buckets share tasks; a large one is cut into blocks, and each pair of
   blocks is one piece of work. Only signatures move, and only a spanning forest of the survivors of each piece becomes rows: no task holds a whole bucket
   and pairs are never rows. Texts that share boilerplate but little else end here.
4. Connected components of the survivors are groups of candidates. A group is cut into blocks of bounded size; in each pair of blocks, pairs that
   pass the same pruning are verified on their whole sets of shingle hashes. Each class gets the number of documents it links to, and each block
   pair a spanning forest of its links.
5. Components of those forests are the classes of near-duplicates.

Work on a group grows with the square of its different texts, as the number of links does; a row of a group of more than one block is copied with its shingles
once for each block, which is small beside comparing it with that block's texts.

Texts of 1 to 4 words have one shingle, all their words. Null and empty texts have none: they are in a class of their own with no links. Equal texts count as
links of each other. Null keys come last: a class takes its name from them only if it has no other, and is null then. Rows that repeat a key and a text are copies.
Very long texts are one row. An empty table gives an empty result. Extra columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import Texts, batches, gram_hashes, mix, salted_join, valid_starts
from stacklight.operators.components import connected_components
from stacklight.session import dropped, written

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BANDS, ROUND = 128, 32, 16
TOLERANCE = 1e-6
#: Rows of a bucket's block, and rows of small buckets that share a task.
BUCKET_ROWS, BIN_ROWS = 512, 2_000
#: Documents, and shingles, of a group's block.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 400_000
#: Pairs that are compared at a time.
PAIRS = 200_000

_rng = np.random.Generator(np.random.PCG64(1806))
_MULTIPLY = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and where each text's begin (one more at the end)."""
    h, k = t.hashes, SHINGLE
    g = gram_hashes(h, k)
    ok = valid_starts(t.bounds, k, len(g)) if len(g) else np.zeros(0, bool)
    n = t.counts
    made = np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    made[short] = 1
    ends = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(ends[-1], np.uint64)
    mask = np.ones(len(out), bool)
    mask[ends[short]] = False
    out[mask] = g[ok]
    for i in short:
        w = h[t.bounds[i] : t.bounds[i + 1]]
        out[ends[i]] = gram_hashes(w, len(w))[0]
    return out, ends


def signatures(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each text; texts without shingles get the largest values."""
    n = len(ends) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(ends))
    x = (s >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(some):  # parts that stay in the cache
        j = max(i + 1, int(np.searchsorted(ends[some + 1], ends[some[i]] + 60_000, "right")))
        lo, hi = ends[some[i]], ends[some[j - 1] + 1]
        part, at = x[lo:hi], (ends[some[i:j]] - lo).astype(np.intp)
        for k in range(HASHES):
            out[some[i:j], k] = np.minimum.reduceat((part ^ _FLIP[k]) * _MULTIPLY[k], at)
        i = j
    return out


SKETCH = "doc_id long, fp long, key1 long, key2 long, n_shingles long, bands array<long>, sig binary"


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash for each band of each signature."""
    wide = sig.reshape(len(sig), BANDS, HASHES // BANDS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), wide.shape[:2])
    for k in range(wide.shape[2]):
        out = mix(out + wide[:, :, k])
    return out


def _sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, "text", 4 << 20):
        t = Texts(b.column("text"))
        s, ends = shingles(t)
        sig = signatures(s, ends)
        h = t.hashes
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(t.bounds[:-1], t.counts).astype(np.uint64)
        keys = []
        for salt in (0x1B873593, 0x38495AB5):  # of the words in their order
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + mix(place + np.uint64(salt))))])
            keys.append(mix(sums[t.bounds[1:]] - sums[t.bounds[:-1]] + t.counts.astype(np.uint64)).view(np.int64))
        hashed = pa.ListArray.from_arrays(np.arange(0, t.n * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands(sig).reshape(-1).view(np.int64)))
        low = pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fp"), pa.array(keys[0]), pa.array(keys[1]), pa.array(np.diff(ends)), hashed, low], ["doc_id", "fp", "key1", "key2", "n_shingles", "bands", "sig"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, "text"):
        s, ends = shingles(Texts(b.column("text")))
        sets = [np.unique(s[lo:hi]).tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("cid", "grp", "copies", "sig")] + [pa.array(sets, pa.binary()), pa.array([len(x) // 8 for x in sets], pa.int64())], ["cid", "grp", "copies", "sig", "shingles", "n"])


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each round: fewer matches than this leave a posterior P(similarity >= threshold) below the tolerance.

    The prior is uniform; values of 8 bits match with probability x + (1 - x) / 256 at similarity x."""
    x = (np.arange(20_000) + 0.5) / 20_000
    p = x + (1 - x) / 256
    out = []
    for n in range(ROUND, HASHES + 1, ROUND):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p) + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1)
            mass = np.exp(log)
            if mass[x >= threshold].sum() >= tolerance * mass.sum():
                out.append(m)
                break
    return tuple(out)


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows (a, b), those that no round of the comparison drops."""
    out_a, out_b = [], []
    for k in range(0, len(a), PAIRS):
        i, j, have = a[k : k + PAIRS], b[k : k + PAIRS], 0
        for r, need in enumerate(least_matches(threshold, tolerance)):
            part = slice(r * ROUND, (r + 1) * ROUND)
            have = have + (sig[i, part] == sig[j, part]).sum(axis=1, dtype=np.int32)
            stay = have >= need
            i, j, have = i[stay], j[stay], have[stay]
        out_a.append(i)
        out_b.append(j)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, int), np.zeros(0, int))


def linked(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows whose sets have at least that similarity: within left, or between left and right."""
    least = least_matches(threshold, tolerance)
    size = np.asarray([len(s) for s in sets])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, int))
    ends = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(ids), bool)
    out_i, out_j = [], []
    for n, i in enumerate(left):
        others = left[n + 1 :] if right is None else right
        # sets of very different sizes can't be similar
        others = others[(size[others] >= threshold * size[i]) & (threshold * size[others] <= size[i]) & (size[others] > 0)]
        have = np.zeros(len(others), np.int32)
        for r, need in enumerate(least):
            if not len(others):
                break
            part = slice(r * ROUND, (r + 1) * ROUND)
            have = have + (sig[others, part] == sig[i, part]).sum(axis=1, dtype=np.int32)
            stay = have >= need
            others, have = others[stay], have[stay]
        if not len(others):
            continue
        own = flat[ends[i] : ends[i + 1]]
        mark[own] = True
        n_each = size[others]
        index = np.repeat(ends[others] - (np.cumsum(n_each) - n_each), n_each) + np.arange(n_each.sum())
        common = np.add.reduceat(mark[flat[index]].astype(np.int64), np.cumsum(n_each) - n_each)
        mark[own] = False
        ok = common >= threshold * (size[i] + n_each - common) - 1e-9
        out_i.append(np.full(int(ok.sum()), i))
        out_j.append(others[ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest: enough of the pairs to keep rows connected."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
    return out


def _alike(threshold: float, tolerance: float):
    """Of (work, bucket, n, cid, sig, side), a spanning forest (src, dst) of the pairs of each bucket that pass the pruning."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "side", "cid"], kind="stable")
        sig = np.frombuffer(b"".join(rows.sig), np.uint8).reshape(len(rows), HASHES)
        cid, side, bucket = rows.cid.to_numpy(), rows.side.to_numpy(), rows.bucket.to_numpy()
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(at, len(rows)))
        found = []
        if len(at) == 1 and side.max() == 1:  # two blocks of a large bucket
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for i in left:
                found.append(survivors(sig, np.full(len(right), i), right, threshold, tolerance))
        else:
            for n in np.unique(size[size > 1]):
                first = at[size == n]
                i, j = np.triu_indices(n, 1)
                step = max(1, PAIRS // len(i))
                for k in range(0, len(first), step):
                    base = first[k : k + step, None]
                    found.append(survivors(sig, (base + i).reshape(-1), (base + j).reshape(-1), threshold, tolerance))
        i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, int) for k in (0, 1))
        numbers, row = np.unique(cid, return_inverse=True)
        pairs = np.unique(np.stack([row[i], row[j]], 1), axis=0)
        edges = forest(pairs[:, 0], pairs[:, 1], len(numbers))
        return pd.DataFrame({"src": [numbers[x] for x, _ in edges], "dst": [numbers[y] for _, y in edges]}, dtype="int64")

    return run


def _verified(threshold: float, tolerance: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.groupby("grp", sort=False):
            sig = np.stack([np.frombuffer(x, np.uint8) for x in g.sig])
            sets = [np.frombuffer(x, np.uint64) for x in g.shingles]
            side, copies, ids = g.side.to_numpy(), g.copies.to_numpy(), g.cid.to_numpy()
            both = bool(side.max())
            i, j = linked(sig, sets, np.flatnonzero(side == 0), np.flatnonzero(side == 1) if both else None, threshold, tolerance)
            links = np.zeros(len(g), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            some = np.flatnonzero(links)
            out.append(pd.DataFrame({"cid": ids[some], "links": links[some], "other": ids[some]}))
            edges = forest(i, j, len(g))
            out.append(pd.DataFrame({"cid": [ids[a] for a, _ in edges], "links": 0, "other": [ids[b] for _, b in edges]}))
        out = [x for x in out if len(x)]
        return pd.concat(out).astype("int64") if out else pd.DataFrame({"cid": [], "links": [], "other": []}, dtype="int64")

    return run


def candidate_groups(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(cid, grp) of the classes with a partner that shares a band and passes the pruning; classes: (cid, bands, sig)."""
    banded = classes.select("cid", F.explode("bands").alias("bucket"))
    sets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("h")).where("lo < hi")
    kept = written(sets.groupBy("n", "lo", "hi", "h").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "lo", "hi"), "buckets")
    # a bucket of two is known by its ends; larger ones meet their members again
    two = kept.where("n = 2").select("bucket", "n", F.explode(F.array("lo", "hi")).alias("cid"))
    more = salted_join(banded, kept.where("n > 2").select("bucket", "n"), ["bucket"], "n", ["cid"]).select("bucket", "n", "cid")
    x = two.unionByName(more).join(classes.select("cid", "sig"), "cid").withColumn("blocks", F.ceil(F.col("n") / BUCKET_ROWS))
    small = kept.where(F.col("n") <= BUCKET_ROWS).agg(F.sum("n").alias("rows")).first().rows or 0
    work = F.when(F.col("blocks") == 1, F.xxhash64(F.lit(0), F.pmod(F.xxhash64("bucket"), F.lit(max(1, -(-small // BIN_ROWS)))))).otherwise(F.xxhash64(F.lit(1), "bucket", "lo", "hi"))
    found = _paired(x, "cid").withColumn("work", work).select("work", "bucket", "n", "cid", "sig", "side")
    links = written(found.groupBy("work").applyInPandas(_alike(threshold, tolerance), "src long, dst long").distinct(), "links")
    groups = written(connected_components(links), "groups").select(F.col("node").alias("cid"), F.col("component").alias("grp"))
    dropped(kept, links)
    return groups


def _paired(x: DataFrame, key: str) -> DataFrame:
    """A row for each pair of blocks that a row takes part in: (lo, hi, side)."""
    x = x.withColumn("own", F.pmod(F.xxhash64(F.lit(2), key), F.col("blocks")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return x.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0))


def decided(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, fp, class_id, class_fp, n_links, copy_id) for each row; fp: hash of the text, class_fp: that of the document that names the class."""
    d = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("fp"), F.col(f"`{text}`").alias("text"))
    sketch = written(d.mapInArrow(_sketch, SKETCH), "sketch")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    classes = sketch.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min(name).alias("name"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # numbers stand once they're written
    members = candidate_groups(classes, threshold, tolerance).join(classes, "cid").select("cid", "grp", "copies", "sig", F.col("name.doc_id").alias("m_id"), F.col("name.fp").alias("m_fp"))
    texts = d.join(members, d.doc_id.eqNullSafe(F.col("m_id")) & (d.fp == F.col("m_fp"))).select("cid", "grp", "copies", "sig", "text")
    sets = texts.mapInArrow(_sets, "cid long, grp long, copies long, sig binary, shingles binary, n long")
    sets = written(sets.dropDuplicates(["cid"]), "sets")  # rows that repeat a key and a text
    sums = sets.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    n_blocks = F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES))
    sums = written(sums.withColumn("blocks", F.least("members", n_blocks)), "group-sizes")
    small = sums.where("blocks = 1").agg(F.sum("members").alias("m"), F.sum("total").alias("t")).first()
    bins = max(1, -(-(small.m or 0) // BLOCK_ROWS), -(-(small.t or 0) // BLOCK_SHINGLES))
    x = _paired(salted_join(sets, sums.select("grp", "blocks", "members"), ["grp"], "members", ["cid"]), "cid")
    # small groups share bins, so that a call handles about a block's worth of rows; blocks of a large group meet in pairs
    work = F.when(F.col("blocks") == 1, F.xxhash64(F.lit(0), F.pmod(F.xxhash64("grp"), F.lit(bins)))).otherwise(F.xxhash64(F.lit(1), "grp", "lo", "hi"))
    x = x.withColumn("work", work).select("work", "grp", "cid", "copies", "sig", "shingles", "side")
    found = written(x.groupBy("work").applyInPandas(_verified(threshold, tolerance), "cid long, links long, other long"), "found")
    joined = connected_components(found.where("cid <> other").select(F.col("cid").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("node", "cid")
    joined = written(joined, "components")
    names = classes.select("cid", "name").join(joined, "cid").groupBy("component").agg(F.min("name").alias("leader"))
    leaders = joined.join(names, "component").select("cid", "leader")
    totals = found.where("cid = other").groupBy("cid").agg(F.sum("links").alias("links"))
    info = classes.select("cid", "key1", "key2", "name", "copies").join(totals, "cid", "left").join(leaders, "cid", "left")
    leader = F.coalesce("leader", "name")
    info = info.select("key1", "key2", "copies", F.col("name.doc_id").alias("copy_id"), leader["doc_id"].alias("class_id"), leader["fp"].alias("class_fp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    info = written(info, "classes-decided")
    rows = sketch.select("doc_id", "fp", "key1", "key2", "n_shingles")
    columns = ["doc_id", "fp", "class_id", "class_fp", "n_links", "copy_id"]
    alone = rows.where("n_shingles = 0").select("doc_id", "fp", F.col("doc_id").alias("class_id"), F.col("fp").alias("class_fp"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"))
    out = written(salted_join(rows.where("n_shingles > 0"), info, ["key1", "key2"], "copies", ["doc_id", "fp"]).select(*columns).unionByName(alone), "decided")
    dropped(sketch, classes, sets, sums, found, joined, info)
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, n_links, copy_id) for each row.

    class_id: the least doc_id of its component under similarity >= threshold; n_links: other documents with that similarity;
    copy_id: the least doc_id with the same words."""
    return decided(df, key, text, **options).select("doc_id", "class_id", "n_links", "copy_id")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each class one row of df: that with the least key (nulls last), then the least hash of its text. Rows without words stay.

    Of rows that repeat that key and text one stays; only those few are grouped, so the other texts aren't moved."""
    found = decided(df, key, text, **options)
    lost = found.where(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("fp") == F.col("class_fp")))).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).distinct()
    x = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))
    same = lambda t: F.col("key").eqNullSafe(t["__id"]) & (F.col("hash") == t["__fp"])
    kept = x.join(lost, same(lost), "left_anti")
    again = found.join(lost, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")), "left_anti").where(F.col("n_links") > 0)
    again = written(again.groupBy(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-rows")
    if not again.isEmpty():
        kept = kept.join(again, same(again), "left_anti").unionByName(kept.join(again, same(again), "left_semi").dropDuplicates(["key", "hash"]))
    return kept.select("row.*")
