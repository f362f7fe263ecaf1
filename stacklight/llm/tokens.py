"""Token ids as Parquet list columns, in ascending key order.

Documents are range-partitioned by key and sorted, so text is shuffled once and the ids are written where they are made. A file holds
for each document its key, its place (shard, and ids before it in the shard), its number of ids and the list of ids. Ids are dictionary-encoded
with pages of a bounded size in row groups of a bounded size; Parquet's column and offset indexes let a reader take metadata
alone, or the ids of a key range, without touching other pages. Spark's writer commits through temporary names, so a lost
executor leaves no partial file.

Null texts are empty and get the end id alone. Null keys come first; equal keys are ordered by a hash of the text. An empty table
gives an empty result. Very long texts are one row, encoded word by word. Columns other than key and text aren't read."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm.common import batches, input_parts
from stacklight.session import work_path

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
#: Bytes of text that are split at a time.
SLICE_BYTES = 6 << 20
#: Cores whose ids a worker remembers, in each of two generations; forgetting changes no result.
REMEMBERED = 200_000
#: ASCII marks other than the apostrophe, which the tokenizer may take with the letters after it.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
SCHEMA = "doc_id long, shard int, local_start long, n_tokens int, ids array<int>"


# The normalizer and the pre-tokenizer of tokenizers whose ids of a text are those of its words, cut as below.
WORDWISE_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDWISE_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def wordwise(spec: dict) -> bool:
    """Does a tokenizer file, as JSON, work within white space and in small letters, with special tokens that hold no space and start with <|?"""
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    quiet = all(not spec.get(k) for k in ("truncation", "padding")) and not spec["model"].get("dropout")
    special = all(t["content"].startswith("<|") and len(t["content"].split()) == 1 and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens") or ())
    return quiet and special and spec.get("normalizer") == WORDWISE_NORMALIZER and splits[0] == WORDWISE_SPLIT and all(x.get("type") == "ByteLevel" and not x.get("use_regex", True) and not x.get("add_prefix_space", True) for x in splits[1:])


class Encoder:
    """Ids of whole texts.

    Where the tokenizer normalizes and splits within white space only, as its file is checked for, a text's ids are those of its words in turn. Arrow splits a batch into
    words, finds the distinct ones and cuts them into a core (in small ASCII letters) and the marks at its end, which are one
    piece for the tokenizer. Distinct cores are few: their ids are remembered, and only new ones go to the library. Other tokenizers get whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.wordwise = wordwise(json.load(f))
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian bytes."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_binary()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends)[: len(texts)]]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's end. No text may be null."""
        if not self.wordwise:
            found = self.tokenizer.encode_batch([x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()], add_special_tokens=False)
            return np.asarray([i for e in found for i in e.ids], "<i4"), np.cumsum([len(e.ids) for e in found], dtype=np.int64)
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).view(pa.large_string()))  # at \x20 and \x09-\x0D
        words = lists.flatten().dictionary_encode()
        cores, marks = (x.dictionary_encode() for x in _cut(words.dictionary))
        ids = self._ids([*cores.dictionary.cast(pa.large_binary()).to_pylist(), *marks.dictionary.cast(pa.large_binary()).to_pylist()])
        at = np.empty(2 * len(cores), np.int64)
        at[::2] = cores.indices
        at[1::2] = np.asarray(marks.indices) + len(cores.dictionary)
        two = _lists(ids).take(pa.array(at))
        of_word = pa.LargeListArray.from_arrays(np.asarray(two.offsets)[::2], two.values).take(words.indices)
        bounds = np.cumsum(np.asarray(pc.list_value_length(lists)))
        return np.asarray(of_word.values), np.asarray(of_word.offsets)[bounds]

    def _ids(self, keys: list[bytes]) -> list[bytes]:
        """Ids of cores and marks. A full memory is kept for one more generation."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {b"": b""}
        missing = set(keys).difference(self.known)
        again = missing.intersection(self.older)
        self.known.update([(c, self.older[c]) for c in again])
        self.known.update(self._library(sorted(missing.difference(again))))
        return [*map(self.known.__getitem__, keys)]

    def _library(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids by the library: words go in one call, and ids go back to words by the characters they come from."""
        out = {}
        for i in range(0, len(words), 400):
            texts = [w.decode("utf-8", "replace") for w in words[i : i + 400]]
            e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            at = np.searchsorted(starts, [a for a, _ in e.offsets], "right") - 1
            edges = np.searchsorted(at, np.arange(len(texts) + 1)) * 4
            ids = np.asarray(e.ids, "<u4").tobytes()
            out.update({w: ids[edges[k] : edges[k + 1]] for k, w in enumerate(words[i : i + 400])})
        return out


def _lists(ids: list[bytes]) -> pa.LargeListArray:
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.LargeListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _parts(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes."""
    _, offsets, data = words.buffers()
    return np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8), np.frombuffer(data or b"", np.uint8)


def _cut(words: pa.LargeStringArray) -> tuple[pa.Array, pa.Array]:
    """Cores, and the marks after them. Only marks after a small letter are cut off; words that may hold a special token stay as they are."""
    low = pc.ascii_lower(words)
    core = pc.ascii_rtrim(low, characters=MARKS)
    special = np.asarray(pc.match_substring(words, "<|"))
    (at, data), (core_at, core_data) = _parts(low), _parts(core)
    n = np.diff(core_at)
    core_data = np.concatenate([np.zeros(2, np.uint8), core_data])  # so that every word has two bytes before its end
    last, second = core_data[core_at[1:] + 1], core_data[core_at[1:]]
    letter = ((last >= 97) & (last <= 122)) | ((n > 1) & (second == 0xC3) & (last >= 0xA0) & (last != 0xB7))
    cut = (n > 0) & letter & ~special
    k = np.where(cut, np.diff(at) - n, 0)
    ends = np.concatenate([[0], np.cumsum(k)])
    taken = data[np.arange(ends[-1]) + np.repeat(at[:-1] + n - ends[:-1], k)]
    marks = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(taken))
    whole = pc.if_else(pa.array(special), words, low) if special.any() else low
    return pc.if_else(pa.array(cut), core, whole), marks


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker: reading the vocabulary takes longer than encoding a few thousand texts."""
    return Encoder(path)


def _encoded(path: str, end_id: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start, shard = encoder(path), 0, TaskContext.get().partitionId()
        for b in batches(it, "text", SLICE_BYTES):
            ids, ends = known.encode_column(b.column("text").fill_null(""))
            flat = pa.array(np.insert(ids, ends, end_id))
            n = np.diff(ends, prepend=0) + 1
            before = start + np.cumsum(n) - n
            start += int(n.sum())
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            columns = [b.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(before), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "local_start", "n_tokens", "ids"])
            del ids, ends, flat, columns  # given back with the next slice

    return run


def write_tokens(df: DataFrame, tokenizer_path: str, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> str:
    """Writes the ids of all texts; returns the folder."""
    spark = df.sparkSession
    path = path or work_path(spark, "tokens")
    parts = input_parts(df)
    d = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    d = d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    out = d.mapInArrow(_encoded(tokenizer_path, end_id), SCHEMA)
    options = {"compression": "zstd", "parquet.enable.dictionary": "true", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.page.row.count.limit": "20000"}
    out.write.options(**options).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of the files, with start: ids of all documents before. Only columns that are used are read.

    first, last: keys of a range; files, row groups and pages outside it are passed over by their statistics. Shards are as many as
    partitions; their totals come from the metadata columns alone."""
    files = spark.read.schema(SCHEMA).parquet(path)
    rows = files if first is None else files.where(F.col("doc_id") >= first)
    rows = rows if last is None else rows.where(F.col("doc_id") <= last)
    shards = files.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("n")).orderBy("shard").collect()
    bases, total = [], 0
    for s in shards:
        bases.append((s.shard, total))
        total += s.n
    base = spark.createDataFrame(bases, "shard int, base long")
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        lists = b.column("ids")
        flat = np.asarray(lists.flatten()).astype("<u4", copy=False)
        n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        ends = np.cumsum(n)
        crc = np.fromiter((zlib.crc32(flat[e - k : e]) for e, k in zip(ends, n, strict=True)), np.int64, len(n))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(n), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    return read_tokens(spark, path).select("doc_id", "start", "ids").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
