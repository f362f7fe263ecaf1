"""Incremental extraction: only books that the cache doesn't hold, in batch or as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stacklight.functions.providers import ExtractorConfig, extract
from stacklight.functions.text import is_blank
from stacklight.session import dropped, written
from stacklight.sources.readers import read_extractions
from stacklight.sources.writers import append_extractions

#: Places of the hash by which books are dealt to steps.
SPAN = 1 << 40


def pending(books: DataFrame, cache: DataFrame) -> DataFrame:
    """Books whose isbn the cache doesn't hold."""
    return books.join(cache.select("isbn13"), "isbn13", "left_anti")


def extend_cache(spark: SparkSession, books: DataFrame, path: str, provider: Callable[[str, str], dict | None], config: ExtractorConfig = ExtractorConfig()) -> DataFrame:
    """Extracts what is pending, and returns the whole cache. Failures aren't kept, so they're tried again next time.

    The cache grows by steps, each committed by itself: a job that fails costs the calls of its last step. The first is of save_every books a core; while steps take
    less than step_seconds they double, so that fast models don't spend their time on commits, and a slow model's steps stay as they are. Books lie in order of a hash
    in each file, so a step reads its own pages only."""
    asked = books.where(~is_blank(F.col("description")))
    left = pending(asked, read_extractions(spark, path)).dropDuplicates(["isbn13"]).select("isbn13", "title", "description")
    left = written(left.withColumn("place", F.pmod(F.xxhash64("isbn13"), F.lit(SPAN))).sortWithinPartitions("place"), "pending")
    n, least = left.count(), config.save_every * spark.sparkContext.defaultParallelism
    size, start = least, 0
    while start < SPAN:
        end = min(SPAN, start - (-SPAN * size // max(n, 1)))
        began = time.monotonic()
        append_extractions(extract(left.where((F.col("place") >= start) & (F.col("place") < end)), provider, config), path)
        took = time.monotonic() - began
        if took < config.step_seconds:
            size *= 2
        elif took > 2 * config.step_seconds:
            size = max(least, size // 2)
        start = end
    dropped(left)
    return read_extractions(spark, path)


def stream_cache(books: DataFrame, path: str, checkpoint: str, provider: Callable[[str, str], dict | None]) -> StreamingQuery:
    """The same for a stream of books: each micro-batch extracts what the cache still lacks."""
    return books.writeStream.foreachBatch(lambda batch, _: extend_cache(batch.sparkSession, batch, path, provider)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
