"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

The mix is cut into blocks of equally many words.

1. Targets: water-filling, target = min(most * source_size, level * weight), the level found by Newton's steps on sums over the sources.
2. Seats: blocks go to sources by highest quotients target / (2 * seats + 1). How many seats have a quotient of q or more is a sum over sources, so the quotient of
   the last seat is bracketed by grids of sums; only the few seats inside the last bracket are ranked.
3. A source is a stream of its documents in a seeded order, cut into blocks, and the stream into shards of about SHARD_BLOCKS blocks. Each shard gets an integer
   quota of the source's seats. Shards of equal blocks have equal quotients, so highest quotients deal the seats evenly, and
   the quota of blocks [p, q) of n is floor(seats * q / n) - floor(seats * p / n): never more than most * (q - p).
4. Within a shard, its quota takes whole passes over its blocks, and the rest is a seeded arc of them.

All of this has a closed form in the position of a document in its stream, so no row stands for a block. Positions are sums on three levels (documents
in a bucket, buckets in a group, groups in a source), ranks of sources are counts of a range partitioning, and rows that repeat a document are one row with a
number of copies: no source, bucket or repeated document meets in one task.

A null source is a source of its own, the last. Null and empty texts have size 0 and are taken 0 times. Repeated rows are
separate documents. Sources of size 0 get nothing. An empty table gives an empty result. Columns of df stay, unless a result has the name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.rules import n_words
from stacklight.operators.ranges import cumulated
from stacklight.session import written

BLOCK_WORDS = 64
SHARD_BLOCKS = 4096
#: Documents of a bucket, and buckets of a group, about.
BUCKET_ROWS, GROUP_BUCKETS = 2000, 1000
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20
#: Divisors that one job tries, and seats that are few enough to be ranked.
GRID, FEW = 64, 1000


def numbered(df: DataFrame, *order: Column, name: str = "ord") -> DataFrame:
    """df, written, with the number of each row in that order, from 1: a running sum over ranges of the order."""
    return cumulated(df, [*order], F.lit(1), name).withColumn(name, F.col(name) + 1)


def _beside(df: DataFrame, values: list[float], name: str) -> DataFrame:
    """df with each of a few numbers, as data: numbers within expressions would be compiled anew in every step of a search."""
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], f"{name} double")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, ord, n_docs, source_size, weight, target) for (source, n_docs, source_size).

    The sum of targets is concave in the level, so Newton's steps from below end at the level that resharing the excess again and again ends at; each is
    one sum over the sources, of whole numbers."""
    s = numbered(sizes, F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("ord") - 1) % len(weights) + 1).cast("int"))
    s = written(s.withColumn("weight", w).withColumn("cap", most * F.col("source_size")), "sources")
    total = s.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    level = share * (total.n or 0) / (total.w or 1)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    while True:
        got = _beside(s, [level], "level").agg(F.sum(F.when(full, F.col("cap"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got.open:  # every source is at its cap
            level = float("inf")
            break
        after = (share * total.n - (got.full or 0)) / got.open
        if after <= level:
            break
        level = after
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))).select("source", "ord", "n_docs", "source_size", "weight", "target")


def _seats_above(q: Column | float) -> Column:
    """How many of a source's seats have a quotient of q or more; seats beyond its room don't exist."""
    return F.when(F.col("target") > 0, F.least("room", F.floor((F.col("target") / q + 1) / 2))).otherwise(0)


def apportioned(targets: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST) -> DataFrame:
    """targets with seats: Sainte-Lague's number of blocks for each source, sum(target) / block_words in all; ties go to the source before."""
    t = written(targets.withColumn("room", F.ceil(F.col("source_size") / block_words) * most), "targets")
    got = t.agg(F.round(F.sum("target") / block_words).cast("long").alias("want"), F.max("target").alias("top"), F.min(F.when(F.col("target") > 0, F.col("target") / (2 * F.col("room") + 1))).alias("end"), F.sum(F.when(F.col("target") > 0, F.col("room"))).alias("all")).first()
    want = min(got.want or 0, got["all"] or 0)
    if not want:
        return t.withColumn("seats", F.lit(0).cast("long")).drop("room")
    high, low, above, below = 2.0 * got.top, got.end, 0, got["all"]  # seats with quotients of at least each
    while below - above > FEW:
        step = (low / high) ** (1 / GRID)
        grid = [high * step**k for k in range(1, GRID)]
        grid = [q for q in dict.fromkeys(grid) if low < q < high]
        if not grid:  # as many seats with one quotient
            break
        sums = {x.q: x.n for x in _beside(t, grid, "q").groupBy("q").agg(F.sum(_seats_above(F.col("q"))).alias("n")).collect()}
        for q in grid:
            n = sums[q]
            if n >= want:
                low, below = q, n
                break
            high, above = q, n
    sure, most_ = _seats_above(F.lit(high)), _seats_above(F.lit(low))
    t = t.withColumn("sure", sure.cast("long")).withColumn("open", most_.cast("long"))
    last = t.where("open > sure").select("ord", "target", F.explode(F.sequence("sure", F.col("open") - 1)).alias("seat"))
    last = numbered(last.withColumn("quotient", F.col("target") / (2 * F.col("seat") + 1)), F.desc("quotient"), F.col("ord"), F.col("seat"), name="rank")
    won = last.where(F.col("rank") <= want - above).groupBy("ord").agg(F.count("*").alias("won"))
    return t.join(won, "ord", "left").select(*[t[c] for c in targets.columns], (F.col("sure") + F.coalesce("won", F.lit(0))).alias("seats"))


def _hex(column: str, start: int, digits: int) -> Column:
    return F.conv(F.substring(column, start, digits), 16, 10).cast("long")


def _units(df: DataFrame, key: str, text: str, source: str, seed: int, row: Column) -> DataFrame:
    """Distinct documents with their numbers of rows: (doc_id, source, size, u, row, copies). u: seeded hex digits, the same on every run and engine."""
    known = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))).cast("binary"))
    d = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words(text).alias("size"), known.alias("u"), row.alias("row"))
    return written(d.groupBy("doc_id", "source", "size", "u", "row").agg(F.count("*").alias("copies")), "mix-units")


def _positions(x: DataFrame) -> DataFrame:
    """x(ord, n_docs, u, doc_id, size, row, copies) with a: the words of its source's stream before it."""
    x = x.withColumn("bucket", F.shiftright(_hex("u", 1, 7) * F.ceil(F.col("n_docs") / BUCKET_ROWS), 28)).withColumn("words", F.col("size") * F.col("copies"))
    groups = written(x.groupBy("ord", "bucket").agg(F.sum("words").alias("words")).withColumn("grp", F.floor(F.col("bucket") / GROUP_BUCKETS)), "mix-buckets")
    upto = lambda keys, order: F.coalesce(F.sum("words").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = groups.groupBy("ord", "grp").agg(F.sum("words").alias("words")).select("ord", "grp", upto(["ord"], ["grp"]).alias("start"))
    buckets = groups.select("ord", "grp", "bucket", upto(["ord", "grp"], ["bucket"]).alias("before")).join(starts, ["ord", "grp"]).select("ord", "bucket", (F.col("start") + F.col("before")).alias("start"))
    within = upto(["ord", "bucket"], ["u", "doc_id", "size", "row"])
    return x.withColumn("inside", within).join(buckets, ["ord", "bucket"]).withColumn("a", F.col("start") + F.col("inside")).drop("bucket", "words", "inside", "start")


def words_taken(x: DataFrame, place: str, name: str, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """x with a column of the words taken of the first so many words of a source's stream, from its blocks, shards and seats.

    Shard j of the source has blocks [p, q); its quota takes quota div (q - p) passes, and (quota mod (q - p)) blocks from a seeded one on, round its end.
    Steps are columns of their own, so that no expression repeats another."""
    w = F.lit(block_words)
    div = lambda a, b: F.call_function("div", a, F.greatest(b, F.lit(1)))
    times = lambda a, b: a.cast("decimal(18,0)") * b.cast("decimal(18,0)")  # noqa: E731, products may have more than 63 bits
    c = {k: f"mix {k}" for k in ("block", "shard", "p", "q", "before", "quota", "here", "size", "arc", "first")}
    col = lambda k: F.col(f"`{c[k]}`")
    length = col("q") - col("p")
    y = x.withColumn(c["block"], F.least(div(F.col(place), w), F.greatest(F.col("blocks") - 1, F.lit(0))))
    y = y.withColumn(c["shard"], div(times(col("block") + 1, F.col("shards")) - 1, F.col("blocks")))
    y = y.withColumns({c["p"]: div(times(col("shard"), F.col("blocks")), F.col("shards")), c["q"]: div(times(col("shard") + 1, F.col("blocks")), F.col("shards"))})
    # whole shards before: each gives its quota of blocks
    y = y.withColumns({c["before"]: div(times(F.col("seats"), col("p")), F.col("blocks")), c["quota"]: div(times(F.col("seats"), col("q")), F.col("blocks"))})
    y = y.withColumn(c["quota"], col("quota") - col("before"))
    # words of the shard before the place, and the arc's words among them, before and after it wraps; the last block of the source may be short
    y = y.withColumns({c["here"]: F.col(place) - col("p") * w, c["size"]: F.least(col("q") * w, F.col("source_size")) - col("p") * w, c["arc"]: col("quota") % F.greatest(length, F.lit(1)), c["first"]: _hex_seed(seed, col("shard")) % F.greatest(length, F.lit(1))})
    over = lambda lo, hi: F.greatest(F.lit(0), F.least(col("here"), hi, col("size")) - lo)
    wrapped = (col("first") + col("arc") - length) * w
    part = F.when(wrapped > 0, over(F.lit(0), wrapped)).otherwise(0) + over(col("first") * w, (col("first") + col("arc")) * w)
    taken = col("before") * w + div(col("quota"), length) * col("here") + part
    y = y.withColumn(name, F.when((F.col("blocks") > 0) & (F.col(place) > 0), taken).otherwise(0).cast("long"))
    return y.drop(*c.values())


def _hex_seed(seed: int, shard: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|shard"), F.col("ord").cast("string"), shard.cast("long").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")


def _taken(x: DataFrame, block_words: int, seed: int) -> DataFrame:
    """A row for each copy of a document (repeats follow each other in the stream), with the words taken of it."""
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    x = x.withColumn("a", F.col("a") + F.col("copy") * F.col("size")).withColumn("z", F.col("a") + F.col("size"))
    x = words_taken(words_taken(x, "a", "before_a", block_words, seed), "z", "before_z", block_words, seed)
    return x.withColumn("taken", F.col("before_z") - F.col("before_a"))


def _mixed(df: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], share: float, most: int, block_words: int, seed: int, row: Column) -> DataFrame:
    """(doc_id, size, row, copies, source_size, target, a) and what words_taken() reads, of distinct documents."""
    units = _units(df, key, text, source, seed, row)
    sizes = units.groupBy("source").agg(F.sum("copies").alias("n_docs"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    quotas = apportioned(source_targets(sizes, weights, share, most), block_words, most)
    q = written(quotas.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("blocks") / SHARD_BLOCKS))), "mix-quotas")
    q = q.select(F.col("source").alias("q_source"), "ord", "n_docs", "source_size", "target", "seats", "blocks", "shards")
    # sources are few rows; AQE broadcasts them if they are small and splits a hot source if they are not
    x = units.join(q, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source", "source")
    return _positions(x)


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row."""
    x = _mixed(df, key, text, source, weights, share, most, block_words, seed, F.lit(0))
    return _taken(x, block_words, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Rows of df, each as often as its taken words fill it (rounded half up): 0, 1 or 2 times by default.

    Rows that are equal in all columns are one row and a number of copies, so texts are moved once, to the decision on them."""
    row = F.xxhash64(*[f"`{c}`" for c in df.columns])
    x = _mixed(df, key, text, source, weights, share, most, block_words, seed, row)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + F.lit(0.5))).otherwise(0)
    x = _taken(x, block_words, seed)
    found = x.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "copies", times.alias("times")).groupBy("__id", "__row").agg(F.sum("times").cast("int").alias("__times"), F.first("copies").alias("__copies"))
    found = written(found.where("__times > 0"), "mix-decided")
    wrapped = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("key"), row.alias("hash"))
    y = wrapped.join(found, F.col("key").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__row")))
    if not found.where("__copies > 1").isEmpty():
        y = y.where("__copies = 1").unionByName(y.where("__copies > 1").dropDuplicates(["__id", "__row"]))
    return y.select("row", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("copy")).select("row.*")
