"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.session import dropped, measured, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the least node of its component.

    Each round needs the least neighbour of a node (a partially aggregated minimum, so a hub with a third
    of all edges costs one row per task) and one join back, whose skew AQE splits. Edges are written to the shared folder
    after each round, so no round recomputes another and no executor's loss restarts the loop. Null ends are ignored;
    self-loops keep a lone node as its own component; repeated edges count once."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = None
    for _ in range(max_rounds):
        large = _large_star(now)
        after, mark = measured(_small_star(large), "cc", F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        dropped(now)
        now = after
        if state == mark:
            break
        state = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # At the fixed point every node hangs on the least node of its component.
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    loops = e.where("u = v").select("u", "v")
    return moved.union(loops).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # every edge here points from the larger node u to the smaller (or equal) node v
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
    return moved.distinct()
