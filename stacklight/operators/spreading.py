"""Spreading activation over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklight.config import DEFAULTS, Config
from stacklight.operators.graph import symmetric
from stacklight.session import dropped, written


def weights(edges: DataFrame, retention: float = DEFAULTS.san_retention) -> DataFrame:
    """(src, dst, w): what a node passes to each neighbour, and to itself."""
    s = symmetric(edges).select("src", "dst")
    degree = s.groupBy("src").agg(F.count("*").alias("degree"))
    out = s.join(degree, "src").select("src", "dst", (F.lit(1 - retention) / F.col("degree")).alias("w"))
    return out.unionByName(degree.select("src", F.col("src").alias("dst"), F.lit(retention).alias("w")))


def activate(edges: DataFrame, seeds: DataFrame, config: Config = DEFAULTS, every: int = 5) -> DataFrame:
    """(query_id, node_id, activation) after all iterations, zeros left out; seeds(query_id, node_id) outside the graph don't count.

    A step is one join and one partially aggregated sum, and refers to the state once, because keeping is a loop edge. The state is written
    to the shared folder every few steps, so the plan stays short and no lost executor costs the whole run."""
    w = written(weights(edges, config.san_retention), "weights")
    known = w.select(F.col("src").alias("node_id")).distinct()
    state = seeds.select("query_id", "node_id").distinct().join(known, "node_id", "left_semi").withColumn("activation", F.lit(float(config.san_initial_energy)))
    last = None
    for step in range(1, config.san_iterations + 1):
        moved = state.join(w, F.col("node_id") == F.col("src"))
        state = moved.groupBy("query_id", F.col("dst").alias("node_id")).agg((F.sum(F.col("activation") * F.col("w")) * (1 - config.san_decay)).alias("activation"))
        state = state.where(F.col("activation") >= config.san_suppress)
        if step % every == 0 and step < config.san_iterations:
            state = written(state, "activation")
            if last is not None:
                dropped(last)
            last = state
    return state.select("query_id", "node_id", "activation")


def activated_books(activation: DataFrame, exclude: DataFrame | None, top_k: int = 20, min_activation: float = DEFAULTS.san_min_activation) -> DataFrame:
    """(query_id, isbn13, activation): for each query its top books that aren't its seeds; each task keeps top_k of a query."""
    d = activation.where(F.col("node_id").startswith("book:") & (F.col("activation") >= min_activation))
    if exclude is not None:
        d = d.join(exclude.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    # rounding settles near-ties alike on any cluster
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("activation", 6)), "node_id")
    d = d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return d.select("query_id", F.replace("node_id", F.lit("book:"), F.lit("")).alias("isbn13"), "activation")
