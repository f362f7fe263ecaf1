"""Shortest paths in the graph, and explanations made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.operators.graph import symmetric
from stacklight.session import dropped, is_written, measured, written


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None, nearest: bool = False) -> DataFrame:
    """(source, target, path), after query_id if pairs have one, for each pair of nodes of the graph that are joined, by at most max_depth edges if that is given.

    nearest: of the pairs of a target (in a query) only those with its nearest sources.

    Two breadth-first searches, from all sources and from all targets of open pairs, take a level in turn, so each goes half of the way. A level is one join, a minimum of
    paths for each node reached, and an anti join with the two levels before (a neighbour of a level lies in it or beside it). Pairs whose searches meet are
    done; it ends when no pair is open or a search reaches nothing new. Of equally short paths the least one, node by node, is taken. A node is its own path."""
    stored = edges if is_written(edges) else written(edges, "edges")
    links = symmetric(stored).select("src", "dst")
    keys = ["query_id"] if "query_id" in pairs.columns else []
    pairs, (left,) = measured(pairs.select(*keys, "source", "target").distinct(), "pairs", F.count(F.lit(1)))
    front, last, made = {}, {}, []
    for side in ("source", "target"):
        # an inner join, so that a small list of origins is the side that is broadcast
        start = pairs.select(F.col(side).alias("origin")).distinct().join(links, F.col("origin") == F.col("src")).select("origin").distinct()
        front[side] = start.select("origin", F.col("origin").alias("node"), F.array("origin").alias("path"))
    found, length = None, 0
    while True:
        there = front["source"].select(F.col("origin").alias("source"), "node", "path")
        back = front["target"].select(F.col("origin").alias("target"), "node", F.col("path").alias("rest"))
        hit = pairs.join(there, "source").join(back, ["target", "node"]).groupBy(*keys, "source", "target").agg(F.min(F.concat("path", F.expr("slice(rest, 2, size(rest))"))).alias("path"))
        hit, (met,) = measured(hit, "hits", F.count(F.lit(1)))
        found = hit if found is None else found.unionByName(hit)
        if met:
            pairs, (left,) = measured(pairs.join(hit, [*keys, "target"] if nearest else [*keys, "source", "target"], "left_anti"), "pairs", F.count(F.lit(1)))
        if length == max_depth or not left:
            break
        side = ("source", "target")[length % 2]
        now = front[side].join(pairs.select(F.col(side).alias("origin")).distinct(), "origin", "left_semi")
        seen = front[side] if side not in last else front[side].unionByName(last[side])
        step = now.join(links, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), "path")
        step = step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").groupBy("origin", "node").agg(F.min("path").alias("path"))
        path = F.concat("path", F.array("node")) if side == "source" else F.concat(F.array("node"), F.col("path"))
        last[side] = front[side]
        front[side], (new,) = measured(step.select("origin", "node", path.alias("path")), "front", F.count(F.lit(1)))
        made.append(front[side])
        length += 1
        if not new:
            break
    dropped(pairs, *made)
    return found


def explanations(edges: DataFrame, seeds: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(target, seed, path, via), after query_id if targets have one: the shortest path from any seed of the query; the first seed (by pos) wins ties. via: nodes that aren't books."""
    batch = "query_id" in targets.columns
    s = seeds.select((F.col("query_id") if batch else F.lit(0)).alias("query_id"), F.col("node_id").alias("source"), "pos")
    t = targets if batch else targets.withColumn("query_id", F.lit(0))
    wanted = written(t.select("query_id", "target").join(s, "query_id"), "wanted")  # a query has few seeds
    p = wanted.join(shortest_paths(edges, wanted, max_depth, nearest=True), ["query_id", "source", "target"])
    best = p.groupBy("query_id", "target").agg(F.min_by(F.struct("source", "path"), F.struct(F.size("path"), "pos")).alias("x"))
    out = best.select("query_id", "target", F.col("x.source").alias("seed"), F.col("x.path").alias("path"), F.filter("x.path", lambda n: ~n.startswith("book:")).alias("via"))
    return out if batch else out.drop("query_id")
