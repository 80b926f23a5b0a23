"""Graph reads over an edge table (src, dst): neighbourhoods, shortest paths, subgraphs.

Edges count in both directions.  A frontier grows by joins; visited nodes are kept out, so every hop is a
shuffle of the frontier, not of paths.  Filter nodes and edges by access before the call: a path then only
crosses what a role may see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.access import visible
from quarry.sources.shared import saved

# fixed values: the deepest neighbourhood and the longest path that may be asked for
MAX_DEPTH, MAX_HOPS = 4, 6


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct edges in both directions, written once for all hops of a walk, and clustered by their start."""
    return saved(undirected(edges).distinct().repartition("src").sortWithinPartitions("src"))


def _spread(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within some hops of seeds, with the fewest: node, hops.  Edges are given in both directions and saved; each
    hop's frontier is saved, so a plan holds one hop; Spark broadcasts a small frontier, and the edges then aren't
    shuffled."""
    both, seen = edges, saved(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        met = both.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = saved(met.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within `depth` hops of seeds (node), with the fewest hops: node, hops."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 1 to {MAX_DEPTH}")
    return _spread(adjacency(edges), seeds, depth)


def path_lengths(edges: DataFrame, seeds: DataFrame, targets: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """Hops of the shortest path from seeds to each target that is within `most`: node, hops."""
    if not 1 <= most <= MAX_HOPS:
        raise ValueError(f"paths have at most {MAX_HOPS} hops")
    return _spread(adjacency(edges), seeds, most).join(targets.select("node").distinct(), "node", "left_semi")


def path_nodes(edges: DataFrame, seeds: DataFrame, targets: DataFrame, most: int = MAX_HOPS, limit: int = 50) -> DataFrame:
    """One shortest path from seeds to each of the nearest targets: node, hops, path (nodes from a seed on).

    Of equally short paths the one whose nodes are smallest, from the target backwards.  Targets come by hops, then
    node, at most `limit` of them.  Only nodes on the way back from targets are visited again, one join a hop.
    """
    if not 1 <= most <= MAX_HOPS:
        raise ValueError(f"paths have at most {MAX_HOPS} hops")
    both = adjacency(edges)
    seen = saved(_spread(both, seeds, most))
    ends = seen.join(targets.select("node").distinct(), "node", "left_semi").orderBy("hops", "node").limit(limit)
    paths = saved(ends.select("node", "hops", F.array("node").alias("path")))
    for left in range(most, 0, -1):
        open_ones = paths.where(F.size("path") == F.col("hops") - left + 1).withColumn("dst", F.get("path", F.lit(0)))
        before = seen.where(F.col("hops") == left - 1).select(F.col("node").alias("src"))
        step = open_ones.join(both, "dst").join(before, "src").groupBy("node", "hops", "path").agg(F.min("src").alias("src"))
        grown = step.select("node", "hops", F.concat(F.array("src"), "path").alias("path"))
        paths = saved(grown.unionByName(paths.where(F.size("path") != F.col("hops") - left + 1)))
    return paths


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with an end among nodes (node)."""
    ends = nodes.select("node").distinct()
    touching = [edges.join(ends.withColumnRenamed("node", end), end, "left_semi") for end in ("src", "dst")]
    return touching[0].unionByName(touching[1]).distinct()


def visible_part(nodes: DataFrame, edges: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a role may walk: every path over them is one that it may see.

    nodes: node, label, access_level; edges: src, dst, type, access_level.  Left out are sources that the role may not
    see, facts that no source it may see describes (DESCRIBED_IN), and edges of a level it may not see.
    """
    sources = nodes.where((F.col("label") == "Source") & visible(role)).select("node")
    described = edges.where("type = 'DESCRIBED_IN'").join(sources.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    seen = sources.unionByName(described).distinct()
    bound = F.col("label").isin("Source", "Fact")
    kept = nodes.where(~bound).unionByName(nodes.where(bound).join(seen, "node", "left_semi"))
    open_edges = edges.where(F.col("access_level").isNull() | visible(role))
    for end in ("src", "dst"):
        open_edges = open_edges.join(kept.select(F.col("node").alias(end)), end, "left_semi")
    return kept, open_edges


def visible_nodes(nodes: DataFrame, edges: DataFrame, asked: DataFrame, role: str) -> DataFrame:
    """Which of some nodes (node) a role may look at: sources that it may see, nodes within three hops of one, and nodes
    with an edge of a level that it may see.  This is looser than `visible_part`."""
    sources = nodes.where((F.col("label") == "Source") & visible(role)).select("node").distinct()
    both = adjacency(edges)
    near = _spread(both, asked, 3)
    # an asked node sees a source within three hops if the source reaches it within three
    reached = _spread(both, near.select("node").join(sources, "node", "left_semi"), 3).select("node")
    touched = undirected(edges.where(F.col("access_level").isNotNull() & visible(role))).select(F.col("src").alias("node"))
    return asked.select("node").distinct().join(reached.unionByName(touched).distinct(), "node", "left_semi")


def shown(nodes: DataFrame) -> DataFrame:
    """Nodes by id once, with a title: claim, canonical name, title, name or id (whichever is there first)."""
    there = [F.col(c) for c in ("claim_text", "canonical_name", "title", "name") if c in nodes.columns]
    return nodes.withColumn("title", F.coalesce(*there, F.col("id").cast("string"))).dropDuplicates(["id"])
