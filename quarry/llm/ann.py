"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily.

Equal vectors are one node.  First neighbours come from leaves of random projection trees (the upper levels fitted on a
bounded sample, the lower ones on medians over all nodes of a leaf), inside which all nodes are compared.  Each round
of NN-descent then joins every node with its neighbours and reverse neighbours (at most `DEGREE` of each) and
compares these with one another: neighbours of neighbours become neighbours.  Rounds end when few edges are new.  A query
starts at its own node and repeatedly expands the nearest unexpanded nodes of its pool until the nearest `POOL` have been
expanded.  Graph and walk see vectors in single precision, scaled by a power of two; scores come from the vectors as
they were given, in double precision.

Vectors of very different sizes (magnitudes with a gap of 2**GAP between them) are bands with graphs of their own.  Beside a
vector of a larger band a smaller one is as good as zero: all of them are equally near to it, so of smaller bands the
smallest ids are candidates for every query, and of larger bands the shortest vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._work import saved

#: Neighbours of a node; trees and nodes of a leaf; nodes that upper levels are fitted on, and the deepest of these.
DEGREE, TREES, LEAF, SAMPLE, FITTED = 32, 6, 128, 20_000, 7
#: Rounds of NN-descent end when a smaller share of edges is new, or after so many.
NEW_SHARE, ROUNDS = 0.02, 12
#: Binary orders of magnitude without a vector that part two bands (more than double precision resolves), and the most
#: that a band may span before its widest gap parts it too.
GAP, SPAN = 60, 100
#: Nodes that a query must have expanded before it ends; nodes it expands at once.
POOL, EXPAND = 320, 80


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or zero, and all components finite."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def distance(x: Column | str, y: Column | str) -> Column:
    """Euclidean distance in double precision, scaled by the largest difference where squares would leave its range."""
    apart = F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double"))
    square = F.aggregate(apart, F.lit(0.0), lambda s, v: s + v * v)
    most = F.array_max(F.transform(apart, F.abs))
    scaled = most * F.sqrt(F.aggregate(F.transform(apart, lambda v: v / most), F.lit(0.0), lambda s, v: s + v * v))
    return F.when(square.between(1e-280, 1e300), F.sqrt(square)).when(most > 0, scaled).otherwise(0.0)


def bands(exponents: list[int]) -> list[int]:
    """The first exponent of each band, from sorted distinct ones."""
    starts = exponents[:1] + [e for before, e in zip(exponents, exponents[1:], strict=False) if e - before >= GAP]
    while True:
        for start, stop in zip(starts, [*starts, math.inf][1:], strict=True):
            own = [e for e in exponents if start <= e < stop]
            if own[-1] - own[0] > SPAN:
                _, cut = max((after - before, after) for before, after in zip(own, own[1:], strict=False))
                starts = sorted([*starts, cut])
                break
        else:
            return starts


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _trees(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions (one a level) and medians (one an inner node) of each tree."""
    out = []
    for tree in range(TREES):
        rng = np.random.default_rng(tree)
        directions = rng.standard_normal((sample.shape[1], depth)).astype(np.float32)
        cuts, at = np.zeros(2**depth - 1, np.float32), np.zeros(len(sample), np.int64)
        for level in range(depth):
            values = sample @ directions[:, level]
            for node in np.unique(at):
                cuts[2**level - 1 + node] = np.median(values[at == node])
            at = 2 * at + (values > cuts[2**level - 1 + at])
        out.append((directions, cuts))
    return out


def _leaves(nodes: DataFrame, trees: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for number, (directions, cuts) in enumerate(trees):
                at, projected = np.zeros(len(x), np.int64), x @ directions
                for level in range(directions.shape[1]):
                    at = 2 * at + (projected[:, level] > cuts[2**level - 1 + at])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at * TREES + number)], names=["id", "leaf"])

    return nodes.mapInArrow(find, "id bigint, leaf bigint")


def _split(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaves (id, leaf) cut at the median of a random projection, level by level, until they are small.

    Where most nodes of a leaf project alike, hashes cut it instead.
    """
    done, level = None, 0
    while True:
        sizes = leaves.groupBy("leaf").agg(F.count("*").alias("n"))
        sized = leaves.join(sizes, "leaf")
        fit = sized.where(F.col("n") <= 2 * LEAF).select("id", "leaf")
        done = fit if done is None else done.unionByName(fit)
        large = saved(sized.where(F.col("n") > 2 * LEAF).select("id", "leaf", "n"))
        if large.isEmpty():
            return done
        level += 1
        size = len(nodes.select("v").first()["v"])
        direction = [float(x) for x in np.random.default_rng(1000 + level).standard_normal(size)]
        along = F.aggregate(F.zip_with("v", F.lit(direction), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        placed = large.join(nodes.select("id", along.alias("at")), "id")
        middle = placed.groupBy("leaf").agg(F.percentile_approx("at", 0.5).alias("middle"), F.min("at").alias("low"), F.max("at").alias("high"))
        beyond = F.when((F.col("middle") < F.col("high")), F.col("at") > F.col("middle")).otherwise(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == 1)
        leaves = saved(placed.join(middle, "leaf").select("id", F.xxhash64("leaf", F.lit(level), beyond).alias("leaf")))


_EDGES = "id bigint, other bigint, d float"


def _compare(groups: DataFrame) -> DataFrame:
    """Edges among the members of each group (members: array of id, v, bound): those nearer than either's bound.

    Each member gets at most `DEGREE` edges from a group.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            for k in range(len(members)):
                rows = members[k].values
                ids, x = rows.field("id").to_numpy(zero_copy_only=False), _matrix(rows.field("v")).astype(np.float64)
                ids, at = np.unique(ids, return_index=True)
                if len(ids) < 2:
                    continue
                x, bound = x[at], rows.field("bound").to_numpy(zero_copy_only=False)[at]
                square = (x * x).sum(axis=1)
                d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)).astype(np.float32)
                np.fill_diagonal(d, np.inf)
                near = min(DEGREE, len(ids) - 1)
                best = np.argpartition(d, near - 1, axis=1)[:, :near]
                value = np.take_along_axis(d, best, axis=1)
                row, column = np.nonzero(value < bound[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[best[row, column]]), pa.array(value[row, column], pa.float32())], names=["id", "other", "d"])

    return groups.select("members").mapInArrow(compare, _EDGES)


def _nearest(edges: DataFrame) -> DataFrame:
    """Each node's nearest `DEGREE` others: id, other, d."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return edges.groupBy("id", "other").agg(F.min("d").alias("d")).withColumn("rank", rank).where(F.col("rank") <= DEGREE).drop("rank")


def _both_ways(graph: DataFrame) -> DataFrame:
    """Neighbours and at most `DEGREE` reverse neighbours (nearest first; each task keeps no more of them): id, other."""
    rank = F.row_number().over(Window.partitionBy("other").orderBy("d", "id"))
    back = graph.withColumn("rank", rank).where(F.col("rank") <= DEGREE).select(F.col("other").alias("id"), F.col("id").alias("other"))
    return graph.select("id", "other").unionByName(back).distinct()


def neighbour_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The graph of nodes (id, v; all of one size): id, other, d."""
    count = nodes.count()
    sample = nodes.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toPandas()["v"]
    depth = max(0, int(np.ceil(np.log2(max(1, count / LEAF)))))
    trees = _trees(np.stack(sample.to_numpy()).astype(np.float32), min(depth, FITTED)) if count else []
    member = F.struct("id", "v", F.lit(float("inf")).cast("float").alias("bound"))
    blocks = _split(nodes, _leaves(nodes, trees)).join(nodes, "id").groupBy("leaf").agg(F.collect_list(member).alias("members"))
    graph = saved(_nearest(_compare(blocks)))
    for _ in range(rounds if depth else 0):
        bounds = graph.groupBy("id").agg(F.when(F.count("*") >= DEGREE, F.max("d")).otherwise(F.lit(float("inf")).cast("float")).alias("bound"))
        held = nodes.join(bounds, "id").select(F.col("id").alias("other"), F.struct("id", "v", "bound").alias("member"))
        joined = _both_ways(graph).join(held, "other").groupBy("id").agg(F.collect_list("member").alias("members"))
        before, graph = graph, saved(_nearest(_compare(joined).unionByName(graph)))
        if graph.join(before, ["id", "other"], "left_anti").count() <= NEW_SHARE * graph.count():
            break
    return graph


def search(nodes: DataFrame, graph: DataFrame, starts: DataFrame) -> DataFrame:
    """Greedy search from nodes (starts: q, v): q, id, d (double) of the nearest `POOL` nodes that a query has met.

    What falls out of a pool is never nearer than the pool's last, so a query carries no more than its pool.
    """
    links = saved(_both_ways(graph))
    pool = saved(starts.select("q", F.col("q").alias("id"), F.lit(0.0).alias("d"), F.lit(False).alias("expanded")))
    while True:
        near = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
        ranked = pool.withColumn("near", near)
        turn = F.row_number().over(Window.partitionBy("q").orderBy("near"))
        chosen = ranked.where(F.col("near") <= POOL).where("NOT expanded").withColumn("turn", turn).where(F.col("turn") <= EXPAND).select("q", "id")
        chosen = saved(chosen)
        if chosen.isEmpty():
            break
        met = chosen.join(links, "id").select("q", F.col("other").alias("id")).distinct().join(pool.select("q", "id"), ["q", "id"], "left_anti")
        new = met.join(nodes.withColumnRenamed("v", "y"), "id").join(starts, "q").select("q", "id", distance("v", "y").alias("d"), F.lit(False).alias("expanded"))
        done = pool.join(chosen.withColumn("now", F.lit(True)), ["q", "id"], "left").select("q", "id", "d", (F.col("expanded") | F.coalesce("now", F.lit(False))).alias("expanded"))
        pool = saved(done.unionByName(new).withColumn("near", near).where(F.col("near") <= POOL).drop("near"))
    return pool.select("q", "id", "d")


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """The k nearest others found for each row that `queries` chooses: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller id.  Vectors that are null, zero or hold a null or non-finite component take no
    part, nor do rows without id and vectors of another size than most; a repeated id counts once for each vector, and
    asks for each.
    """
    known = vectors.where(F.col(vec_id).isNotNull() & usable(vector))
    rows = known.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("w"), queries.alias("asks"))
    size = rows.groupBy(F.size("w").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = saved(rows.where(F.size("w") == (size["size"] if size else 0)).withColumn("key", F.xxhash64("w")))
    exponent = F.floor(F.log2(F.array_max(F.transform("w", F.abs)))).cast("int")
    exponents = sorted(rows.agg(F.collect_set(exponent)).first()[0])  # some 2,100 at most
    starts = bands(exponents) or [0]
    tops = [max((e for e in exponents if start <= e < stop), default=0) for start, stop in zip(starts, [*starts[1:], math.inf], strict=True)]
    classes = rows.groupBy("key", "w").agg(F.min("vec_id").alias("least"), F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    # a number of each vector's own: ids may be repeated, and hashes may meet
    again = F.row_number().over(Window.partitionBy("id").orderBy("w"))
    numbered = classes.withColumn("id", F.xxhash64("key", "least")).withColumn("again", again)
    band = sum((F.when(exponent >= start, 1).otherwise(0) for start in starts[1:]), F.lit(0))
    # two factors, since the power of the smallest vectors is out of range
    halves = [(2.0 ** -((top + 1) // 2), 2.0 ** -(top + 1 - (top + 1) // 2)) for top in tops]
    one, other = (F.element_at(F.array(*(F.lit(h[k]) for h in halves)), F.col("band") + 1) for k in (0, 1))
    scaled = F.transform("w", lambda x: (x * one * other).cast("float")).alias("v")
    number = F.when(F.col("again") > 1, F.xxhash64("id", "again")).otherwise(F.col("id")).alias("id")
    nodes = saved(numbered.withColumn("band", band).select(number, "key", "least", "asks", "w", "band", scaled))
    found = None
    for k_band in range(len(starts)):
        own = nodes.where(F.col("band") == k_band) if len(starts) > 1 else nodes
        graph = neighbour_graph(own.select("id", "v"))
        met = search(own.select("id", "v"), graph, own.where("asks").select(F.col("id").alias("q"), "v"))
        found = met if found is None else found.unionByName(met)
    # scores of the vectors themselves, for more of the nearest than are asked for, since single precision may confuse some
    close = F.row_number().over(Window.partitionBy("q").orderBy("d", "least"))
    found = found.join(nodes.select("id", "least", F.col("w").alias("y")), "id").withColumn("close", close).where(F.col("close") <= 4 * (k + 1))
    found = found.select("q", "id", "least", "y")
    for k_band in range(len(starts) if len(starts) > 1 else 0):
        smaller = nodes.where(F.col("band") < k_band).orderBy("least").limit(k + 1)
        larger = nodes.where(F.col("band") > k_band).orderBy("band", distance("w", F.transform("w", lambda x: F.lit(0.0))), "least").limit(k + 1) if k_band + 1 < len(starts) else smaller.limit(0)
        outside = smaller.unionByName(larger).select("id", "least", F.col("w").alias("y"))
        asking = nodes.where(F.col("asks") & (F.col("band") == k_band)).select(F.col("id").alias("q"))
        found = found.unionByName(asking.join(F.broadcast(outside)).select("q", "id", "least", "y"))  # 2 k + 2 rows
    found = found.join(nodes.where("asks").select(F.col("id").alias("q"), F.col("w").alias("x")), "q").select("q", "id", "least", distance("x", "y").alias("d"))
    best = F.row_number().over(Window.partitionBy("q").orderBy("d", "least"))
    found = found.withColumn("best", best).where(F.col("best") <= k + 1).drop("best", "least")
    # equal vectors: the k + 1 smallest ids of a node are enough
    named = rows.join(nodes.select("key", "w", "id"), ["key", "w"]).groupBy("id", "vec_id").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    members = named.select("id", "vec_id").withColumn("first", first).where(F.col("first") <= k + 1).drop("first")
    asking = named.where("asks").select(F.col("id").alias("q"), F.col("vec_id").alias("query_id"))
    pairs = asking.join(found, "q").join(members, "id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("d", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def op2_nn_descent(embeddings: DataFrame) -> DataFrame:
    """The 10 nearest of each row whose vec_id is divisible by 100, as `nearest` gives them.

    Null, zero and non-finite vectors, vectors of another size than most and rows without vec_id take no part; repeated
    rows count once, equal vectors of different ids each; ties go to the smaller vec_id; an empty table has no rows.
    """
    return nearest(embeddings, F.col("vec_id") % 100 == 0)
