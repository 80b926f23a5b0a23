"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles.  Documents with equal sets form a class, and one document
stands for each.  In each of several independent trees a document walks a path: at every level it goes to the
branch of its minwise token under that level's hash function, so two documents stay together with a chance
equal to their Jaccard similarity.  A node of few documents is compared exhaustively and ends there; a
larger one is compared with one pivot of its own and branches again.  Nodes that are still large at the last
level are near copies of each other: what still lies in different components there is joined exactly, by differences
from one document (`linking.remaining_links`).  Comparisons use 128-bit sketches; links are confirmed on full sets.

Only connectivity is asked for, so pairs that are connected already are not confirmed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text
from quarry.llm._work import MaybeAmong, outlasting, passing_tables, saved
from quarry.llm.components import connected_components
from quarry.llm.linking import VALUES, alike, bits_apart, open_pairs, remaining_links, sets_of_items, widened

#: Independent trees; first and last level of a path; documents of a small node.
TREES, FIRST_LEVEL, LAST_LEVEL, SMALL = 20, 3, 5, 16

_SKETCH = "n bigint, f1 bigint, f2 bigint, path array<int>, b1 bigint, b2 bigint"


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """Of each document: id, set size n, fingerprints of the set, a minwise value for each tree and level, and a sketch of
    two bits of each of `VALUES` others."""
    seeds = _text.seeds(VALUES + TREES * LAST_LEVEL)
    ones = np.uint64(1) << np.arange(VALUES, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _text.slices(batch.column(1)):
                sizes, prints, paths, bits = [], [], [], []
                for items in _text.shingle_sets(texts, _text.NOT_SPACE, width):
                    least = _text.mix(_text.minhashes(items, seeds))
                    sizes.append(len(items))
                    prints.append((_text.mix(items).sum(), np.bitwise_xor.reduce(_text.mix(items + np.uint64(7)), initial=np.uint64(len(items)))))
                    paths.append((least[VALUES:] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    least = least[:VALUES]
                    bits.append((((least & np.uint64(1)) * ones).sum(), ((least >> np.uint64(1) & np.uint64(1)) * ones).sum()))
                pair = [np.array(x, dtype=np.uint64).view(np.int64) for x in (*zip(*prints, strict=True), *zip(*bits, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(sizes, pa.int64()), *map(pa.array, pair[:2]), _text.list_column(paths, pa.int32()), *map(pa.array, pair[2:])], names=["id", "n", "f1", "f2", "path", "b1", "b2"])

    return documents.mapInArrow(sketch, "id bigint, " + _SKETCH)


def shingle_table(documents: DataFrame, width: int) -> DataFrame:
    """Full sets: id, f1, items (distinct shingle hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _text.slices(batch.column(1)):
                sets = list(_text.shingle_sets(texts, _text.NOT_SPACE, width))
                prints = np.array([_text.mix(s).sum() for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(prints), _text.list_column([s.view(np.int64) for s in sets], pa.int64())], names=["id", "f1", "items"])

    return documents.mapInArrow(cut, "id bigint, f1 bigint, items array<bigint>")


def _pair(a: str, b: str) -> list[Column]:
    """A pair once, the smaller id first."""
    swap = F.col(f"{a}.id") > F.col(f"{b}.id")
    side = lambda c, x, y: F.when(swap, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    return [side("id", b, a).alias("a"), side("f1", b, a).alias("fa"), side("id", a, b).alias("b"), side("f1", a, b).alias("fb"), bits_apart(a, b).alias("bits")]


def node_key(level: int) -> Column:
    """The node at a level: the minwise values along the tree's walk, which no other tree or level has."""
    return F.xxhash64("tree", *(F.get("path", F.col("tree") * LAST_LEVEL + d) for d in range(level)))


def _candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs whose sketches are alike (a, fa, b, fb, bits), and rows of nodes still large at the last level."""
    levels = range(FIRST_LEVEL, LAST_LEVEL + 1)

    # only keys and ids are dealt by key; sketches and paths join the rows whose nodes hold others
    walk = nodes.select("id", "f1", "path", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("id", "f1", "tree", node_key(FIRST_LEVEL).alias("key"))
    pairs = []
    for k, level in enumerate(levels):
        shared = walk.join(walk.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
        sized = saved(shared.join(nodes, ["id", "f1"]).withColumn("next", node_key(min(level + 1, LAST_LEVEL))).drop("path"))
        small = sized.where(F.col("size") <= SMALL).select("key", "id", "f1", "n", "b1", "b2")
        same = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & alike("x", "y", percent))
        pairs.append(same.select(*_pair("x", "y")))
        large = sized.where(F.col("size") > SMALL)
        if k % 2 == 0:  # every other level, against the node's pivot
            pivot = large.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id", "f1", "n", "b1", "b2")).alias("p"))
            with_pivot = large.join(pivot, "key").select(F.struct("id", "f1", "n", "b1", "b2").alias("x"), "p").where("x.id <> p.id").where(alike("x", "p", percent))
            pairs.append(with_pivot.select(*_pair("x", "p")))
        if level == LAST_LEVEL or large.isEmpty():
            break
        walk = large.select("id", "f1", "tree", F.col("next").alias("key"))
    walk = large.select("key", "id", "f1", "n", "b1", "b2")
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    return found.distinct(), walk


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among pairs, by their full sets: a, b."""
    left = sets.select(F.col("id").alias("a"), F.col("f1").alias("fa"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("f1").alias("fb"), F.col("items").alias("y"))
    both = pairs.select("a", "fa", "b", "fb").join(left, ["a", "fa"]).join(right, ["b", "fb"])
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    return both.select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).alias("t")).where(F.col("s") * 100 >= percent * (F.col("t") - F.col("s"))).select("a", "b")


def components_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared >= percent * union of their shingle sets; component_id is the smallest
    doc_id reachable by links, and the document of that id is kept.  Texts without words (null, empty) are linked with
    nothing.  Rows that share a doc_id are one vertex; rows without one are linked with nothing and kept.
    """
    with passing_tables(documents.sparkSession):
        return outlasting(_components_of(documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")), width, percent))


def _components_of(source: DataFrame, width: int, percent: int) -> DataFrame:
    """The same of rows of id and text, by tables that pass."""
    sketched = saved(sketches(source, width))
    known = sketched.where("n > 0 AND id IS NOT NULL")
    classes = saved(known.groupBy("f1", "f2", "n").agg(F.min("id").alias("id")))
    nodes = saved(known.join(classes.select("id", "f1"), ["id", "f1"]).select("id", "f1", "n", "path", "b1", "b2").dropDuplicates(["id", "f1"]))
    pairs, residual = _candidates(nodes, percent)
    pairs, residual = saved(pairs), saved(residual)
    ends = pairs.select("a").union(pairs.select("b")).union(residual.select("id")).distinct().withColumnRenamed("a", "id")
    ends = saved(ends)
    sets = saved(shingle_table(source.where(MaybeAmong(ends).passes("id")).join(ends, "id", "left_semi").dropDuplicates(), width))
    # first each document with its most promising partner, then only pairs that still lie in different components
    turned = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("fb").alias("fa"), F.col("a").alias("b"), F.col("fa").alias("fb"), "bits"))
    best = turned.groupBy("a", "fa").agg(F.min(F.struct(F.col("bits") > 20, "b", "fb")).alias("p")).select("a", "fa", "p.b", "p.fb")
    components = saved(connected_components(_confirmed(best, sets, percent)))
    rest = saved(open_pairs(pairs, components))
    if not rest.isEmpty():
        components = widened(components, saved(_confirmed(rest, sets, percent)))
    if not residual.isEmpty():
        vertex = F.xxhash64("id", "f1")
        rows = residual.join(components, "id", "left").select("key", vertex.alias("id"), F.coalesce("component", "id").alias("component"))
        kept = sets.join(nodes, ["id", "f1"]).select(vertex.alias("id"), "n", "b1", "b2", "items")
        names = nodes.select(vertex.alias("v"), "id")
        links = remaining_links(rows, sets_of_items(kept, percent), percent)
        for end in ("a", "b"):
            links = links.join(names.select(F.col("v").alias(end), F.col("id").alias("id_" + end)), end)
        components = widened(components, links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    # rows that share an id link their classes
    ranks = known.join(classes.withColumnRenamed("id", "rank"), ["f1", "f2", "n"]).select("id", "rank").distinct()
    least = ranks.groupBy("id").agg(F.min("rank").alias("b"), F.count("*").alias("k")).where("k > 1")
    components = widened(components, ranks.join(least, "id").where("rank <> b").select(F.col("rank").alias("a"), "b"))
    # equal sets share the component of the document that stands for them; a repeated id joins its classes
    of_class = classes.join(components, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component_id"))
    out = sketched.join(of_class, ["f1", "f2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * s >= 85 * (p.n + q.n - s)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN edges e ON e.a = r.id WHERE r.c < e.b)
  SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN reach r ON r.id = d.doc_id
"""
