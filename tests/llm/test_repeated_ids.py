"""Nearest neighbours where ids are repeated with other vectors."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import ann


def test_nearest_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    a, b = ([1.0, 0.0], [0.0, 1.0])
    rows = [(7, a), (7, b), (7, b), *((i, b) for i in range(8, 30)), (100, [0.1, 1.0]), (200, [1.0, 0.1])]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, k=5).collect()
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in got}
    assert [found[100, k] for k in range(1, 6)] == [7, 8, 9, 10, 11]
    assert found[200, 1] == 7 and found[200, 2] == 100 and len(got) == 10


def test_every_row_of_a_repeated_id_asks(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), *((200 + k, [0.0, 1.0]) for k in range(3)), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=1).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(100, 1, 1), (100, 1, 200), (200, 1, 100)]


def test_nearest_of_doubles_and_huge_values(spark):
    ask = F.col("vec_id") % 100 == 0
    near = lambda rows, kind="double": sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), ask).collect())
    (found,) = near([(0, [0.1, 0.2]), (1, [0.3, 0.4])])
    assert found == (0, 1, 1, np.sqrt(np.sum((np.array([0.1, 0.2]) - np.array([0.3, 0.4])) ** 2)))
    assert [r[2] for r in near([(0, [1e20, 0.0]), (1, [0.0, 1e20]), (2, [1.0, 1.0])], "float")] == [2, 1]
    assert [(r[2], r[3]) for r in near([(0, [1e-300, 0.0]), (1, [1e300, 0.0]), (2, [0.0, 1.0])])] == [(2, 1.0), (1, 1e300)]
    assert [r[2] for r in near([(0, [0.0, 4.0]), (7, [1.0, 0.0]), (7, [0.0, 5.0]), (8, [0.0, 5.0])])] == [7, 8, 7]


def test_nearest_with_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 1, 2, "a"), (1, [0.9, 0.1], 1, 2, "b"), (2, [0.0, 1.0], 1, 2, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, d int, key string")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_large_leaves_are_cut_by_geometry(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 8)).astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    leaves = ann._split(nodes, nodes.select("id", F.lit(1).cast("long").alias("leaf"))).toPandas()
    sizes = leaves.groupby("leaf").size()
    assert len(leaves) == 3000 and sizes.max() <= 2 * ann.LEAF
    spread = np.mean([x[g["id"]].std(axis=0).mean() for _, g in leaves.groupby("leaf")])
    assert spread < 0.9 * x.std(axis=0).mean()
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "id long, v array<float>")
    assert ann._split(same, same.select("id", F.lit(1).cast("long").alias("leaf"))).groupBy("leaf").count().agg(F.max("count")).first()[0] <= 2 * ann.LEAF
