"""Trees of near copies share no minwise values."""

from quarry.llm import near_dedup


def test_trees_share_no_minwise_values(spark):
    level = near_dedup.LAST_LEVEL
    text = spark.createDataFrame([(1, "some words of a text that is long enough")], "id long, text string")
    path = near_dedup.sketches(text, 3).first()["path"]
    rows = [(k, [v + (j == k) for j, v in enumerate(path)], t) for k in range(-1, len(path)) for t in range(near_dedup.TREES)]
    keys = {(r["k"], r["tree"]): r["key"] for r in spark.createDataFrame(rows, "k int, path array<int>, tree int").select("k", "tree", near_dedup.node_key(level).alias("key")).collect()}
    for k in range(len(path)):
        assert sum(keys[k, t] != keys[-1, t] for t in range(near_dedup.TREES)) == 1
