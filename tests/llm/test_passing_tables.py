"""Tables that operators save on their way are deleted when they end, and shuffle files with the query that made them."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import _text, line_dedup, near_dedup
from quarry.sources.shared import outlasting, passing_tables, saved, shared_folder


def tables(spark):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file://")).iterdir()}


def copies(spark):
    rng = random.Random(3)
    base = [" ".join(str(rng.randint(0, 999)) for _ in range(60)) for _ in range(12)]
    return spark.createDataFrame([(k, base[k % 12] + f" {k // 12}") for k in range(60)], "doc_id bigint, text string")


def test_operators_leave_only_their_results(spark):
    docs, before = copies(spark), tables(spark)
    lines = line_dedup.removals(docs)
    assert len(tables(spark) - before) == 1
    near = near_dedup.components_of(docs)
    assert len(tables(spark) - before) == 2
    assert lines.where("kept").count() == near.where("kept").count() == 12


def test_what_outlasts_stays(spark):
    before = tables(spark)
    with passing_tables(spark):
        first = saved(spark.range(5).groupBy((F.col("id") % 2).alias("k")).count())
        last = outlasting(first.where("k = 0"))
    assert len(tables(spark) - before) == 1
    assert [tuple(r) for r in last.collect()] == [(0, 3)]


def test_distinct_windows():
    rng = np.random.default_rng(1)
    for n in (1, 2, 300):
        windows = rng.integers(0, 50, n, dtype=np.uint64)
        assert line_dedup._distinct(windows).tolist() == np.unique(windows).tolist()


def _slice(lines):
    return next(iter(_text.slices(pa.array(["\n".join(lines)], pa.large_string()))))[1]


def test_lines_lose_white_space_at_their_ends():
    rng = np.random.default_rng(4)
    blank = lambda: "".join(rng.choice(list(" \t\r\v\f"), int(rng.choice([0, 1, 15, 16, 17, 40]))))
    lines = [blank() + str(rng.choice(["", "a", "b c", "word  of \x85 lines", "é"])) + blank() for _ in range(400)]
    texts = _slice(lines)
    starts, stops, _ = line_dedup._trimmed(texts)
    assert [texts.data[a:b].tobytes() for a, b in zip(starts, stops, strict=True)] == [x.encode().strip(b" \t\r\v\f") for x in lines]


def test_signatures_of_short_and_long_lines_meet():
    """Similar lines share a key, also where one has values of 16 bits alone and the other both kinds, or one both and the other 32."""
    rng = np.random.default_rng(5)
    short, percent = line_dedup.SHORT, 85
    for size, more in ((40, 4), (340, 20), (short - 100, 300), (short - 1, 500), (short * 100 // percent - 50, 300), (3 * short, 900)):
        line = "".join(rng.choice(list("abcdefghij"), size + 7))
        other = line + "".join(rng.choice(list("klmnop"), more))
        (keys, ids), alone = line_dedup._signatures(_slice([line, other]), 24, percent), set()
        for i in np.unique(ids):
            alone = alone & set(keys[ids == i]) if alone else set(keys[ids == i])
        assert alone, (size, more)
    assert _text.minwise(np.arange(9, dtype=np.uint64), np.array([0]), np.array([9]), line_dedup._SHORT_SEEDS, raw=True).dtype == np.uint16
