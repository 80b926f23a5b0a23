"""Byte-level BPE against tiktoken, and benchmark windows against a direct search."""

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, decontaminate

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["a", "b", "th", "é", "ß", "  ", "\n", "\t", "\x85", " ", " ", "\x1c", "\x1f", "1", "２", "½", "😀", "’", "'s", "'LL", "中文", "ा", "​", "!", "...", "$", "x" * 50]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks(PATH), special_tokens={})


def test_ids_and_round_trip(spark, reference):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "ab" * 3000), (903, " " * 5000), (904, "<|endoftext|>"), (905, "same"), (905, "same"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    got = sorted(byte_bpe.op10_byte_bpe(df, PATH, PATTERN).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    for (i, text), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), got, strict=True):
        ids = reference.encode_ordinary(text or "")
        assert (r["doc_id"], r["n_tokens"]) == (i, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_real_texts(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, byte_bpe.ranks(PATH), PATTERN).collect()}
    for r in docs.collect():
        assert ids[r["doc_id"]] == reference.encode_ordinary(r["text"] or "")


def test_decode_marks_unknown_ids(spark):
    df = spark.createDataFrame([([0, 1],), ([0, 10**6],), ([None],), (None,), ([],)], "ids array<int>")
    out = [r["decoded"] for r in byte_bpe.decode(df, byte_bpe.ranks(PATH)).collect()]
    assert out[0] is not None and out[1:4] == [None, None, None] and bytes(out[4]) == b""


def test_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "one text"), (2, None), (3, "\u00e9" * 70_000)], "doc_id long, text string")
    for df in (byte_bpe.op10_byte_bpe(docs, PATH, PATTERN), corpus_pipeline.tokens(spark, docs, "")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("MapInArrow|ArrowEvalPython", plan)) == 1, plan
    both = byte_bpe.encode(docs, byte_bpe.ranks(PATH), PATTERN, decoded="at_once")
    assert byte_bpe.decode(both, byte_bpe.ranks(PATH)).where("decoded = at_once").count() == 3


def test_empty_table(spark):
    assert byte_bpe.op10_byte_bpe(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    text = (text or "").translate(LOWER)
    return "".join(c if c > "\x7f" or c.isdigit() or "a" <= c <= "z" else " " for c in text).split(" ")


def by_hand(docs, items, width):
    windows = [(str(i), w[k : k + width]) for i, t in items if t is not None and i is not None for w in [[x for x in words(t) if x]] for k in range(max(1, len(w) - width + 1) if w else 0)]
    out = []
    for i, text in docs:
        own = [x for x in words(text) if x]
        hit, found = set(), set()
        for item, w in windows:
            for k in range(len(own) - len(w) + 1):
                if own[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    found.add(item)
        out.append((i, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 10**6])
def test_windows_match_a_direct_search(spark, block):
    rng = random.Random(5)
    vocabulary = ["The", "of", "é", "12", "x-ray", "a.b", "Zürich", "q", "r", "s", "t"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)] + [(60, None), (61, ""), (62, "  \n"), (3, "of"), (63, text(3000)), (63, text(5)), (64, "of " * 20), (64, "of " * 20)]
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 6]))) for i in range(25)] + [(25, None), (26, ""), (27, "of of of of"), (None, "q r s"), (10, "r s")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("words", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(d, b, width=4, block_windows=block)
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in found.collect()], key=str)
    assert got == by_hand(docs, items, 4)


def test_no_benchmark_and_no_documents(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.op3_decontaminate(docs, none).collect()] == [0]
    assert decontaminate.op3_decontaminate(spark.createDataFrame([], docs.schema), spark.createDataFrame([(1, "a")], none.schema)).count() == 0
