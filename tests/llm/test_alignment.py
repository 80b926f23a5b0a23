"""Token alignment against a plain merge, pair counts over all documents, and odd texts."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ZEROS = (0, 0, 0, 0, 0, 0, "")
ODD = ["a", " the", "é", "ß", "  ", "\n", "\t", "\x85", "\x00", "1", "２", "½", "😀", "’", "'s", "中文", "​", "!", "...", "$$$", "▁", "<0x41>", "<s>", "<|endoftext|>", "word ", "﻿", "ﬁ"]


@pytest.fixture(scope="module")
def sides():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_alphabet()
    entry = {k: bytes(letters[c] for c in v) for v, k in one.get_vocab().items()}
    piece = {k: bytes([int(other.id_to_piece(k)[3:5], 16)]) if other.is_byte(k) else other.id_to_piece(k).replace("▁", " ").encode() for k in range(other.get_piece_size())}
    return one, other, entry, piece


def groups_of(text, sides):
    """Groups of ids by a walk over byte offsets; none where the bytes differ."""
    one, other, entry, piece = sides
    if not text:
        return []
    a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
    if not b"".join(entry[k] for k in a) == b"".join(piece[k] for k in b) == (" " + text).encode():
        return []
    ends = [dict(zip(itertools.accumulate(len(p[k]) for k in ids), range(1, len(ids) + 1), strict=True)) for p, ids in ((entry, a), (piece, b))]
    common, found, x, y = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in common:
        found.append((a[x : ends[0][end]], b[y : ends[1][end]]))
        x, y = ends[0][end], ends[1][end]
    return found


def expected(texts, sides):
    every = [groups_of(t, sides) for t in texts]
    links = [Counter(p for a, b in groups for p in itertools.product(a, b)) for groups in every]
    count = Counter(p for found in links for p in found)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for groups, found in zip(every, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for p, n in found.items() if count[p] == most[p[0]])
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(found.values()), best, sum(n * count[p] for p, n in found.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def values(r):
    return tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def texts_of(spark, sf_dir):
    rng = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    return texts + [None, "", " ", "\n", "x" * 3000, "中" * 2000, " " * 700, "é" * 500, "same", "same", "<|endoftext|>", "plain words " * 4000, "a▁b"]


@pytest.mark.parametrize("small", [False, True])
def test_against_a_plain_merge(spark, sf_dir, sides, small, monkeypatch):
    texts = texts_of(spark, sf_dir)
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a", F.lit(1)).withColumn("chunk", F.lit("clash")).withColumn("pairs", F.lit(None))
    if small:  # many chunks, parts and cells
        monkeypatch.setattr(alignment, "CELL_PAIRS", 500)
        chunks = alignment._chunks
        monkeypatch.setattr(alignment, "_chunks", lambda found: chunks(found.repartition(17)))
    got = {r["doc_id"]: values(r) for r in alignment.op13_token_alignment(df, A, B).collect()}
    want = {i: row for (i, _), row in zip(rows, expected(texts, sides), strict=True)}
    assert got == want
    assert got[len(texts) - 1] == ZEROS and got[len(texts) - 2][2] > 3000


def test_both_encoders_of_a_file_agree(tmp_path, sides, spark, sf_dir):
    import json

    whole = json.load(open(A, encoding="utf-8"))
    whole["pre_tokenizer"]["use_regex"] = True
    whole["normalizer"] = {"type": "NFC"}  # another file: its own encoder is used
    other = tmp_path / "other.json"
    other.write_text(json.dumps(whole), encoding="utf-8")
    texts = [t for t in texts_of(spark, sf_dir) if t] + ["w" * 100_000, " " * 100_000]
    by_rank, own = alignment.ByteLevel(A).encode(texts), sides[0].encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert all(x.tolist() == e.ids for x, e in zip(by_rank, own, strict=True))
    assert [x.tolist() for x in alignment.ByteLevel(str(other)).encode(["a <|endoftext|> b"])] == [sides[0].encode(" a <|endoftext|> b", add_special_tokens=False).ids]


def test_lanes_find_the_same_cuts(monkeypatch):
    rng = np.random.default_rng(2)
    ends = []
    for _ in range(2):
        per, base, first = [], 0, [0]
        for length in (1, 0, 700, 64, 65, 3000, 0, 2):
            own = np.sort(rng.choice(np.arange(1, max(length, 1)), size=length // 3, replace=False)) if length > 3 else np.zeros(0, int)
            own = np.append(own, length) if length else own
            per.append(own + base)
            base += length
            first.append(first[-1] + len(own))
        ends.append((np.concatenate(per), np.array(first)))
    (a, a_first), (b, b_first) = ends
    for lane in (1, 2, 7, 64, 10**6):
        monkeypatch.setattr(alignment, "LANE", lane)
        at, bt = alignment.cuts(a, b, a_first, b_first)
        assert a[at].tolist() == b[bt].tolist() == np.intersect1d(a, b).tolist()


def test_wide_groups_are_counted_once_a_pair(monkeypatch):
    import pyarrow as pa

    lists = [pa.array(x, pa.list_(pa.int32())) for x in ([[1, 1, 2] * 7, [], [5]], [[3, 4, 3, 3] * 5, [], [6]], [[21], [], [1]], [[20], [], [1]])]
    batch = alignment._Batch(pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), *lists], names=["doc_id", "a", "b", "a_cuts", "b_cuts"]))
    doc, key, count = batch.pairs()
    assert {(d, k >> 32, k & 0xFFFFFFFF): n for d, k, n in zip(doc.tolist(), key.tolist(), count.tolist(), strict=True)} == {(0, 1, 3): 14 * 15, (0, 1, 4): 14 * 5, (0, 2, 3): 7 * 15, (0, 2, 4): 7 * 5, (2, 5, 6): 1}
    assert batch.links.tolist() == [420, 0, 1]


def test_tables_without_tokens(spark):
    assert alignment.op13_token_alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    got = alignment.op13_token_alignment(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string"), A, B).collect()
    assert [values(r) for r in got] == [ZEROS] * 3
