"""Katz n-grams over all words against a direct computation with dictionaries, backing off recursively."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import katz, ngrams


def lower(text):
    return [w.decode() for w in (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]


def sample(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["The", "THE", "é", "É"]
    rows = [(i, " ".join(rng.choice(words[: 2 + i % 42]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "\t\n "), (3, "w1 w2 never-seen"), (None, "w1 w2"), (63, "w0 " * 3000)]


def direct(rows, order):
    """Scores by dictionaries; returns scores, P(outcome | history), outcomes and histories."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else True for i, _ in rows}
    train = [[*lower(t), "<end>"] for i, t in rows if not held[i]]
    words = Counter(w for t in train for w in t)
    total = sum(words.values()) + len(words) + 1
    grams, after = [Counter() for _ in range(order + 1)], {}
    for t in train:
        seq = ["<start>", *t]
        for n in range(2, order + 1):
            grams[n].update(tuple(seq[k - n + 1 : k + 1]) for k in range(n - 1, len(seq)))
    d = [None, None]
    for n in range(2, order + 1):
        d.append(dict(enumerate(katz.discounts([sum(c == r for c in grams[n].values()) for r in range(1, 7)]), 1)))
        for g, c in grams[n].items():
            after.setdefault(g[:-1], {})[g[-1]] = c

    tokens = sum(words.values())
    d1 = dict(enumerate(katz.discounts([sum(c == r for c in words.values()) for r in range(1, 7)]), 1))
    left = sum((1 - d1.get(c, 1)) * c for c in words.values()) / max(tokens, 1)
    bare = left < 1e-9

    def p(h, x):
        if not h:
            return d1.get(words[x], 1) * words[x] / (tokens + bare) if words[x] else 1 / (tokens + 1) if bare else left
        own = after.get(h)
        if not own:
            return p(h[1:], x)
        n, count = d[len(h) + 1], sum(own.values())
        taken = sum(n.get(c, 1) * c / count for c in own.values())
        scale = count / (count + 1) if 1 - taken < 1e-9 else 1
        if x in own:
            return scale * n.get(own[x], 1) * own[x] / count
        return (1 - scale * taken) / (1 - sum(p(h[1:], y) for y in own)) * p(h[1:], x)

    known, out = {}, []
    for i, t in rows:
        seq = ["<start>", *lower(t), "<end>"]
        keys = [(tuple(seq[max(0, k - order + 1) : k]), seq[k]) for k in range(1, len(seq))]
        score = sum(math.log10(known.setdefault(k, None) or known.__setitem__(k, p(*k)) or known[k]) for k in keys)
        base = sum(math.log10((words[w] + 1) / total) for w in seq[1:])
        out.append((i, held[i], len(seq) - 1, sum(words[w] > 0 for w in seq[1:]), sum(words.values()), base, score))
    return out, p, [*words, "<unknown>"], after


@pytest.mark.parametrize("order", [2, 3])
def test_scores_match_a_direct_computation(spark, monkeypatch, order):
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 100)
    monkeypatch.setattr(ngrams, "PART_ENTRIES", 150)
    rows = sample()
    expected, p, outcomes, histories = direct(rows, order)
    got = ngrams.scored(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect()
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    assert len(got) == len(rows)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    for h in list(histories)[::7]:
        assert sum(p(h, x) for x in outcomes) == pytest.approx(1, abs=1e-9)


def test_words_that_are_never_seen_have_a_share(spark):
    """The words' distribution sums to one, with and without rare words, and beats adding one on held-out words."""
    import numpy as np

    for counts in ([1] * 50 + [2] * 20 + [3] * 9 + [9, 40], [9, 40, 7], [1], []):
        found = ngrams._Words(sum(counts), len(counts), np.array([counts.count(r) for r in range(1, 7)]))
        assert found(np.array([*counts, 0])).sum() == pytest.approx(1)


def test_held_out_texts_score_better_than_by_words(spark):
    got = ngrams.op5_katz(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert got["s"] > -2.92 and got["b"] < -4


def test_every_word_has_its_own_ngrams(spark):
    """More distinct words than the 65,000 that used to have classes: a rare word predicts the one it was seen before."""
    rows = [(i, " ".join(f"r{i}x{k}" for k in range(1000)) + " frequent " * 3) for i in range(80)]
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    other = next(i for i in range(held + 1, 3000) if zlib.crc32(str(i).encode()) % 7 == 2)
    one = next(i for i in range(80) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows += [(held, " ".join(f"r{one}x{k}" for k in range(500, 600))), (other, " ".join(f"r{one}x{k}" for k in range(599, 499, -1)))]
    got = {r["doc_id"]: r for r in ngrams.op5_katz(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held]["base_score"] == pytest.approx(got[other]["base_score"])
    assert got[held]["score"] > got[other]["score"] + 100


def test_empty_table_and_no_training_texts(spark):
    assert ngrams.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = ngrams.scored(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


def _asked(chunks=4, histories=20_000, words=8):
    """What chunks ask of a partition: `words` n-grams after each of the same histories."""
    out = []
    for k in range(chunks):
        h = np.arange(1, histories + 1, dtype=np.uint64) * np.uint64(7)
        w = np.tile(np.arange(k, k + words, dtype=np.uint32), histories)
        n = (np.arange(len(w)) % 3).astype(np.uint32)
        out.append([np.diff(h, prepend=np.uint64(0)), np.full(histories, words, np.uint32), w, n, 1 - n % 2, w + 1, np.full(histories, 9, np.int64), (1 + (h % np.uint64(5) == 0)).astype(np.uint64)])
    return out


def test_a_partition_answers_in_ranges_of_histories(monkeypatch):
    answer = ngrams._answerer(None, ngrams._Words(100, 10, np.array([4, 3, 2, 1, 1, 1])))
    monkeypatch.setattr(ngrams, "RANGE_ENTRIES", 10**9)
    whole = answer(0, _asked(histories=500))
    monkeypatch.setattr(ngrams, "RANGE_ENTRIES", 700)
    assert len(ngrams._bounds([[np.cumsum(a[0]), *a[1:]] for a in _asked(histories=500)])) > 5
    assert answer(0, _asked(histories=500)) == whole


def test_a_partition_takes_little_memory_beside_what_is_asked():
    answer, asked = ngrams._answerer(None, ngrams._Words(100, 10, np.array([4, 3, 2, 1, 1, 1]))), _asked()
    size = sum(x.nbytes for a in asked for x in a)
    tracemalloc.start()
    answer(0, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * size  # 3.6 where all entries were looked at together
