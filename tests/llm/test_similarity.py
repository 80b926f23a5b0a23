"""Near copies, lines and paragraphs against plain computations of all pairs; components; nearest neighbours."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, line_dedup, linking, near_dedup, paragraphs
from quarry.llm.components import connected_components


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def alike(sets, percent):
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        yield from ((j, k) for j, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n))
        for x in s:
            holders[x].append(k)


def shingles(text, width):
    w = lower(text).split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def copies(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 120)))) for i in range(100, 160)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(200, 290):  # a large group of near copies, some of which are not linked with each other
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    rows += [(300 + k, rows[0][1].upper()) for k in range(40)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "ONE"), (405, "one two"), (None, rows[0][1]), (100, rows[0][1]), (150, rows[51][1]), (150, "other words")]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, monkeypatch, width, percent):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rows = copies()
    sets = [shingles(t, width) for _, t in rows]
    ids = [i for i, _ in rows]
    links = [(a, b) for a, b in alike(sets, percent) if ids[a] is not None and ids[b] is not None]
    links += [(a, b) for a in range(len(rows)) for b in range(a) if ids[a] is not None and ids[a] == ids[b]]
    root = roots(len(rows), links)
    least = defaultdict(lambda: math.inf)
    for k, r in enumerate(root):
        if ids[k] is not None:
            least[r] = min(least[r], ids[k])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(0))
    got = sorted(map(tuple, near_dedup.components_of(df, width=width, percent=percent).collect()), key=str)
    expected = [(i, len(s), None if i is None else least[r], True if i is None else i == least[r]) for i, s, r in zip(ids, sets, root, strict=True)]
    assert got == sorted(expected, key=str)


def test_near_copies_of_nothing(spark):
    assert near_dedup.components_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = near_dedup.components_of(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]


def test_lines(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (-3, "short\n\nshort"), (-4, "a" * 5000), (-5, "a" * 5000 + "b"), (-6, "   The quick brown fox jumps over the lazy dog, again and again.  \nthe quick brown fox jumps over the lazy dog, again and agein."), (None, "x" * 99)]
    places = [(i, k, b) for i, t in docs if i is not None for k, b in enumerate(line.strip(b" \t\n\r\x0b\x0c") for line in lower(t).split(b"\n")) if len(b) >= 24]
    contents = sorted({b for *_, b in places})
    sets = [{b[k : k + 8] for k in range(len(b) - 7)} for b in contents]
    root = dict(zip(contents, roots(len(contents), alike(sets, 85)), strict=True))
    first, gone = {}, defaultdict(list)
    for i, k, b in sorted(places):
        if first.setdefault(root[b], (i, k)) != (i, k):
            gone[i].append(k)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.op9_line_dedup(df).collect()}
    assert len(got) == len(docs) and {i: r for i, r in got.items() if r} == dict(gone)
    left = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(df, line_dedup.removals(df).where("NOT kept")).collect()}
    for i, text in docs:
        assert left[i] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(i, ())))


def test_paragraphs(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(60)]
    for i in range(-40, 0):  # a passage that many documents share, with a change here and there
        own = list(passage)
        if i % 3 == 0:
            own[rng.randrange(60)] = "changed"
        docs.append((i, f"own words {i}\n{' '.join(own)}\nmore {i}"))
    docs += [(-50, None), (-51, ""), (-52, "w " * 60), (-53, "w " * 61)]
    docs.append((-60, "in other words " + " ".join(f"a{k}" for k in range(40)) + " " + " ".join(passage) + "\nand " + " ".join(f"b{k}" for k in range(30))))
    wrapped = [f"q{k}" for k in range(55)]
    docs += [(-70, " ".join(f"c{k}" for k in range(70)) + " " + " ".join(wrapped) + " " + " ".join(f"d{k}" for k in range(70))), (-71, "start " + "\n".join(" ".join(wrapped[k : k + 8]) for k in range(0, 55, 8)) + "\nend " + " ".join(f"e{k}" for k in range(9)))]
    docs += [(-80, " ".join(f"f{k}" for k in range(200))), (None, " ".join(wrapped)), (-40, docs[-1][1])]

    def places():
        for i, t in docs:
            begin = 0
            for x in lower(t).split(b"\n") if i is not None else ():
                if len(x.split()) >= 40:
                    yield i, begin, frozenset(shingles(x.decode(), 5))
                begin += len(x.split())

    contents = list({s for *_, s in places()})
    root = dict(zip(contents, roots(len(contents), alike(contents, 80)), strict=True))
    groups = defaultdict(list)
    for i, k, s in places():
        groups[root[s]].append((i, k))
    expected = {p: min(g) for g in groups.values() if len(g) > 1 for p in g}
    shared = {p: min(g) for g in groups.values() if len({i for i, _ in g}) > 1 for p in g}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("begin", F.lit(0))
    got = paragraphs.op4_paragraph_dedup(df).collect()
    assert {(r["doc_id"], r["begin"]): (r["keeper_doc_id"], r["keeper_begin"]) for r in got if r["kind"] == "paragraph"} == shared
    every = paragraphs.repeated_units(df).where("kind = 'paragraph'").collect()
    assert {(r["doc_id"], r["begin"]): (r["keeper_doc_id"], r["keeper_begin"]) for r in every} == expected
    passages = {r["doc_id"]: r for r in got if r["kind"] == "passage"}
    assert {-60, -70, -71, -1} <= set(passages) and not {-80, -50, -51, None} & set(passages)
    assert passages[-70]["keeper_doc_id"] == passages[-71]["keeper_doc_id"] == -71 and passages[-60]["span_words"] >= 30
    left = {r["doc_id"]: r["text"] for r in paragraphs.without_units(df, paragraphs.op4_paragraph_dedup(df).where("NOT kept")).collect() if r["doc_id"] != -40}
    assert left[-71] == docs[-4][1] and left[-80] == docs[-3][1] and left[-50] is None
    assert left[-70].startswith("c0 c1") and left[-70].endswith("d69") and "q25" not in left[-70]
    assert paragraphs.op4_paragraph_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_between_components_of_a_family(spark):
    """A large family about the threshold: all components as all pairs give them, whatever the buckets' pivots reached."""
    rng = random.Random(5)
    base = list(range(100))
    sets = []
    for k in range(400):  # from far to near copies of two centres
        own = set(base if k % 3 else base[:70] + list(range(500, 530)))
        for gone in rng.sample(sorted(own), rng.randint(0, 12)):
            own.remove(gone)
            own.add(rng.randrange(10**6, 10**6 + 300))
        sets.append(own)
    links = set(alike(sets, 85))
    for share in (0.0, 0.02, 1.0):  # of the links that are known before
        some = [x for x in sorted(links) if rng.random() < share]
        before = roots(len(sets), some)
        kept = spark.createDataFrame([(k, len(s), 0, 0, sorted(s)) for k, s in enumerate(sets)], "id long, n long, b1 long, b2 long, items array<bigint>")
        rows = spark.createDataFrame([(key, k, before[k]) for k in range(len(sets)) for key in (1, 2 + k % 2)], "key long, id long, component long")
        found = {(r["a"], r["b"]) for r in linking.remaining_links(rows, linking.sets_of_items(kept, 85), 85).collect()}
        assert found <= links
        assert roots(len(sets), [*some, *found]) == roots(len(sets), links)


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 100), (7, 7), (200, 90), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 100: 90, 200: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 8)).astype(np.float32)
    x[300:340] = x[100]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [None] * 8), (1400, [1.0]), (None, x[0].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    found = defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(found) == list(range(0, 900, 100))
    hits = 0
    for q, own in found.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((np.arange(900), d)) if k != q][:10]
        assert sorted(own) == list(range(1, 11))
        assert all(score == pytest.approx(d[i], abs=1e-12) for i, score in own.values())
        assert [i for _, (i, _) in sorted(own.items())] == sorted((i for i, _ in own.values()), key=lambda i: (d[i], i))
        hits += len({i for i, _ in own.values()} & set(order))
    assert hits >= 0.95 * 10 * len(found)


def test_nearest_of_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0
