"""Conversation repair against a search over all edits and a plain dynamic programme from the end."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def digest_order(row):
    role, text = row
    return bytes.fromhex(hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest())


def faults(rows):
    """(role, text, must go, cut off) of rows in order, and the counts of faults."""
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        bare = text.strip(SPACE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        if bare:
            seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        out.append((role, text, fault in (0, 1), fault == 2))
    return out, counts


def searched(rows):
    """The cheapest edits among all, by trying them (two insertions in a row at most)."""
    rows, best = faults(rows)[0], None
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    choices = [[("D", None, 4)] if gone else [("D", None, 4), ("K", role, 3 * cut), ("R", "user", 3 + 3 * cut), ("R", "assistant", 3 + 3 * cut)] for role, _, gone, cut in rows]
    for between in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            cost, audit, made = 0, "", []
            for k, gap in enumerate(between):
                cost, audit = cost + 3 * len(gap), audit + "I" * len(gap)
                made += [(r, "") for r in gap]
                if k < len(rows):
                    name, role, price = edits[k]
                    cost, audit = cost + price, audit + name
                    made += [(role, rows[k][1])] if role is not None else []
            if (best is None or (cost, audit) < best[:2]) and PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in made)):
                best = cost, audit, made
    return best


def planned(rows):
    """The same from the end, for longer conversations."""
    rows = faults(rows)[0]
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                to = after.get((state, role[0]))
                if to and (rest := best(i, to, inserted + 1)):
                    found.append((rest[0] + 3, "I" + rest[1], ((role, ""), *rest[2])))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            if rest := best(i + 1, state, 0):
                found.append((rest[0] + 4, "D" + rest[1], rest[2]))
            for name, new, price in [] if gone else [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                to = after.get((state, new[:1]))
                if to and (rest := best(i + 1, to, 0)):
                    found.append((rest[0] + price + 3 * cut, name + rest[1], ((new, text), *rest[2])))
        return min(found, default=None)

    cost, audit, made = best(0, "", 0)
    return cost, audit, list(made)


def expected(rows, solve):
    """The whole result of one conversation from (turn, role, text) rows in any order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest_order(r[1:])))
    said = [r[1:] for r in rows]
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, made = solve(said)
    initials = [r[:1] for r, _ in said]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *faults(said)[1], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()


def values(row):
    return tuple(row[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def made_up(rng, count, longest, start=0):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "usher", "User"], ["Yes.", "No", "Why?", "", " \n", None, "Ok! ", "é…"]
    rows = []
    for conv in range(start, start + count):
        for _ in range(rng.randint(1, longest)):
            role = rng.choice(roles[:3] if rng.random() < 0.8 else roles)
            text = rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}{rng.choice(['.', ''])}"
            rows.append((conv, rng.choice([None, *range(8), -5, 10**15 + 1]), role, text))
    return rows


def by_conversation(rows):
    found = {}
    for conv, *row in rows:
        found.setdefault(conv, []).append(tuple(row))
    return found


def test_short_conversations_against_all_edits(spark):
    rows = made_up(random.Random(1), 60, 2) + made_up(random.Random(2), 6, 3, 100)
    got = {r["conv_id"]: values(r) for r in dialogues.repairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {conv: expected(own, searched) for conv, own in by_conversation(rows).items()}


@pytest.mark.parametrize("block", [dialogues.BLOCK, 7])
def test_longer_conversations_and_spilled_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(dialogues, "BLOCK", block)
    rng = random.Random(3)
    rows = made_up(rng, 150, 14) + made_up(rng, 3, 120, 500) + [(None, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("digest", F.lit("clash"))
    stream, run = dialogues._stream, df.repartition(3)
    if block < 100:  # workers import the module: hand them the small block

        def small(batches):
            dialogues.BLOCK = block
            return stream(batches)

        monkeypatch.setattr(dialogues, "_stream", small)
    found = dialogues.repairs(run)
    got = {r["conv_id"]: values(r) for r in found.collect()}
    assert got == {conv: expected(own, planned) for conv, own in by_conversation(rows).items()}
    made = dialogues.repaired(df, found).orderBy("conv_id", "position").collect()
    texts = {}
    for r in made:
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == row[-1] for conv, row in got.items())
    assert all((r["turn"] is None) for r in made if r["edit"] == "I")


def test_query_on_a_whole_table(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in conversations.collect()] + [(10**6, None, None, None), (10**6, 3, None, None)]
    rows += [(c, t, "user", "Gone.") for c in range(10**7, 10**7 + 300) for t in [0]]
    left = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text or " ") if fault == 2 else text
        left[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = {r["conv_id"]: values(r) for r in dialogues.op12_dialogue_repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == {conv: expected(own, planned) for conv, own in left.items()}
    assert any(not own for own in left.values())


def test_empty_tables(spark):
    assert dialogues.op12_dialogue_repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_giant_conversation_in_bounded_memory(spark):
    rows = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, if(id % 97 = 5, '', '.')) AS text")
    r = dialogues.repairs(rows).first()
    assert (r["truncated"], r["illegal"], r["gaps"], r["audit"]) == (sum(k % 97 == 5 for k in range(30_000)), 0, 0, "K" * 30_000)
    assert r["cost"] == 3 * r["truncated"]
