"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A repaired conversation is empty or has the role initials `s?(ua)+`.  A row is kept (K, free), given the role user or
assistant (R, 3) or deleted (D, 4; blank rows and repeats must be); rows of empty text are inserted anywhere (I, 3);
a truncated row that stays costs 3 more.  Of equally cheap edits those whose initials are least in ASCII are taken.

One shuffle brings a conversation's rows together, sorted by turn; a task then streams them and carries over Arrow
batches what the dynamic programme knows: for each of four states of the pattern its cost, its rank among equals and
the digest of the rows repaired so far.  The edits that led to each state take four bytes a row; a conversation of
more than `BLOCK` rows spills them as rows of the task's output, which a second pass follows from the end.  Whether
a row repeats an earlier one is decided before, by a partial aggregate over digests, whose first places are sorted in
among the rows; so no task remembers what it has seen.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._work import saved

#: Rows of a conversation whose edits a task holds before it spills them.
BLOCK = 1 << 20

# fixed values: costs of edits, white space, and the ends of whole sentences
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: States of the pattern by what was emitted last: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of some role initial; None where the pattern forbids it.
AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "": (None,) * 4}
#: By state: the role of an inserted or renamed row, and how many insertions end the pattern.
NEXT, FINISH = ("user", "user", "assistant", "user"), (0, 2, 1, 0)
EDITS = "DKR"
#: A state that costs more than this over the cheapest can't be part of the cheapest edits: another state reaches
#: whatever it reaches with two insertions, or an insertion and a deletion.
BEHIND = 7


def _insertions(state: int) -> list[tuple[int, int]]:
    """How many rows may be inserted in a state (more would only come back), and the states after them."""
    found = [(0, state)]
    while len(found) < (3 if state < USER else 2):
        found.append((len(found), AFTER[NEXT[found[-1][1]][0]][found[-1][1]]))
    return found


INSERTIONS = [_insertions(state) for state in range(4)]


class Programme:
    """Steps of the dynamic programme, remembered by state of knowledge and kind of row.

    Knowledge is, for each state, None or (cost over the cheapest, rank); ranks order the edits that led there.
    """

    def __init__(self) -> None:
        self.steps: dict[tuple, tuple] = {}

    def step(self, knowledge: tuple, kind: tuple) -> tuple:
        """Knowledge after a row, the cheapest cost added, the moves by state and the moves packed."""
        found = self.steps.get((knowledge, kind))
        if found is None:
            found = self.steps[knowledge, kind] = self._step(knowledge, kind)
        return found

    def _step(self, knowledge: tuple, kind: tuple) -> tuple:
        initial, doomed, cut_off = kind
        best: list[tuple | None] = [None] * 4
        for state, known in enumerate(knowledge):
            if known is None:
                continue
            for count, at in INSERTIONS[state]:
                base = known[0] + INSERT * count
                reached = [(at, base + DELETE, 0)]
                if not doomed:
                    reached.append((AFTER[initial][at], base + CUT_OFF * cut_off, 1))
                    reached.append((AFTER[NEXT[at][0]][at], base + CUT_OFF * cut_off + REROLE, 2))
                for to, cost, edit in reached:
                    option = (cost, known[1], "I" * count + EDITS[edit], state, count, edit)
                    if to is not None and (best[to] is None or option < best[to]):
                        best[to] = option
        least = min(x[0] for x in best if x)
        best = [x if x and x[0] - least <= BEHIND else None for x in best]
        order = sorted((x[1:3], to) for to, x in enumerate(best) if x)
        rank = {to: k for k, (_, to) in enumerate(order)}
        moves = [(to, *x[3:]) for to, x in enumerate(best) if x]
        packed = sum((state << 4 | count << 2 | edit) << 6 * to for to, state, count, edit in moves)
        return tuple((x[0] - least, rank[to]) if x else None for to, x in enumerate(best)), least, moves, packed


_INSERTED = ["user:", "\nuser:", "\nassistant:", "\nuser:"]


def _inserted(state: int, count: int) -> bytes:
    out = ""
    for _, at in INSERTIONS[state][:count]:
        out += _INSERTED[at]
    return out.encode()


INSERTED = [[_inserted(state, count) for count in range(3)] for state in range(4)]


class Dialogue:
    """What is known of one conversation while its rows pass."""

    def __init__(self, programme: Programme):
        self.programme, self.knowledge, self.cost = programme, ((0, 0), None, None, None), 0
        self.digests = [hashlib.sha256(), None, None, None]
        self.moves, self.spilled = array("I"), 0
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, earlier: bool) -> None:
        initial, bare = role[:1], text.rstrip(SPACE)
        doomed, cut_off = not bare or earlier, bool(bare) and not earlier and bare[-1] not in ENDS
        self.blank += not bare
        self.duplicate += bool(bare) and earlier
        self.truncated += cut_off
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.knowledge, more, moves, packed = self.programme.step(self.knowledge, (initial if initial in AFTER else "", doomed, cut_off))
        self.cost += more
        self.moves.append(packed)
        digests: list = [None] * 4
        row = None if doomed else f":{text}".encode()
        for to, state, count, edit in moves:
            digest = digests[to] = self.digests[state].copy()
            if count:
                digest.update(INSERTED[state][count])
            if edit:
                at = INSERTIONS[state][count][1]
                digest.update((("" if at == START else "\n") + (role if edit == 1 else NEXT[at])).encode())
                digest.update(row)
        self.digests = digests

    def end(self) -> tuple[int, int, str]:
        """The state in which the cheapest edits leave the last row, their cost and the digest of what they give."""
        _, _, state = min((known[0] + INSERT * FINISH[state], known[1], state) for state, known in enumerate(self.knowledge) if known)
        digest = self.digests[state].copy()
        digest.update(INSERTED[state][FINISH[state]])
        return state, self.cost + self.knowledge[state][0] + INSERT * FINISH[state], digest.hexdigest()


def followed(moves: array, state: int) -> tuple[str, int]:
    """The initials of the edits that led to a state over these rows, and the state before them."""
    edits = []
    for packed in reversed(moves):
        move = packed >> 6 * state & 63
        edits.append("I" * (move >> 2 & 3) + EDITS[move & 3])
        state = move >> 4
    return "".join(reversed(edits)), state


_KINDS = {"id": "string", "block": "long", "moves": "binary", "state": "int", "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
_FOUND = ", ".join(f"{name} {kind}" for name, kind in _KINDS.items())
FIRST, ROW, PRESENT = 0, 1, 2


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    programme, dialogue, current, first_place = Programme(), None, None, None
    out: list[tuple] = []

    def spill(state: int | None = None) -> None:
        out.append((current, dialogue.spilled, dialogue.moves.tobytes(), state, *[None] * 8))
        dialogue.moves, dialogue.spilled = array("I"), dialogue.spilled + 1

    def close() -> None:
        state, cost, digest = dialogue.end()
        gaps = 0 if dialogue.turns == 0 else min(dialogue.last - dialogue.first + 1 - dialogue.turns, (1 << 63) - 1)
        audit = None
        if dialogue.spilled:
            spill(state)
        else:
            audit = followed(dialogue.moves, state)[0] + "I" * FINISH[state]
        out.append((current, None, None, state, gaps, dialogue.blank, dialogue.duplicate, dialogue.truncated, dialogue.illegal, cost, audit, digest))

    def frame() -> pd.DataFrame:
        columns = zip(*out, strict=True) if out else [[]] * len(_KINDS)
        made = pd.DataFrame({name: pd.Series(list(values), dtype=object) for name, values in zip(_KINDS, columns, strict=True)})
        out.clear()
        return made

    for batch in batches:
        for key, given, turn, digest, kind, role, text in zip(*(batch[c].tolist() for c in ("id", "given", "turn", "digest", "kind", "role", "text")), strict=True):
            if dialogue is None or key != current:
                if dialogue is not None:
                    close()
                dialogue, current, first_place = Dialogue(programme), key, None
            if kind == FIRST:
                first_place = digest
            elif kind == ROW:
                dialogue.add(turn if given else None, role, text, digest != first_place)
                first_place = None
                if len(dialogue.moves) >= BLOCK:
                    spill()
        if out:
            yield frame()
    if dialogue is not None:
        close()
    yield frame()


def _back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follows spilled edits from a conversation's last block to its first."""
    state = START
    for batch in batches:
        rows = []
        for key, number, moves, end in zip(*(batch[c].tolist() for c in ("id", "block", "moves", "state")), strict=True):
            last = end == end and end is not None
            edits, state = followed(array("I", moves), int(end) if last else state)
            rows.append((key, number, edits + ("I" * FINISH[int(end)] if last else "")))
        yield pd.DataFrame(rows, columns=["id", "block", "edits"], dtype=object)


def _texts(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows as the stream takes them; ids as strings, so that none is rounded where some are null."""
    said = rows.select(F.col(conv_id).cast("string").alias("id"), F.col(turn).isNotNull().alias("given"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    return said.select("id", "given", "turn", F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("digest"), F.lit(ROW).alias("kind"), "role", "text")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("id").sortWithinPartitions("id", "given", "turn", "digest", "kind")


def repairs(rows: DataFrame, also: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults and cheapest edits of each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of `role:text` lines).

    Conversations of `also` that have no rows have zeros, an empty audit and the digest of nothing.  Null conv_ids are one
    conversation; null roles and texts are one space; null turns come first and don't count for gaps, which are at most
    2**63 - 1.  Rows of one turn are taken in the order of a digest of role and text, so equal rows stand together.
    Repeated rows are repeats like any other; empty tables give no rows; other columns are ignored, whatever their names.
    """
    said = _texts(rows, conv_id, turn, role, text)
    first = said.where(F.btrim("text", F.lit(SPACE)) != "").groupBy("id", "digest").agg(F.min(F.struct("given", "turn")).alias("at"))
    none = F.lit(None).cast("string")
    stream = said.unionByName(first.select("id", "at.given", "at.turn", "digest", F.lit(FIRST).alias("kind"), none.alias("role"), none.alias("text")))
    if also is not None:
        present = also.select(F.col(conv_id).cast("string").alias("id")).distinct()
        stream = stream.unionByName(present.select("id", F.lit(False).alias("given"), F.lit(0).cast("long").alias("turn"), F.lit(b"").alias("digest"), F.lit(PRESENT).alias("kind"), none.alias("role"), none.alias("text")))
    found = saved(_sorted(stream).mapInPandas(_stream, _FOUND))
    whole = found.where("block IS NULL").drop("block", "moves", "state")
    # conversations that spilled: edits block by block from the last one, which knows the state at the end
    blocks = found.where("block IS NOT NULL").select("id", "block", "moves", "state")
    pieces = blocks.repartition("id").sortWithinPartitions("id", F.desc("block")).mapInPandas(_back, "id string, block long, edits string")
    edits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda p: p["edits"]), "")
    joined = pieces.groupBy(F.col("id").alias("owner")).agg(edits.alias("edits"))
    return whole.join(joined, F.col("id").eqNullSafe(F.col("owner")), "left").select(F.col("id").cast(rows.schema[conv_id].dataType).alias(conv_id), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.coalesce("audit", "edits").alias("audit"), "repaired_sha256")


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Applies each conversation's edits, which stand before its rows."""
    state = START
    current: str | None = None
    audit, at, position, begun = "", 0, 0, False
    out: list[tuple] = []

    def put(turn: int | None, role: str, text: str, edit: str) -> None:
        nonlocal state, position
        out.append((current, position, None if turn is None else str(turn), role, text, edit))
        state, position = AFTER[role[:1]][state], position + 1

    def insert() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put(None, NEXT[state], "", "I")
            at += 1

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["id", "position", "turn", "role", "text", "edit"], dtype=object)
        out.clear()
        return made

    for batch in batches:
        for key, given, turn, kind, role, text in zip(*(batch[c].tolist() for c in ("id", "given", "turn", "kind", "role", "text")), strict=True):
            if kind != ROW:
                if begun:
                    insert()
                current, audit, at, position, state, begun = key, text, 0, 0, START, True
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit != "D":
                put(turn if given else None, role if edit == "K" else NEXT[state], text, edit)
        yield frame()
    if begun:
        insert()
    yield frame()


def repaired(rows: DataFrame, found: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows that `repairs` found for these rows: conv_id, position, turn (null where inserted), role, text, edit.

    Deleted rows are left out; rows and nulls are taken as in `repairs`.
    """
    audits = found.select(F.col(conv_id).cast("string").alias("id"), F.lit(False).alias("given"), F.lit(-(1 << 63)).cast("long").alias("turn"), F.lit(b"").alias("digest"), F.lit(FIRST).alias("kind"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    made = _sorted(_texts(rows, conv_id, turn, role, text).unionByName(audits)).mapInPandas(_applied, "id string, position long, turn string, role string, text string, edit string")
    return made.select(F.col("id").cast(rows.schema[conv_id].dataType).alias(conv_id), "position", F.col("turn").cast("long").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "edit")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the hash of `conv_id:turn`: conv_id, turn, role, text (nulls: one space)."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    role = F.when(F.col("fault") == 4, "user").otherwise(named("role"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    left = conversations.withColumn("fault", fault).where("fault <> 0")
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_dialogue_repair(conversations: DataFrame) -> DataFrame:
    """The result of `repairs` over all conversations after `damaged`; conversations of which no row is left stay."""
    own = conversations.select("conv_id", "turn", "role", "text")
    return repairs(damaged(own), also=own)
