"""From buckets of possibly similar sets to connected components of confirmed links.

Vertices are named by 64-bit ids; each stands for a set, of which `Brief` columns (size and a sketch) travel with it
through buckets.  Small buckets give all their pairs; larger ones pair each member with one pivot.  What then still
lies in different components of one bucket goes through an exact set join of its own (`remaining_links`), so no link that
the buckets hold is lost between components, and no bucket gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text
from quarry.llm._work import saved
from quarry.llm.components import connected_components

SMALL = 16
#: Keys that a task looks through before it sends them; bytes of text for each partition that keys are dealt to.
BUFFER_KEYS, PART_BYTES = 1_000_000, 16 << 20
#: 64-bit words of a difference's bitmap.
MAP_WORDS = 8
#: Minwise values of a sketch, two bits of each of which are kept; standard deviations by which a pair's sketches may
#: differ beyond what its least similarity lets expect.
VALUES, DEVIATIONS = 64, 5

_ONES = np.uint64(1) << np.arange(VALUES, dtype=np.uint64)


def band_keys(least: np.ndarray, rows: int, salt: int = 0) -> np.ndarray:
    """64-bit keys of bands of `rows` minwise values each: one row a thing, one column a band."""
    bands = least.astype(np.uint64).reshape(len(least), least.shape[1] // rows, rows)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1000 * salt), bands.shape[:2]).copy()
    for k in range(rows):
        key = _text.mix(key * np.uint64(0x9FB21C651E98DF25) + bands[:, :, k])
    return key.view(np.int64)


def sketch_bits(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each of `VALUES` minwise values, as two numbers a row."""
    mixed = _text.mix(least.astype(np.uint64))
    return tuple((((mixed >> np.uint64(k)) & np.uint64(1)) * _ONES).sum(axis=1, dtype=np.uint64).view(np.int64) for k in (0, 1))


def most_bits(percent: int) -> int:
    """Bits that may differ: of each value that differs (a share of 1 - similarity of them) one of two on average."""
    apart = 1 - percent / 100
    mean, variance = VALUES * apart, VALUES * apart * (1 - apart) + VALUES * apart / 2
    return int(mean + DEVIATIONS * variance**0.5)


def bits_apart(x: str, y: str) -> Column:
    return F.bit_count(F.col(f"{x}.b1").bitwiseXOR(F.col(f"{y}.b1"))) + F.bit_count(F.col(f"{x}.b2").bitwiseXOR(F.col(f"{y}.b2")))


def sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def alike(x: str, y: str, percent: int) -> Column:
    """Whether two sketched sets may be linked: sizes allow it and few bits differ."""
    return sizes_allow(F.col(f"{x}.n"), F.col(f"{y}.n"), percent) & (bits_apart(x, y) <= most_bits(percent))


def _members(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct members in order of keys, and whether each one's key has others."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    same = keys[1:] == keys[:-1]
    return keys, ids, np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else new[:0]


def shared_buckets(source: DataFrame, signatures: Callable[[_text.Texts], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Buckets that hold two things at least: key, id.

    source: doc_id, text; signatures gives the keys and ids of a slice's things.  Keys are dealt to
    partitions as packed arrays, once a task.  Members of a key that a task itself finds shared need to meet nobody:
    the task sends one of them to the key's partition, and all of them to a partition of its own choice, so those of a
    frequent key are spread over as many partitions as tasks that hold it.
    """
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, size // PART_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        own_turn = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, ids, shared = _members(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            first = np.ones(len(keys), dtype=bool)
            first[1:] = keys[1:] != keys[:-1]
            out = []
            for chosen, meets in ((first, True), (shared, False)):
                part = (keys[chosen].view(np.uint64) >> np.uint64(16)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                names, begin = np.unique(part[order], return_index=True)
                pieces = np.split(order, begin[1:]) if len(names) else []
                out += [(int(p) if meets else -1 - (int(p) + own_turn) % parts, keys[chosen][own].tobytes(), ids[chosen][own].tobytes()) for p, own in zip(names, pieces, strict=True)]
            if out:
                parts_of, *columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(parts_of, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "keys", "ids"])

        waiting = 0
        for batch in batches:
            for _, texts in _text.slices(batch.column(1)):
                keys, ids = signatures(texts)
                if len(ids):
                    held.append((keys, ids))
                    waiting += keys.size
                if waiting >= BUFFER_KEYS:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        keys, ids = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int64) for c in ("keys", "ids"))
        if table.column("part")[0].as_py() >= 0:
            keys, ids, shared = _members(keys, ids)
            keys, ids = keys[shared], ids[shared]
        return pa.table({"key": pa.array(keys), "id": pa.array(ids)})

    sent = source.mapInArrow(send, "part bigint, keys binary, ids binary")
    return sent.groupBy("part").applyInArrow(meet, "key bigint, id bigint").distinct()


@dataclass
class Sets:
    """What is known of the sets that ids stand for.

    brief: id, n (size), b1, b2 (sketch).  confirm: of pairs (a < b) those that are links.  differences: of pairs
    (id, p) the elements that only one of both sets has: id, p, n, m (the sizes), d (array<bigint>).
    """

    brief: DataFrame
    confirm: Callable[[DataFrame], DataFrame]
    differences: Callable[[DataFrame], DataFrame]


def sets_of_items(kept: DataFrame, percent: int) -> Sets:
    """Sets given as a table: id, n, b1, b2, items (distinct elements, array<bigint>)."""
    first = kept.select(F.col("id").alias("a"), F.col("items").alias("x"))
    second = kept.select(F.col("id").alias("b"), F.col("items").alias("y"))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(first, "a").join(second, "b").where(sizes_allow(F.size("x"), F.size("y"), percent))
        counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("s"), (F.size("x") + F.size("y")).alias("t"))
        return counted.where(F.col("s") * 100 >= percent * (F.col("t") - F.col("s"))).select("a", "b")

    def differences(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.col("id").alias("a"), F.col("p").alias("b")).join(first, "a").join(second, "b")
        apart = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
        return both.select(F.col("a").alias("id"), F.col("b").alias("p"), F.size("x").alias("n"), F.size("y").alias("m"), apart.alias("d"))

    return Sets(kept.select("id", "n", "b1", "b2"), confirm, differences)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")]


def open_pairs(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far, with these (ca, cb)."""
    for end in ("a", "b"):
        own = components.select(F.col("id").alias(end), F.col("component").alias("c" + end))
        pairs = pairs.join(own, end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    return pairs.where("ca <> cb")


def widened(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components after confirmed links (a, b) are added."""
    between = saved(open_pairs(links.select("a", "b"), components))
    if between.isEmpty():
        return components
    above = connected_components(between, "ca", "cb").select(F.col("id").alias("component"), F.col("component").alias("top"))
    new = between.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(components, "id", "left_anti").withColumn("component", F.col("id"))
    return saved(components.unionByName(new).join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component")))


_MAP = tuple(f"w{k}" for k in range(MAP_WORDS))


def _bitmap(elements: str) -> list[Column]:
    """A bitmap of an array's elements (w0, w1, ...), and how many elements share a bit with others (spare)."""
    words = [f"aggregate({elements}, 0L, (s, x) -> IF(((x >> 6) & {MAP_WORDS - 1}) = {k}, s | shiftleft(1L, CAST(x & 63 AS INT)), s))" for k in range(MAP_WORDS)]
    spare = F.size(elements) - sum((F.bit_count(F.expr(w)) for w in words), F.lit(0))
    return [*(F.expr(w).alias(name) for w, name in zip(words, _MAP, strict=True)), spare.alias("spare")]


def remaining_links(rows: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links between members of different components in one bucket: a, b.  rows: key, id, component.

    Buckets whose largest component is the same form a family, for which one set of that component is the reference: the
    pivot.  Each member is written as its difference from the pivot, of which near copies have little.  With n elements in
    a set, d in its difference and t = (100 - percent) * (n + n') / (100 + percent), two sets are linked if and only if
    their differences share o = (d + d' - t) / 2 elements.  A link with o <= 0 leads through the pivot, for both are linked
    to that.  Any other shows among the rarest d - o + 1 elements of both (prefix filter), and only elements that
    different components have are joined; bitmaps of the differences bound what two share.  So all links between
    components are found without pairing members of a family.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("m.component").alias("main"))
    members = saved(rows.join(tops, "key").select("id", "component", "main").distinct())
    if members.isEmpty():
        return members.select(F.col("id").alias("a"), F.col("id").alias("b"))
    pivots = members.where("component = main").groupBy("main").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("p"))
    named = members.join(pivots, "main").withColumn("family", F.col("p"))
    known = saved(sets.differences(named.select("id", "p")).join(named, ["id", "p"]).withColumn("size", F.size("d")))
    keep, lose = 100 + percent, 100 - percent
    near = known.where(keep * F.col("size") <= lose * (F.col("n") + F.col("m")))
    to_pivot = near.where("id <> p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
    # what the pivot links is of its component; families that end as one are done
    joined = near.select("family", "component").distinct().withColumn("joined", F.lit(True))
    known = known.join(joined, ["family", "component"], "left").withColumn("component", F.when(F.col("joined"), F.col("main")).otherwise(F.col("component"))).drop("joined")
    split = known.where("component <> main").select("family").distinct()
    known = saved(known.join(split, "family", "left_semi").select("*", *_bitmap("d")))
    # elements from the rarest on, where different components have them
    spread = known.select("family", "id", "component", F.explode("d").alias("e"))
    counted = spread.groupBy("family", "e").agg(F.count("*").alias("f"), (F.min("component") < F.max("component")).alias("meets"))
    ranked = spread.join(counted, ["family", "e"]).groupBy("family", "id").agg(F.sort_array(F.collect_list(F.struct("f", "e", "meets"))).alias("order"))
    # a partner's set has at most n * 100 / percent elements, and differs in t from this one
    reach = F.floor(lose * (F.col("n") + F.col("n") * 100 / percent) / keep).cast("int") + 1
    facts = ("family", "id", "component", "main", "n", "size", "spare", *_MAP)
    first = known.join(ranked, ["family", "id"]).select(*facts, F.posexplode(F.slice("order", F.lit(1), reach)).alias("at", "element"))
    posts = saved(first.where("element.meets").select(*facts, "at", F.col("element.e").alias("e")))
    # a pivot of each element's holders joins most of them, then what is still apart is paired
    sent = F.struct("id", "component", "n", "size", "spare", *_MAP, "at")
    lead = posts.groupBy("family", "e").agg(F.min(F.struct(F.xxhash64("id", "e").alias("h"), sent.alias("y"))).alias("p")).select("family", "e", "p.y")
    led = posts.select("family", "e", sent.alias("x")).join(lead, ["family", "e"]).where(_may_link(percent)).select(*_ordered("x", "y"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb"))
    led = saved(led.groupBy("a", "b").agg(F.first("ca").alias("ca"), F.first("cb").alias("cb")))
    found = saved(led.join(sets.confirm(led), ["a", "b"]))
    above = connected_components(found, "ca", "cb").select(F.col("id").alias("component"), F.col("component").alias("top"))
    names = known.select("family", "id", "component", "main").join(above, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")
    names = names.join(above.select(F.col("component").alias("main"), F.col("top").alias("main_top")), "main", "left").withColumn("main", F.coalesce("main_top", "main")).drop("main_top")
    now = saved(posts.drop("component", "main").join(names, ["family", "id"]))
    apart_still = now.groupBy("family", "e").agg((F.min("component") < F.max("component")).alias("open")).where("open").select("family", "e")
    now = saved(now.join(apart_still, ["family", "e"]))
    x, y = now.where("component <> main").alias("x"), now.alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    met = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.e") == F.col("y.e")) & once & _may_link(percent))
    rest = sets.confirm(saved(met.select(*_ordered("x", "y")).distinct()))
    return saved(to_pivot.unionByName(found.select("a", "b")).unionByName(rest))


def _may_link(percent: int) -> Column:
    """Whether two holders x and y of an element, of different components, may be linked."""
    keep, lose = 100 + percent, 100 - percent
    twice = F.col("x.size") + F.col("y.size") - F.floor(lose * (F.col("x.n") + F.col("y.n")) / keep)
    share = F.ceil(F.greatest(twice, F.lit(1)) / 2)
    # shared elements take shared bits, but for those that share a bit with others of their set
    bits = sum((F.bit_count(F.col(f"x.{w}").bitwiseAND(F.col(f"y.{w}"))) for w in _MAP), F.lit(0))
    fits = (F.col("x.at") + share <= F.col("x.size")) & (F.col("y.at") + share <= F.col("y.size")) & sizes_allow(F.col("x.n"), F.col("y.n"), percent)
    return (F.col("x.component") != F.col("y.component")) & fits & (bits + F.least("x.spare", "y.spare") >= share)


def linked_components(rows: DataFrame, describe: Callable[[DataFrame], Sets], percent: int) -> DataFrame:
    """Components (id, component: the smallest id) of things that have links, from their buckets (key, id).

    describe(ids) gives what is known of the sets of all things that may have links, once.  Things without links may be
    absent.
    """
    rows = saved(rows)
    sets = describe(saved(rows.select("id").distinct()))
    rows = saved(rows.join(sets.brief, "id"))
    member = ("id", "n", "b1", "b2")
    turn = F.xxhash64("id", "key")
    sized = saved(rows.join(rows.groupBy("key").agg(F.count("*").alias("size"), F.min(turn).alias("least")), "key"))
    small = sized.where(F.col("size") <= SMALL).select("key", *member)
    large = sized.where(F.col("size") > SMALL)
    pivot = large.where(turn == F.col("least")).groupBy("key").agg(F.min(F.struct(*member)).alias("p"))
    same = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & alike("x", "y", percent)).select(*_ordered("x", "y"), bits_apart("x", "y").alias("bits"))
    starred = large.join(pivot, "key").select(F.struct(*member).alias("x"), "p").where("x.id <> p.id").where(alike("x", "p", percent)).select(*_ordered("x", "p"), bits_apart("x", "p").alias("bits"))
    pairs = saved(same.unionByName(starred).distinct())
    # first each thing with its most promising partner, then only pairs that still lie in different components
    turned = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "bits"))
    best = turned.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("p")).select(F.least("a", "p.b").alias("a"), F.greatest("a", "p.b").alias("b")).distinct()
    components = saved(connected_components(sets.confirm(best)))
    rest = saved(open_pairs(pairs, components).select("a", "b"))
    if not rest.isEmpty():
        components = widened(components, saved(sets.confirm(rest)))
    if not large.isEmpty():
        named = large.select("key", "id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
        components = widened(components, remaining_links(named, sets, percent))
    return components
