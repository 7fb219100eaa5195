"""MinHash near-duplicates with tensored banding.

Two small collections of partial keys are computed for each distinct shingle set, each partial key from ``HASHES`` minhashes; a
table's key is a pair of one partial key of either collection. ``KEYS`` partial keys a collection give KEYS**2 tables for the
price of 2 * KEYS * HASHES minhashes. A pair with a similarity of 0.8 shares no table with a probability of 1e-4 or less, a pair
with one of 0.05 shares one with a probability of 3e-6.

Equal sets are one class from the start, so groups of copies of any size cost one row. Buckets of up to ``SMALL`` classes give
all their pairs as candidates, larger ones only pairs with their smallest class; of a class in larger buckets, one row tells which of
its partial keys of the first collection these have. After the candidates have been verified and connected, such classes meet again
by each of those partial keys: whoever shares a bucket shares one of them, and a class has KEYS of them at most, where it may be in
KEYS**2 buckets. A group that still holds different components compares the pairs between them, as far as enough of their partial
keys agree; a pair that isn't together in the group of the first partial key it shares has met in a small bucket. For that it is cut into blocks of about ``BLOCK``
classes and each pair of blocks is a task of its own; classes of the group's largest component are only compared with the others.
Every link is confirmed on the full sets.

Defined cases: a null or wordless text has an empty set and is linked with nothing; a null ``doc_id`` takes part in no link, has
a null component and is kept; rows that share an id but not their words are documents of their own, told apart by their class,
and both kept if both have the smallest id of what they are linked with; repeated rows share a class, and so component and
verdict; input columns besides doc_id and text are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.runtime import cut_lineage, few, sweep

KEYS, HASHES = 14, 3
SMALL = 8
#: In those groups, pairs across components need so many of the 2 * KEYS partial keys to agree; linked ones share 14 on average, and fewer
#: than these with a probability of 2e-5.
AGREE = 4
#: Percent of the union that two linked sets share at least.
PERCENT = 80
WORDS = 2
#: Members compared with one copy of a center's text in one task.
MEMBERS = 128
#: Classes of a group in a block.
BLOCK = 1024
#: Most rows of the table of rejected and repeated documents for which it is broadcast.
BROADCAST_ROWS = 1_000_000

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashed shingle sets; remembers hashes of words."""

    MEMO = 500_000

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def set_of(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        import xxhash

        found = text.encode().lower().split()  # bytes: A-Z only, and white space of ASCII only
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.memo) > self.MEMO:
            self.memo.clear()
        memo, known = self.memo, []
        for w in found:
            h = memo.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(w) <= 64:
                    memo[w] = h
            known.append(h)
        h = np.array(known, np.uint64)
        size = min(self.words, len(h))
        out = np.full(len(h) - size + 1, np.uint64(size))
        for k in range(size):
            out = _mix(out * _C1 + h[k : len(h) - size + 1 + k])
        return np.unique(out)


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, 2 * KEYS * HASHES, dtype=np.uint64), rng.integers(0, 2**63, 2 * KEYS * HASHES, dtype=np.uint64) | np.uint64(1)


def partial_keys(shingles: np.ndarray) -> np.ndarray:
    """The two collections, one after the other: 2 * KEYS partial keys."""
    flips, odds = _seeds()
    least = np.full(len(odds), np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None] ^ flips
        part *= odds
        np.minimum(least, part.min(0), out=least)
    triples = _mix(least).reshape(2 * KEYS, HASHES)
    out = np.arange(1, 2 * KEYS + 1, dtype=np.uint64)
    for k in range(HASHES):
        out = _mix(out * _C1 + triples[:, k])
    return out


def table_keys(partial: np.ndarray) -> np.ndarray:
    """KEYS**2 table keys of each row of partial keys."""
    a, b = partial[:, :KEYS], partial[:, KEYS:]
    return _mix(a[:, :, None] * _C1 + b[:, None, :]).reshape(len(partial), -1)


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, class (a digest of the set, null for an empty one) and keys (partial keys as longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler()
        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column(2).to_pylist():
                s = own.set_of(text or "")
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(partial_keys(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "n_shingles", "class", "keys"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, n_shingles long, class binary, keys array<long>")


def _buckets(classes: DataFrame) -> DataFrame:
    """Of the tables' buckets with two classes or more: candidate pairs (u, v; mask null) and, once for each class v in large buckets, u null
    and mask, a bit for each of its partial keys of the first collection that a large bucket has."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys = table_keys(np.array(part.column(2).flatten()).view(np.uint64).reshape(-1, 2 * KEYS)).reshape(-1, KEYS, KEYS)
                # Which partial key of the first collection it is: in the last four bits, so that it needs no column.
                keys = (keys & ~np.uint64(15) | np.arange(KEYS, dtype=np.uint64)[:, None]).view(np.int64)
                ids, n = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), KEYS * KEYS) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(n)], ["key", "id", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []  # of the bucket so far, SMALL members at most, the smallest first
        out: list[tuple] = []
        count, now = 0, None

        def pair(x, y) -> None:
            if 100 * min(x[1], y[1]) >= PERCENT * max(x[1], y[1]):
                out.append((x[0], y[0], None))

        def close() -> None:
            if 1 < count <= SMALL:
                for i, x in enumerate(held):
                    for y in held[i + 1 :]:
                        pair(x, y)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "mask"])

        for batch in batches:
            for key, i, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    close()
                    held, count, now = [], 0, key
                count += 1
                if count <= SMALL:
                    held.append((i, n))
                else:
                    if count == SMALL + 1:
                        for x in held:
                            out.append((None, x[0], 1 << (key & 15)))
                        for x in held[1:]:
                            pair(held[0], x)
                    out.append((None, i, 1 << (key & 15)))
                    pair(held[0], (i, n))
            yield flush()
        close()
        yield flush()

    rows = classes.select("id", "n", "keys").mapInArrow(emit, "key long, id long, n long")
    found = rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(pairs, "u long, v long, mask long")
    return found.groupBy("u", "v").agg(F.bit_or("mask").alias("mask"))


def _candidates(key: int, side: np.ndarray, ids: np.ndarray, labels: np.ndarray, n: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one task's classes to compare: of either side (all, if there is one side), of different components, of sizes that
    allow a link, with AGREE partial keys in common at least, some of either collection, and with this group's as the first that they
    share, so that no other group gives the pair again."""
    step = max(1, 1_000_000 // len(ids))
    two = bool(side.any())
    for i in range(0, len(ids), step):
        rows = slice(i, i + step)
        near = 100 * np.minimum(n[rows, None], n) >= PERCENT * np.maximum(n[rows, None], n)
        near &= labels[rows, None] != labels
        near &= side[rows, None] < side if two else ids[rows, None] < ids
        x, y = np.nonzero(near)
        for j in range(0, len(x), 100_000):
            a, b = x[j : j + 100_000] + i, y[j : j + 100_000]
            same = keys[a] == keys[b]
            keep = same.sum(1) >= AGREE
            a, b, same = a[keep], b[keep], same[keep]
            first = keys[a, same[:, :KEYS].argmax(1)]
            own = (first == np.uint64(key & (2**64 - 1))) & same[:, :KEYS].any(1) & same[:, KEYS:].any(1)
            if own.any():
                yield a[own], b[own]


def _tasks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come sorted by their first three columns, as (those, other columns of their rows)."""
    now, held = None, []
    for batch in batches:
        key, x, y, *cols = (c.to_pylist() for c in batch.columns)
        for *at, row in zip(key, x, y, zip(*cols, strict=True), strict=True):
            if at != now:
                if held:
                    yield tuple(now), held
                now, held = at, []
            held.append(row)
    if held:
        yield tuple(now), held


def _in_tasks(members: DataFrame) -> DataFrame:
    """``members`` (key, id, label, ...) once for each pair of blocks that they are in: x and y, the blocks, and side, 1 for a member of
    the second of two blocks. Groups of one component have nothing to compare and go."""
    own = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    most = own.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("total"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK))
    cut = most.where("total > top.m").select("key", F.col("top.label").alias("major"), blocks(F.col("top.m")).alias("majors"), blocks(F.col("total") - F.col("top.m")).alias("minors"))
    placed = members.join(cut, "key").withColumn("of_major", F.col("label") == F.col("major"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("of_major"), F.col("majors")).otherwise(F.col("minors")))
    spot = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0).cast("long")
    of_major = F.transform(upto(zero, F.col("minors") - 1), lambda x: spot(x, F.col("minors") + F.col("block"), 1))
    first = F.transform(upto(F.col("block"), F.col("minors") + F.col("majors") - 1), lambda y: spot(F.col("block"), y, 0))
    second = F.transform(upto(zero, F.col("block") - 1), lambda x: spot(x, F.col("block"), 1))
    spots = F.when(F.col("of_major"), of_major).otherwise(F.concat(first, second))
    return placed.withColumn("block", block).withColumn("spot", F.explode(spots)).select("key", "spot.x", "spot.y", "spot.side", *[c for c in members.columns if c != "key"])


def _groups(large: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """key (a partial key of the first collection), id and label of the classes in ``large`` (id, mask), once for each bit of their mask."""
    told = large.join(classes.select("id", "keys"), "id").join(labels, "id", "left")
    of_large = F.expr(f"filter(slice(keys, 1, {KEYS}), (x, i) -> getbit(mask, i) = 1)")
    return told.select(F.explode(of_large).alias("key"), "id", F.coalesce("label", "id").alias("label"))


def _linked_across(docs: DataFrame, owners: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """Links (u, v) between different components in groups with ``members`` (key, id, label) of ``classes`` (id, n, keys). Pairs are never
    rows: first the members with anything to compare are found, then their texts meet in their tasks and are compared there."""

    def arrays(held: list[tuple], n: int) -> list[np.ndarray]:
        return [np.array([h[c] for h in held], np.int64) for c in range(n)]

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, x, y), held in _tasks_of(batches):
            side, ids, labels, n = arrays(held, 4)
            some = np.zeros(len(held), bool)
            for a, b in _candidates(key, side, ids, labels, n, np.array([h[4] for h in held], np.int64).view(np.uint64)):
                some[a] = some[b] = True
            if some.any():
                at = [pa.array(np.full(int(some.sum()), v), pa.int64()) for v in (key, x, y)]
                yield pa.RecordBatch.from_arrays([*at, pa.array(side[some]), pa.array(ids[some]), pa.array(labels[some])], ["key", "x", "y", "side", "id", "label"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler()

        def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, held in _tasks_of(batches):
                yield at, [(*row, own.set_of(text or "")) for *row, text in held]

        for (key, _, _), held in with_sets(batches):
            side, ids, labels = arrays(held, 3)
            sets = [h[3] for h in held]
            n = np.array(list(map(len, sets)), np.int64)
            us, vs = [], []
            for a, b in _candidates(key, side, ids, labels, n, np.stack(list(map(partial_keys, sets)))):
                cuts = np.flatnonzero(np.diff(a, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(a)], strict=True):  # all partners of one member at once
                    mine, others = sets[a[lo]], b[lo:hi]
                    flat = np.concatenate([sets[k] for k in others])
                    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                    both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(n[others]) - n[others])
                    good = others[100 * both >= PERCENT * (len(mine) + n[others] - both)]
                    us += [int(ids[a[lo]])] * len(good)
                    vs += ids[good].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    place, order = ["key", "x", "y"], ["key", "x", "y", "side", "id"]
    dealt = _in_tasks(members).join(classes.select("id", "n", "keys"), "id").select(*order, "label", "n", "keys").repartition(*place).sortWithinPartitions(*order)
    asked = dealt.mapInArrow(involved, "key long, x long, y long, side long, id long, label long").groupBy("id").agg(F.collect_list(F.struct(*place, "side", "label")).alias("asked"))
    texts = _texts(docs, owners, asked).select("id", "text", F.explode("asked").alias("a")).select("a.key", "a.x", "a.y", "a.side", "id", "a.label", "text")
    return texts.repartition(*place).sortWithinPartitions(*order).mapInArrow(compare, "u long, v long")


def _confirmed(docs: DataFrame, owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) whose full sets are similar enough. Each v travels to u's text, at most MEMBERS at a time."""
    # How a pair is dealt must not depend on an order: by a hash of v, over enough places for each of u's members.
    degree = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("members")).withColumn("places", F.expr(f"(members + {MEMBERS - 1}) div {MEMBERS}"))
    place = F.pmod(F.xxhash64("v"), F.col("places"))
    members = pairs.join(degree, "u").select(F.col("v").alias("id"), "u", place.alias("place"), F.lit(1).alias("role"))
    centers = degree.select(F.col("u").alias("id"), "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"), F.lit(0).alias("role"))
    asked = members.unionByName(centers).groupBy("id").agg(F.collect_list(F.struct("u", "place", "role")).alias("asked"))
    texts = _texts(docs, owners, asked).select("id", "text", F.explode("asked").alias("x")).select("x.*", "id", "text")
    dealt = texts.repartition("u", "place").sortWithinPartitions("u", "place", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, mine = Shingler(), None, None
        for batch in batches:
            us, vs = [], []
            for u, place, role, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = own.set_of(text or "")
                if role == 0:
                    now, mine = (u, place), s
                elif now == (u, place):
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * both >= PERCENT * (len(mine) + len(s) - both):
                        us.append(u)
                        vs.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _texts(docs: DataFrame, owners: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (id of a class, ...) with the text of the row that stands for the class."""
    return docs.join(asked.join(owners, "id"), ["doc_id", "h"])


def _single(docs: DataFrame, told: DataFrame, total: int) -> DataFrame:
    """``docs`` (doc_id, h, text; ``total`` rows) with one row of those that agree in id and text, and none without an id."""
    docs = docs.where("doc_id is not null")
    again = cut_lineage(few(told.where("doc_id is not null").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), total))
    if again.isEmpty():
        return docs
    once = docs.join(again, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    return docs.join(again, ["doc_id", "h"], "left_anti").unionByName(once)


def components(links: DataFrame) -> DataFrame:
    """id and label (smallest id of its component) of every id in ``links`` (u, v), by passing on smallest labels and following
    them; both ways aggregate before they shuffle."""
    rows = 2 * links.count()
    kept = lambda df: cut_lineage(few(df, rows))
    both = kept(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("label").alias("m"))
        passed = labels.join(near, labels["id"] == near["u"]).select("id", F.least("label", "m").alias("next"), "label")
        up = passed.select(F.col("id").alias("at"), F.col("next").alias("further"))
        moved = kept(passed.join(up, passed["next"] == up["at"], "left").select("id", "label", F.least("next", "further").alias("next")))
        labels, changed = moved.select("id", F.col("next").alias("label")), moved.where("next < label").limit(1).count()
        if not changed:
            return labels


def placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """Per row of ``docs``: doc_id, h (hash of its text), n_shingles, component_id and kept; and how many rows there are."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    told = cut_lineage(_described(docs))
    total, shingles = told.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    some = told.where("doc_id is not null and class is not null")
    first = F.min(F.struct("doc_id", "h", F.col("n_shingles").alias("n"), "keys")).alias("x")
    # A class has a number of its own: an id may stand for rows of several classes.
    classes = cut_lineage(few(some.groupBy("class").agg(first, F.count(F.lit(1)).alias("copies")), total).select(F.monotonically_increasing_id().alias("id"), "class", "copies", "x.*"))
    owners = classes.select("id", "doc_id", "h")
    found = cut_lineage(few(_buckets(classes), total))
    size = found.count()
    sweep(docs.sparkSession)
    pairs = found.where("mask is null").select("u", "v")
    own = _single(docs, told, total)
    links = cut_lineage(few(_confirmed(own, owners, pairs), max(total, size, shingles / 256)))
    sweep(docs.sparkSession)
    labels = components(links)
    large = found.where("mask is not null").select(F.col("v").alias("id"), "mask")
    members = cut_lineage(few(_groups(large, classes, labels), max(total, size)))
    if not members.groupBy("key").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").isEmpty():
        links = links.unionByName(cut_lineage(_linked_across(own, owners, classes, members)))
        sweep(docs.sparkSession)
        labels = components(links)
    linked = classes.select("id", "doc_id").join(labels, "id")
    smallest = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = linked.join(smallest, "label").select("id", "component_id")
    known = cut_lineage(few(classes.join(of_class, "id", "left").select("class", "copies", F.coalesce("component_id", "doc_id").alias("component_id")), total))
    # At most 1,000 classes have a thousandth of the rows each; all others are small enough to meet in one task.
    often = F.col("copies") * 1000 >= F.lit(max(total, 1_000_000))
    hot = [r["class"] for r in known.where(often).select("class").collect()]
    narrow = told.select("doc_id", "h", "n_shingles", "class")
    if hot:
        is_hot = F.coalesce(F.col("class").isin(hot), F.lit(False))
        joined = narrow.where(is_hot).join(F.broadcast(known.where(often)), "class", "left").unionByName(narrow.where(~is_hot).join(known.where(~often), "class", "left"))
    else:
        joined = narrow.join(known, "class", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "h", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), total


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept."""
    rows, total = placed(docs)
    return few(rows.drop("h"), total)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are, one of each group: of rows that agree in id and text one stays, too."""
    where = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__h"))
    rows, total = placed(docs)
    told = cut_lineage(few(rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 or not kept"), total))
    if told.count() <= BROADCAST_ROWS:
        told = F.broadcast(told)
    rest = docs.join(told, where, "left_anti")
    again = told.where("kept")
    if again.isEmpty():
        return rest
    return rest.unionByName(docs.join(again, where, "left_semi").dropDuplicates(["doc_id", "text"]))
