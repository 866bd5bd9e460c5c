"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, connected groups.

A 64-bit fingerprint is cut into ``radius + 2`` blocks. Two fingerprints within ``radius`` bits differ in at most
``radius`` blocks, so they agree on some two whole blocks: one key per pair of blocks brings every such pair together, and
keys are long enough to keep unlike fingerprints apart. Distinct fingerprints sharing a key are compared within their task;
what leaves it is a spanning forest of the links found there, never all pairs. A key shared by more than ``LIMIT``
fingerprints is taken again with finer keys, by the same argument on the bits that are left, so nothing is capped.

Defined cases: null and empty texts have fingerprint zero and link like any other; equal fingerprints are one node, so
copies cost nothing; repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, most_frequent, sieved, slices, stored, temporary
from .components import components

SEED = 42
#: Distinct fingerprints compared with one another in one task.
LIMIT = 20_000
#: Groups up to this size are compared by shifting the whole batch.
SMALL = 32
ALL = (1 << 64) - 1
LINKS = "a long, b long, mask_id int, fp long, rep long"


def hashed(content: bytes, shingle: int) -> np.ndarray:
    """Digests of the word shingles, repeats included, as rows of eight bytes."""
    words = content.lower().split()
    if not words:
        return np.empty((0, 8), dtype=np.uint8)
    view = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(view[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())]), dtype=np.uint8).reshape(-1, 8)


def majority(raw: np.ndarray) -> int:
    """The fingerprint of a text's shingle digests."""
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(raw), 4096):
        ones += np.unpackbits(raw[a : a + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprint(content: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles (repeats count) of a text given as UTF-8; zero for no words."""
    return majority(hashed(content, shingle))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp``; ``fp`` is the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint(t.as_py() or b"", shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return slim.mapInArrow(compute, "doc_id long, fp long")


def cut_bits(bits: list[int], parts: int) -> list[int]:
    """Masks that split these bit numbers into runs of near-equal length."""
    edge = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edge, edge[1:]) if y > x]


def first_masks(radius: int) -> list[int]:
    blocks = cut_bits(list(range(64)), radius + 2)
    return [a | b for a, b in combinations(blocks, 2)]


def finer(mask: int, radius: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in cut_bits(free, radius + 1)]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs within ``radius`` bits that connect what all such pairs connect."""
    left, out = np.arange(len(fps)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            found = left[near].tolist()
            out += [(at, x) for x in found]
            todo += found
            left = left[~near]
    return out


def links_of(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Representatives linked within runs of equal keys (rows sorted by key)."""
    edge = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(fps)]))
    size = end - start
    a, b = [], []
    small = np.repeat(np.where(size <= SMALL, end, start), size)  # the end of a row's own run, if it is a small one
    at = np.arange(len(fps))
    for d in range(1, int(min(SMALL, size.max(initial=1)))):
        at = at[at + d < small[at]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= radius]
        a.append(reps[near])
        b.append(reps[near + d])
    for s, e in zip(start[size > SMALL], end[size > SMALL]):
        pairs = np.array(forest(fps[s:e], radius), dtype=np.int64).reshape(-1, 2) + s
        a.append(reps[pairs[:, 0]])
        b.append(reps[pairs[:, 1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (reps[:0], reps[:0])


def block_links(reps: DataFrame, radius: int, limit: int = LIMIT) -> DataFrame:
    """Links ``a, b`` between representatives of distinct fingerprints ``fp, rep``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by mask and key; the last run of a batch waits for the next one."""

        def emit(a, b, mask_id, fp, rep) -> pa.RecordBatch:
            n, m = len(a), len(fp)
            none = lambda k, kind: pa.nulls(k, kind)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(a, pa.int64()), none(m, pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), none(m, pa.int64())]),
                pa.concat_arrays([none(n, pa.int32()), pa.array(mask_id, pa.int32())]), pa.concat_arrays([none(n, pa.int64()), pa.array(fp, pa.int64())]), pa.concat_arrays([none(n, pa.int64()), pa.array(rep, pa.int64())]),
            ], names=["a", "b", "mask_id", "fp", "rep"])

        held = np.empty((0, 4), dtype=np.int64)
        hot = None  # the key whose run is too long: its rows go on to finer keys
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate((held, rows))
            if hot is not None:
                same = np.all(rows[:, :2] == hot, axis=1)
                if same.any():
                    yield emit([], [], rows[same, 0], rows[same, 2], rows[same, 3])
                    rows = rows[~same]
            held = rows
            if not len(rows):
                continue
            last = np.all(rows[:, :2] == rows[-1, :2], axis=1)
            done, held = rows[~last], rows[last]
            if len(done):
                yield emit(*links_of(done[:, :2], done[:, 2].view(np.uint64), done[:, 3], radius), [], [], [])
            if len(held) > limit:
                hot = held[-1, :2].copy()
                yield emit([], [], held[:, 0], held[:, 2], held[:, 3])
                held = held[:0]
        if len(held):
            yield emit(*links_of(held[:, :2], held[:, 2].view(np.uint64), held[:, 3], radius), [], [], [])

    def keyed(rows: DataFrame, of: dict[int | None, list[tuple[int, int]]]) -> DataFrame:
        """One row for each mask that a row's own mask leads to."""
        each = lambda masks: F.array(*[F.struct(F.lit(i).alias("mask_id"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in masks])
        if None in of:
            choice = each(of[None])
        else:
            choice = F.lit(None)
            for i, masks in of.items():
                choice = F.when(F.col("mask_id") == i, each(masks)).otherwise(choice)
        return rows.select(F.explode(choice).alias("m"), "fp", "rep").select("m.mask_id", "m.key", "fp", "rep")

    masks = dict(enumerate(first_masks(radius)))
    rows, of, found = reps, {None: list(masks.items())}, []
    while True:
        sorted_rows = keyed(rows, of).repartition("mask_id", "key").sortWithinPartitions("mask_id", "key")
        out = cut(sorted_rows.mapInArrow(scan, LINKS))
        found.append(out.filter("a is not null").select("a", "b"))
        rows = out.filter("fp is not null")
        deeper = [r[0] for r in rows.select("mask_id").distinct().collect()]
        if not deeper:
            break
        n = max(masks) + 1
        of = {}
        for i in sorted(deeper):
            of[i] = [(n + j, m) for j, m in enumerate(finer(masks[i], radius))]
            n += len(of[i])
        masks = {i: m for own in of.values() for i, m in own}
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, fp, component_id`` for every document; ``component_id`` is the smallest ``doc_id`` reachable."""
    fps = cut(fingerprints(docs, shingle, doc_id, text))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"))
    labels = components(block_links(reps, radius, limit))
    classes = reps.join(labels, reps["rep"] == labels["node"], "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, fps["fp"] == classes["of_fp"], "left").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- by similarity of shingle sets

#: Documents (about) whose shingles set the order of the prefix filter, common shingles kept, fewest bits of a parity map (the
#: largest ones have two bits a shingle, the others one where that is more). Any order and any number of bits give the same pairs; these only spare comparisons.
ORDERED_BY, COMMON, WIDE = 10_000, 50_000, 1024
#: Least keys of a set that travel with its rows: two sets that share one of those are held against each other there, not under later keys.
EARLIER = 16
#: Guards bounds on counts against the rounding of floats.
EPS = 1e-9
FACTS = "doc_id long, mark long, same long, n long, fp long, bits binary, map binary, prefix binary"


def shingle_set(raw: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes, in order."""
    return np.unique(raw.view(">u8").ravel().astype(np.uint64))


def name_of(distinct: np.ndarray) -> int:
    """A number that stands for a shingle set."""
    return signed(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))


def common_shingles(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Shingles met several times in a sample of texts, rarest first: put last in the order, they are seldom keys."""
    k = max(1, docs.count() // ORDERED_BY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = [shingle_set(hashed(t.as_py() or b"", shingle)) for t in part.column(0)]
                hashes, times = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "c"])

    sample = docs.filter(F.pmod(F.xxhash64(text), F.lit(k)) == 0).select(F.col(text).cast("binary").alias("text"))
    counts = stored(sample.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 2"))
    top = sorted((r["c"], r["h"]) for r in most_frequent(counts, COMMON).collect())
    return np.array([h for _, h in top], dtype=np.int64).view(np.uint64)


def prefix_size(n: int, least: float) -> int:
    """How many first shingles of a set, in one order of all, hold one of any set that is at least so similar."""
    return n - math.ceil(least * n - EPS) + 1


def first_shingles(distinct: np.ndarray, common: np.ndarray, places: np.ndarray, least: float) -> np.ndarray:
    """The prefix of a set and the shingle after it, in order.

    ``common`` is sorted, ``places`` are its places in the order; all other shingles come before, by hash.
    """
    place = np.full(len(distinct), -1, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
        place = np.where(common[at] == distinct, places[at], place)
    order = np.lexsort((distinct, place))
    return distinct[order[: prefix_size(len(distinct), least) + 1]]


def parity(distinct: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles fall on each bit: two maps differ in no more bits than the sets in shingles."""
    size = max(WIDE, 1 << (2 * len(distinct) - 1).bit_length()) if len(distinct) else WIDE
    return np.packbits((np.bincount((distinct % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity map of the same set with ``size`` bits, a power of two."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size // 8), axis=0)


def may_be_similar(a: bytes, na: int, b: bytes, nb: int, least: float) -> bool:
    """False only for sets that are less similar, by sizes and parity maps."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    size = 8 * min(len(x), len(y))
    apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    return min(na, nb) >= least * max(na, nb) - EPS and apart <= (1 - least) / (1 + least) * (na + nb) + EPS


def set_facts(docs: DataFrame, common: np.ndarray, shingle: int, least: float, doc_id: str, text: str) -> DataFrame:
    """``FACTS`` of every row: hash of its text, number of its shingle set, fingerprint, parity map, first shingles."""
    order = np.argsort(common)
    sent = docs.sparkSession.sparkContext.broadcast((common[order], order))  # at most COMMON

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                raws = [hashed(t.as_py() or b"", shingle) for t in part.column(2)]
                sets = [shingle_set(r) for r in raws]
                maps = [parity(x) for x in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([name_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([signed(majority(r)) for r in raws], pa.int64()),
                    pa.array([folded(x, max(WIDE, 4 * len(x))).tobytes() for x in maps], pa.binary()), pa.array([x.tobytes() for x in maps], pa.binary()), pa.array([first_shingles(x, *sent.value, least).tobytes() for x in sets], pa.binary()),
                ], names=[c.split(" ")[0] for c in FACTS.split(", ")])

    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(content).alias("mark"), content.cast("binary").alias("text")).mapInArrow(compute, FACTS)


def values(column: pa.Array) -> np.ndarray:
    """A column's values; lists, which are all of one length, as rows of a matrix."""
    if pa.types.is_binary(column.type):
        return np.array(column.to_pylist(), dtype=object)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def runs(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of rows that come sorted by their first one: runs of equal values whole, or parts of a run over ``limit`` (True)."""
    held: list[np.ndarray] | None = None
    long = None
    for batch in batches:
        own = [values(c) for c in batch.columns]
        if long is not None:
            k = int(np.searchsorted(own[0], long, side="right"))
            if k:
                yield [x[:k] for x in own], True
                own = [x[k:] for x in own]
        if not len(own[0]):
            continue
        long = None
        if held is not None:
            own = [np.concatenate(x) for x in zip(held, own)]
        last = int(np.searchsorted(own[0], own[0][-1]))
        if last:
            yield [x[:last] for x in own], False
        held = [x[last:] for x in own]
        if limit is not None and len(held[0]) > limit:
            long = held[0][-1]
            yield held, True
            held = None
    if held is not None:
        yield held, False


def edges_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return first, np.append(first[1:], len(key))


def shared_keys(keyed: DataFrame, limit: int | None) -> DataFrame:
    """``key, same, long``: the rows of ``key, same`` whose key has two rows or more, marked in keys of over ``limit`` rows.

    A key not marked is named by the sets that share it: the many keys of one passage, which the same sets share, come as
    one. Groups that get one name by chance are looked at together, so none loses a pair.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, same), long in runs(batches, limit):
            if not long:
                a, b = edges_of(key)
                on = np.repeat(b - a > 1, b - a)
                names = short(np.add.reduceat(same.view(np.uint64), a))
                key, same = np.repeat(names, b - a)[on], same[on]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(same), pa.array(np.full(len(key), long))], names=["key", "same", "long"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "key long, same long, long boolean")


def short(hashes: np.ndarray) -> np.ndarray:
    """Keys of 48 bits: what meets by chance is only a candidate."""
    return (hashes >> np.uint64(16)).view(np.int64)


def prefix_keys(nodes: DataFrame, least: float, limit: int = LIMIT) -> DataFrame:
    """Distinct ``key, same`` such that any two sets at least so similar share a key; only keys of two sets or more.

    The keys are the shingles of the prefix, those that the same sets share as one (``shared_keys``). A shingle that more than
    ``limit`` sets share is joined with each later shingle up to the one after the prefix: similar sets that share the key as their
    first common shingle share the second one there too.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(p.as_py(), dtype=np.uint64)[: prefix_size(n, least)] for n, p in zip(batch.column(1).to_pylist(), batch.column(2))]
            same = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(short(np.concatenate([np.empty(0, dtype=np.uint64), *own]))), pa.array(same)], names=["key", "same"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sames = [np.empty(0, dtype=np.int64)], []
            for key, same, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = np.frombuffer(p.as_py(), dtype=np.uint64)
                at = int(np.flatnonzero(short(own) == key)[0])
                mixed = (own[at] ^ (own[at + 1 :] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
                keys.append(short(mixed))
                sames += [same] * len(mixed)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(sames, pa.int64())], names=["key", "same"])

    own = nodes.filter("n > 0").select("same", "n", "prefix")
    found = stored(shared_keys(own.mapInArrow(first, "key long, same long"), limit))
    rows = found.filter("not long").select("key", "same")
    long = found.filter("long").select("key", "same")
    if long.isEmpty():
        return rows.dropDuplicates(["key", "same"])
    finer = long.join(own.select("same", "prefix"), "same").select("key", "same", "prefix").mapInArrow(second, "key long, same long")
    return rows.unionByName(shared_keys(finer, None).select("key", "same")).dropDuplicates(["key", "same"])


def earlier_keys(keyed: DataFrame) -> DataFrame:
    """``same, earlier`` of all rows ``key, same``: the least ``EARLIER`` keys of each set, filled up with -1."""
    some = F.slice(F.array_sort(F.collect_set("key")), 1, EARLIER)
    return keyed.groupBy("same").agg(some.alias("some")).select("same", F.slice(F.concat("some", F.array_repeat(F.lit(-1).cast("long"), EARLIER)), 1, EARLIER).alias("earlier"))


class Bound:
    """What sizes and parity maps allow to be similar, of rows ``key, n, same, comp, bits, earlier``; never rules out a similar pair."""

    def __init__(self, least: float, key: np.ndarray, n: np.ndarray, same: np.ndarray, comp: np.ndarray, bits: np.ndarray, earlier: np.ndarray):
        self.least, self.share, self.key, self.n, self.same, self.comp, self.earlier = least, (1 - least) / (1 + least), key, n, same, comp, earlier
        self.bits = [np.frombuffer(x, dtype=np.uint8) for x in bits.tolist()]
        self.sizes = np.array([len(x) for x in self.bits])
        size = int(self.sizes.min())
        self.maps = np.stack([x if len(x) == size else folded(x, 8 * size) for x in self.bits]).view(np.uint64)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that may be similar and are of different components."""
        i, j = np.broadcast_arrays(i, j)
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        on = (self.comp[i] != self.comp[j]) & (self.same[i] != self.same[j]) & (small >= self.least * large - EPS)
        i, j = i[on], j[on]
        most = self.share * (self.n[i] + self.n[j]) + EPS
        near = np.bitwise_count(self.maps[i] ^ self.maps[j]).sum(axis=1, dtype=np.int64) <= most
        i, j, most = i[near], j[near], most[near]
        # the narrowest map says little about very long sets: those that have a wider one are held against each other by it
        size = np.minimum(self.sizes[i], self.sizes[j])
        on = np.ones(len(i), dtype=bool)
        for k in np.flatnonzero(size > 8 * self.maps.shape[1]).tolist():
            x, y = (folded(self.bits[int(r[k])], 8 * int(size[k])) for r in (i, j))
            on[k] = int(np.bitwise_count(x ^ y).sum()) <= most[k]
        return i[on], j[on]

    def first_met(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (each of one key) of which no earlier common key is known.

        Both sets have a row under that key too, and are of different components there as here, so a pair that goes here
        is met there; none goes under the least key that it shares.
        """
        on = np.ones(len(i), dtype=bool)
        for a in range(0, len(i), 1 << 14):
            x, y = self.earlier[i[a : a + (1 << 14)]], self.earlier[j[a : a + (1 << 14)]]
            before = (x >= 0) & (x < self.key[i[a : a + (1 << 14)], None])
            on[a : a + (1 << 14)] = ~((x[:, :, None] == y[:, None, :]) & before[:, :, None]).any(axis=(1, 2))
        return i[on], j[on]

    def forest(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that connect what the allowed pairs of rows a to b connect."""
        left = np.arange(a, b)
        while len(left):
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                i, j = self.pairs(np.int64(todo.pop()), left)
                yield i, j
                todo += j.tolist()
                left = np.setdiff1d(left, j, assume_unique=True)

    def across(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All allowed pairs of rows a to b: each row outside the largest component with those of other components."""
        own, times = np.unique(self.comp[a:b], return_counts=True)
        rest = np.flatnonzero(self.comp[a:b] != own[times.argmax()]) + a
        inside = np.setdiff1d(np.arange(a, b), rest, assume_unique=True)
        for k, i in enumerate(rest):
            yield self.pairs(i, np.concatenate((inside, rest[:k])))


def allowed_pairs(rows: DataFrame, least: float, every: bool) -> DataFrame:
    """Candidate pairs ``a < b`` among the rows ``key, n, same, comp, bits, earlier`` of each key; few come twice, as a pair is
    left to the least key that its sets are known to share.

    ``every``: all pairs of different components that the bound allows; else, of keys with over ``SMALL`` rows, so many, linear
    in the rows, that they connect what all such pairs connect.
    """

    def joined(found: list, same: np.ndarray) -> pa.RecordBatch:
        i, j = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in ([f[0] for f in found], [f[1] for f in found]))
        a, b = np.minimum(same[i], same[j]), np.maximum(same[i], same[j])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        return pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh])], names=["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, n, same, comp, bits, earlier), _ in runs(batches):
            bound = Bound(least, key, n, same, comp, bits, earlier)
            first, end = edges_of(key)
            small = end - first <= SMALL
            stop = np.repeat(np.where(small, end, first), end - first)
            at, found = np.arange(len(key)), []
            for d in range(1, int(min(SMALL, (end - first).max()))):
                at = at[at + d < stop[at]]
                found.append(bound.first_met(*bound.pairs(at + d, at)))
            for s, e in zip(first[~small].tolist(), end[~small].tolist()):
                for pair in bound.across(s, e) if every else bound.forest(s, e):
                    found.append(bound.first_met(*pair))
                    if len(found) >= 4096:
                        yield joined(found, same)
                        found = []
            yield joined(found, same)

    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(scan, "a long, b long")


def overlap(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of shingle hashes."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, least: float, text: str) -> DataFrame:
    """The pairs of sets that are at least so similar, decided on the whole sets, made again from one text each; large parity
    maps rule out most others first."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, x, m, y, n = batch.columns
            on = pa.array([may_be_similar(p.as_py(), na, q.as_py(), nb, least) for p, na, q, nb in zip(x, m.to_pylist(), y, n.to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], names=["a", "b"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text within the task; at most the sets in some pair
        for batch in batches:
            for part in slices(batch, 1):
                sets = []
                for mark, t in zip(part.column(0).to_pylist(), part.column(1)):
                    if mark not in seen:
                        seen.add(mark)
                        sets.append(shingle_set(hashed(t.as_py() or b"", shingle)))
                yield pa.RecordBatch.from_arrays([pa.array([name_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["same", "members"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = pa.array([overlap(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], names=["a", "b"])

    own = lambda c: nodes.select(F.col("same").alias(c), F.col("map").alias(f"m{c}"), F.col("n").alias(f"n{c}"))
    pairs = stored(pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "ma", "na", "mb", "nb").mapInArrow(sift, "a long, b long"))
    named = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.select("same", "mark").join(named, "same", "left_semi").select("mark"))  # small enough, it is broadcast: the files' size says so
    content = F.coalesce(F.col(text), F.lit(""))
    texts = sieved(docs.select(F.xxhash64(content).alias("mark"), content.cast("binary").alias("text")), "mark", wanted, "mark")
    texts = texts.filter("sieved").drop("sieved").join(wanted, "mark", "left_semi")
    sets = texts.mapInArrow(members, "same long, members binary").dropDuplicates(["same"])
    side = lambda c: sets.select(F.col("same").alias(c), F.col("members").alias(f"m{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ma", "mb").mapInArrow(check, "a long, b long")


def similar_classes(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, mark, same`` of every row, and ``of_same, class`` of every set in a class of several.

    Nodes are distinct shingle sets. A first round links what fingerprints within ``radius`` bits and a few of the keys bring
    together; it is linear in the rows, and gathers large groups of near copies. The second round misses nothing: sets at
    ``least`` share a key of the prefix filter, and all pairs under a key that are not in one class yet, and that the bounds
    allow, are compared.
    """
    with temporary(docs.sparkSession):
        facts = stored(set_facts(docs, common_shingles(docs, text, shingle), shingle, least, doc_id, text))
        nodes = stored(facts.drop("doc_id").dropDuplicates(["same"]), outer=True)
        facts = stored(facts.select("doc_id", "mark", "same"), outer=True)
    one = stored(nodes.groupBy("fp").agg(F.min("same").alias("rep")))
    equal = nodes.select("fp", "same").join(one, "fp").filter("rep <> same").select(F.col("rep").alias("a"), F.col("same").alias("b"))
    near = block_links(one, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    keyed = stored(prefix_keys(nodes, least))
    sharing = stored(nodes.select("same", "n", "bits").join(earlier_keys(keyed), "same"))
    met = lambda rows: rows.join(sharing, "same").select("key", "n", "same", "comp", "bits", "earlier")
    close = allowed_pairs(met(keyed.withColumn("comp", F.col("same"))).filter(F.array_contains("earlier", F.col("key"))), least, False)
    links = stored(similar(near.union(equal).union(close).distinct(), nodes, docs, shingle, least, text))
    labels = stored(components(links).withColumnRenamed("node", "same"))
    apart = stored(keyed.join(labels, "same", "left").select("key", "same", F.coalesce("component", "same").alias("comp")))
    mixed = stored(apart.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key"))
    more = similar(allowed_pairs(met(apart.join(mixed, "key", "left_semi")), least, True).distinct(), nodes, docs, shingle, least, text)
    return facts, components(stored(links.union(more))).select(F.col("node").alias("of_same"), F.col("component").alias("class"))


def similar_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every row: groups of documents whose word shingle sets are at least ``least`` similar, by the
    smallest id reachable.

    Defined cases: null and empty texts and those without words have the empty set, and are one group; equal texts are one
    set; rows without an id are grouped like any other, and a group of only such rows has a null id; rows that repeat are
    repeated; an empty table gives no rows; other columns are ignored.
    """
    with temporary(docs.sparkSession):
        facts, classes = similar_classes(docs, shingle, least, radius, doc_id, text)
        own = stored(facts.join(classes, facts["same"] == classes["of_same"], "left").select("doc_id", F.coalesce("class", "same").alias("class")))
        names = own.groupBy("class").agg(F.min("doc_id").alias("component_id"))
        return stored(own.join(names, "class").select("doc_id", "component_id"), keep=True)


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their group of similar documents: one row a group.

    First is the smallest id; rows without one come last, and rows of one id come by the hash of their text, so rows that
    repeat an id with unlike texts are documents of their own, all kept. Of rows that repeat an id and a text one is kept.
    Defined cases: null and empty texts are one group (as in ``similar_groups``); an empty table gives no rows; column names
    don't matter.
    """
    with temporary(docs.sparkSession):
        facts, classes = similar_classes(docs, shingle, least, doc_id=doc_id, text=text)
        own = facts.join(classes, facts["same"] == classes["of_same"], "left").groupBy(F.coalesce("class", "same").alias("class"), "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
        # ids alone are combined before the shuffle; the hash decides only among rows of the smallest one
        own = stored(own)
        ids = own.groupBy("class").agg(F.min("doc_id").alias("id"))
        at_first = own.join(ids, "class").filter(F.col("doc_id").eqNullSafe(F.col("id")))
        first = stored(at_first.groupBy("class").agg(F.min("id").alias("id"), F.min("mark").alias("first_mark")))
        stays = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("first_mark"))
        judged = own.join(first, "class").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), stays.alias("stays"), "rows")
        gone = stored(judged.filter("not stays").select("_id", "_mark"), keep=True)
        again = stored(judged.filter("stays and rows > 1").select("_id", "_mark"), keep=True)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    on = lambda side: d["id"].eqNullSafe(side["_id"]) & (d["mark"] == side["_mark"])
    sifted = sieved(d, F.xxhash64("id", "mark"), gone, F.xxhash64("_id", "_mark"))  # most rows stay, and need not meet those that go
    kept = sifted.filter("not sieved").drop("sieved").unionByName(sifted.filter("sieved").drop("sieved").join(gone, [F.col("id").eqNullSafe(gone["_id"]), F.col("mark") == gone["_mark"]], "left_anti"))
    if not again.isEmpty():
        kept = kept.join(again, [F.col("id").eqNullSafe(again["_id"]), F.col("mark") == again["_mark"]], "left_anti").unionByName(d.join(again, on(again), "left_semi").dropDuplicates(["id", "mark"]))
    return kept.select("row.*")
