"""Byte-level BPE encoding and decoding, merged through segment trees over byte positions.

Each leaf holds the rank of the pair that starts at its byte position, joined with the position, so that the root is the
leftmost pair of minimum rank. A merge changes at most three leaves (the pair, its live neighbour to the left, and the
right part that disappears). Short pieces of like length are merged together: one numpy column per piece, one round per
merge; a long piece has a tree of its own, where a change is a walk of logarithmic length to the root.

Texts go through in runs: a run's distinct units (``tokens``) are split into pieces once, its distinct pieces are merged
unless they are known yet, and ids, decimals and bytes are joined from pieces to units to texts, all as arrays.

Defined cases: a null text is an empty text, with no ids; repeated rows give repeated results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import CACHE, byte_ranks, unit_starts

NONE = np.int64(1) << 62
#: A leaf of a long piece is rank * AT + position.
AT = np.int64(1) << 32
#: From this width on a piece is merged by itself, in plain Python integers.
LONG = 512
#: A leaf of a short piece is rank << PLACE | position; positions begin with 1, and end with one that stands for "no neighbour".
PLACE = LONG.bit_length() - 1
#: Tree cells merged at once, over all pieces: what the processor's cache holds.
CELLS = 1 << 17
SHIFT = 20
#: The rank of a pair that is no token.
NO = 1 << SHIFT
#: An empty slot; no key shifts to it.
EMPTY = np.iinfo(np.int64).min
#: Spreads keys over slots (the golden ratio's bits).
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairRanks:
    """Rank of a pair of token ids, looked up for whole arrays in a hash table with open addresses."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << SHIFT | b)
                    values.append(rank)
        if ranks and max(ranks.values()) >= NO:
            raise ValueError(f"ranks from {NO} on are not provided for")
        self.rank_of = dict(zip(keys, values))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        bits = (4 * len(keys)).bit_length()
        self.down, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, EMPTY)
        key = np.array(keys, dtype=np.int64)
        entry, at = key << SHIFT | np.array(values, dtype=np.int64), self.slot(key)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] == EMPTY]
            self.slots[at[free]] = entry[free]
            left = left[self.slots[at[left]] != entry[left]]
            at[left] = at[left] + 1 & self.last
        self.bytes = self.of(*(x.ravel() for x in np.broadcast_arrays(self.single[:, None], self.single))).astype(np.int32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * SPREAD >> self.down).view(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO where it is no token or an end (-1) takes part."""
        key = left.astype(np.int64) << SHIFT | right
        at = self.slot(key)
        got = self.slots[at]
        same = got >> SHIFT == key
        out = np.where(same, got & NO - 1, NO)
        again = np.flatnonzero(~same & (got != EMPTY))
        while len(again):
            at[again] = at[again] + 1 & self.last
            got, own = self.slots[at[again]], key[again]
            same = got >> SHIFT == own
            out[again[same]] = got[same] & NO - 1
            again = again[~same & (got != EMPTY)]
        return out


def merge_columns(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pieces of at most ``width`` (a power of two under LONG) bytes, one after the other, and how many each has."""
    n = len(starts)
    place = np.arange(1, width + 1)[:, None]
    raw = data.take(starts + place - 1, mode="clip")
    # one more row at either end stands for "no neighbour"
    ids = np.full((width + 2, n), -1, dtype=np.int32)
    ids[1:-1] = np.where(place <= sizes, pairs.single[raw], -1)
    after = np.repeat(np.arange(1, width + 3, dtype=np.int32), n)
    before = np.repeat(np.arange(-1, width + 1, dtype=np.int32), n)
    tree = np.full((2 * width, n), NO << PLACE, dtype=np.int32)
    tree[width:-1] = np.where(place[:-1] < sizes, pairs.bytes[raw[:-1].astype(np.int64) << 8 | raw[1:]], NO) << PLACE | place[:-1]
    flat, cells = ids.ravel(), tree.ravel()
    root, leaves = n, (width - 1) * n  # cells of roots, and from a place's cell in ``flat`` to its leaf
    whole = width <= 32  # all inner nodes at once cost less than the walks

    def rebuild() -> None:
        level = width
        while level > 1:
            np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2], out=tree[level // 2 : level])
            level //= 2

    def walk(at: np.ndarray, column: np.ndarray) -> None:
        node = at - 1 + width >> 1
        while node[0]:
            cells[node * n + column] = np.minimum(cells[2 * node * n + column], cells[(2 * node + 1) * n + column])
            node = node >> 1

    rebuild()
    columns = np.flatnonzero(tree[1] < NO << PLACE)
    while len(columns):
        least = cells[root + columns]
        at = (least & LONG - 1).astype(np.int64)
        x = at * n + columns
        right = after[x].astype(np.int64)
        y = right * n + columns
        far = after[y].astype(np.int64)
        near = before[x].astype(np.int64)
        z, w = far * n + columns, near * n + columns
        token = least >> PLACE  # a token's id is its rank
        flat[x], flat[y] = token, -1
        after[x], before[z] = far, at
        cells[leaves + y] = NO << PLACE
        cells[leaves + x] = pairs.of(token, flat[z]) << PLACE | at
        some = np.flatnonzero(near)
        cells[(leaves + w)[some]] = pairs.of(flat[w[some]], token[some]) << PLACE | near[some]
        if whole:
            rebuild()
        else:
            walk(right, columns)
            walk(at, columns)
            if len(some):
                walk(near[some], columns[some])
        columns = columns[cells[root + columns] < NO << PLACE]
    kept = np.ascontiguousarray(ids[1:-1].T)
    live = kept >= 0
    return kept[live], live.sum(axis=1)


def merge_long(piece: bytes, pairs: PairRanks) -> list[int]:
    """``merge_columns`` for one long piece: the same tree, where an update ends at the first ancestor that stays as it was."""
    n, width, none, at_one, rank_of = len(piece), 1 << (len(piece) - 1).bit_length(), int(NONE), int(AT), pairs.rank_of.get
    ids = pairs.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> int:
        j = after[i]
        rank = rank_of(ids[i] << SHIFT | ids[j]) if j < n else None
        return none if rank is None else rank * at_one + i

    level = [leaf(i) for i in range(n)] + [none] * (width - n)
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    tree = [none, *(x for level in reversed(levels) for x in level)]

    def update(i: int, value: int) -> None:
        node = i + width
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least

    while (least := tree[1]) < none:
        rank, i = divmod(least, at_one)
        j = after[i]
        far = after[j]
        ids[i], ids[j], after[i] = rank, -1, far
        if far < n:
            before[far] = i
        update(j, none)
        update(i, leaf(i))
        if (near := before[i]) >= 0:
            update(near, leaf(near))
    return [x for x in ids if x >= 0]


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a large string or binary array without nulls, from 0 on."""
    _, bounds, data = array.buffers()
    if not len(array):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(bounds, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def bounds_of(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def gather(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that the codes name, one after the other, and their bounds."""
    sizes = np.diff(bounds)[codes]
    ends = bounds_of(sizes)
    return values[np.repeat(bounds[codes] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def joined(parts: pa.Array, bounds: np.ndarray, between: str) -> pa.Array:
    """The parts of each run joined."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), parts), pa.scalar(between, parts.type))


class ByteBPE:
    """Encoder and decoder over the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str, limit: int = CACHE):
        import regex

        self.ranks = byte_ranks(path)
        self.pairs = PairRanks(self.ranks)
        self.findall = regex.compile(pattern).findall
        self.limit = limit
        #: Ids of pieces: those of late, and those of the time before; what is met again stays.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.vocabulary = {i: t for t, i in self.ranks.items()}
        every = range(max(self.vocabulary) + 1)
        self.decimals = pa.array(map(str, every), pa.large_string())
        self.contents = pa.array([self.vocabulary.get(i, b"") for i in every], pa.large_binary())

    def merge(self, pieces: pa.Array) -> list[bytes]:
        """Ids (32-bit) of each piece, encoded by itself: the whole piece where it is a token, else its merges."""
        out = [b""] * len(pieces)
        data, bounds = flat(pieces)
        sizes = np.diff(bounds)
        tokens = list(map(self.ranks.get, pieces.cast(pa.large_binary()).to_pylist()))
        for i, x in enumerate(tokens):
            if x is not None:
                out[i] = np.int32(x).tobytes()
        left = np.array([x is None for x in tokens], dtype=bool) & (sizes > 0)
        width = 1
        while left.any():
            same = np.flatnonzero(left & (sizes <= width)) if width < LONG else np.flatnonzero(left)
            left[same] = False
            if width >= LONG:
                for i in same.tolist():
                    out[i] = np.array(merge_long(data[bounds[i] : bounds[i + 1]].tobytes(), self.pairs), dtype=np.int32).tobytes()
            step = max(1, CELLS // (2 * width))
            for at in range(0, len(same) if width < LONG else 0, step):
                part = same[at : at + step]
                ids, counts = merge_columns(data, bounds[part], sizes[part], width, self.pairs)
                coded, ends = ids.tobytes(), (4 * bounds_of(counts)).tolist()
                for i, a, b in zip(part.tolist(), ends, ends[1:]):
                    out[i] = coded[a:b]
            width *= 2
        return out

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and their bounds; merges those that aren't known."""
        if 2 * len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, names = self.young, self.old, pieces.to_pylist()
        found = list(map(young.get, names))
        new = []
        for i, x in enumerate(found):
            if x is None:
                x = found[i] = old.get(names[i])
                if x is None:
                    new.append(i)
                else:
                    young[names[i]] = x
        for i, x in zip(new, self.merge(pieces.take(pa.array(new, pa.int64())))):
            found[i] = young[names[i]] = x
        return np.frombuffer(b"".join(found), dtype=np.int32), bounds_of(np.fromiter(map(len, found), np.int64, len(found)) // 4)

    def encode_units(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct units, one after the other, and their bounds; the texts' units by number, and the texts' bounds among them."""
        data, bounds = flat(pc.fill_null(texts.cast(pa.large_string()), "") if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        starts = unit_starts(data, bounds)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        codes, units, own = units.indices.to_numpy(), units.dictionary, np.searchsorted(starts, bounds)
        # a unit that stands inside a text somewhere begins with its space and doesn't end with one: such may be split as one text
        inside = np.ones(len(codes) + 1, dtype=bool)
        inside[own] = inside[own - 1] = False
        plain = np.zeros(len(units), dtype=bool)
        plain[codes[inside[:-1]]] = True
        data, bounds = flat(units.filter(pa.array(plain)))
        pieces = self.findall(data.tobytes().decode())
        ends = bounds_of(np.diff(flat(pa.array(pieces, pa.large_string()))[1]))
        first = np.searchsorted(ends, bounds)
        if first[-1] != len(pieces) or (ends[first] != bounds).any():  # a pattern that leaves something out or goes past a unit's end
            plain[:], pieces, first = False, [], np.zeros(1, dtype=np.int64)
        rest = list(map(self.findall, units.filter(pa.array(~plain)).to_pylist()))
        pieces.extend(chain.from_iterable(rest))
        place = np.empty(len(units), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(units))
        distinct = pa.array(pieces, pa.large_string()).dictionary_encode()
        ids, ends = gather(*self.encode_pieces(distinct.dictionary), distinct.indices.to_numpy())
        return ids, ends[np.append(first, first[-1] + np.cumsum(list(map(len, rest)), dtype=np.int64))], place[codes], own

    def encode_batch(self, texts: list[str] | pa.Array) -> Iterator[list[int]]:
        """Ids of each whole text."""
        ids, bounds, codes, own = self.encode_units(texts)
        ids, ends = gather(ids, bounds, codes)
        ends = ends[own].tolist()
        for a, b in zip(ends, ends[1:]):
            yield ids[a:b].tolist()

    def round_trip(self, texts: list[str] | pa.Array) -> Iterator[tuple[int, str, bytes]]:
        """Of each whole text the number of its ids, the ids in decimals joined by commas, and the bytes that they stand for;
        joined from those of its units."""
        ids, bounds, codes, own = self.encode_units(texts)
        sizes = np.diff(bounds)[codes]
        numbers = np.diff(bounds_of(sizes)[own]).tolist()
        if not sizes.all():  # nothing of a unit was matched: no comma either
            codes, own = codes[sizes > 0], bounds_of(sizes > 0)[own]
        which = pa.array(codes)
        decimals = joined(joined(self.decimals.take(pa.array(ids)), bounds, ",").take(which), own, ",")
        contents = joined(joined(self.contents.take(pa.array(ids)), bounds, "").take(which), own, "")
        yield from zip(numbers, decimals.to_pylist(), contents.to_pylist())

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids array<int>``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = list(own.encode_batch(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id, content binary``, the bytes that the ids stand for."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, content binary")


def round_trip_digest(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` in one pass over the texts."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                n, coded, decoded = [], [], []
                for size, decimals, content in own.round_trip(part.column(1)):
                    n.append(size)
                    coded.append(hashlib.sha256(decimals.encode()).hexdigest())
                    decoded.append(hashlib.sha256(content).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
