"""Removal of repeated byte strings by suffix arrays and common-prefix interval trees.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. The steps, each over
all data:

1. Anchors. Every such string holds ``LENGTH - GRAM + 1`` grams; the one with the least hash (the leftmost of equals) is its
   anchor, so equal strings have equal anchors. Consecutive strings often share one, which leaves an anchor every 13 bytes.
2. Anchors that occur in two documents or more are found by hash bucket, from packed arrays of distinct hashes.
3. Around each such anchor, the stretch that its strings cover (at most ``2 * LENGTH - GRAM`` bytes) goes to the anchor's
   bucket, once per block of documents and distinct stretch. There an enhanced suffix array over the starts of strings is
   scanned level by level: its common-prefix intervals of at least ``LENGTH`` bytes whose occurrences have different left
   neighbours are the maximal repeats, each with all its occurrences and so with its smallest document.
4. Occurrences in larger documents go back to the blocks, where spans are joined and cut out.

A stretch that thousands of documents share is one row per block, whatever the number of copies. Hash collisions only add
candidates; the suffix array compares the bytes themselves.

Defined cases: null and empty texts have nothing to remove; rows that repeat a ``doc_id`` don't remove from one another;
rows without an id come after all others and are one document in this respect; a character of which a part is removed goes
whole from ``text``; an empty table gives no rows; the whole row rides along unchanged, whatever its columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts_for, slices, text_bytes

LENGTH, GRAM = 50, 24
#: Bytes of text in a block, anchors in a hash bucket, bytes hashed together, hashes held by a scanning task.
BLOCK_BYTES, BUCKET_ANCHORS, TOGETHER, HELD = 8 << 20, 1 << 20, 1 << 19, 2 << 20
#: Suffixes compared at once.
ROWS = 1 << 16
POSITION_BITS = 24
ODD = 0x9E3779B97F4A7C15


def byte_codes() -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


CODES = byte_codes()


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (16 to 31) from each position, by doubling."""
    power = lambda n: np.uint64(pow(ODD, n, 1 << 64))
    h = {1: CODES[data]}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * power(n) + h[n][n:]
    n, out = 16, h[16]
    while n < gram:
        k = 1 << ((gram - n).bit_length() - 1)
        size = len(data) - n - k + 1
        out = out[:size] * power(k) + h[k][n : n + size]
        n += k
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(contents: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first string start, last string start, anchor hash) of every run of strings with one anchor."""
    out = []
    group, size = [], 0

    def run(pieces: list[tuple[int, int, bytes]]) -> None:
        data = np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8)
        if len(data) < length:
            return
        sizes = np.array([len(p) for _, _, p in pieces], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        h = gram_hashes(data, gram)
        low = np.uint64((1 << POSITION_BITS) - 1)
        least = window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        inside = owner[: len(least)] == owner[length - 1 :]
        fresh = inside.copy()
        fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        start = np.flatnonzero(fresh)
        if not len(start):
            return
        stop = np.flatnonzero(inside & np.append((least[1:] != least[:-1]) | ~inside[1:], True))
        own = owner[start]
        base = first[own] - np.array([b for _, b, _ in pieces], dtype=np.int64)[own]
        docs = np.array([d for d, _, _ in pieces], dtype=np.int64)[own]
        out.append((docs, start - base, stop - base, h[(least[start] & low).astype(np.int64)]))

    most = 1 << (POSITION_BITS - 1)
    for d, content in enumerate(contents):
        for a in range(0, max(1, len(content) - length + 1), most):
            piece = content[a : a + most + length - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > TOGETHER and group:
                run(group)
                group, size = [], 0
            group.append((d, a, piece))
            size += len(piece)
    if group:
        run(group)
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def enhanced_suffix_array(strings: list[bytes], owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (string, start), and the common prefix of each with the one before it."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    width = int(sizes.max(initial=1))
    gap = b"\0" * width
    flat = np.frombuffer(gap.join(strings) + gap, dtype=np.uint8)
    at = (np.cumsum(sizes + width) - sizes - width)[owner] + start
    left = sizes[owner] - start
    # a zero byte sorts like the end of a suffix, so the shorter of equals must come first
    by = np.argsort(left, kind="stable") if any(b"\0" in s for s in strings) else np.arange(len(at))
    table = np.lib.stride_tricks.sliding_window_view(flat, width)[at[by]]
    order = np.argsort(table.view(f"S{width}").ravel(), kind="stable")
    left = left[by[order]]
    lcp = np.zeros(len(order), dtype=np.int64)
    for a in range(1, len(order), ROWS):
        own = table[order[a - 1 : a + ROWS]]
        differs = own[1:] != own[:-1]
        at = differs.argmax(axis=1)
        lcp[a : a + ROWS] = np.where(differs[np.arange(len(at)), at], at, width)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
    return by[order], lcp


def interval_tree(lcp: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(common prefix, first, last) of all intervals of the suffix array with a common prefix of ``least`` or more, deepest
    level last: the intervals of one common prefix are where a run of at least so long ones has one of just that length."""
    at = np.flatnonzero(lcp >= least)
    own = lcp[at]
    for common in np.unique(own).tolist():
        deep = own >= common
        at, own = at[deep], own[deep]
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        end = np.append(begin[1:], len(at))
        exact = np.logical_or.reduceat(own == common, begin)
        yield common, at[begin[exact]] - 1, at[end[exact] - 1]


def repeats(strings: list[bytes], again: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, first occurrence of each, string, start, whether of a second copy of all occurrences) of the maximal repeats of
    at least ``length`` bytes, by length. ``again``: strings that stand there twice.

    A repeat is reported, as far as it goes, where its occurrences have different left neighbours (a string's start counts as
    one of its own) and, by the interval, different right ones.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    counts = np.maximum(0, sizes - length + 1)
    owner = np.repeat(np.arange(len(strings)), counts)
    if not len(owner):
        return
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    order, lcp = enhanced_suffix_array(strings, owner, start)
    # a second copy's suffixes come right after the first one's, and share all of them
    times = 1 + again[owner[order]]
    owner, start, lcp = (np.repeat(x, times) for x in (owner[order], start[order], lcp))
    copy = np.zeros(len(owner), dtype=bool)
    copy[(np.cumsum(times) - 1)[times == 2]] = True
    lcp[copy] = (sizes[owner] - start)[copy]
    flat = np.frombuffer(b"\0" + b"".join(strings), dtype=np.uint8)
    before = flat[(np.cumsum(sizes) - sizes)[owner] + start]
    changes = np.cumsum(np.append(True, (before[1:] != before[:-1]) | (start[1:] == 0) | (start[:-1] == 0)))
    for common, first, last in interval_tree(lcp, length):
        diverse = changes[last] > changes[first]
        n = (last - first + 1)[diverse]
        if len(n):
            edge = np.cumsum(n) - n
            row = np.repeat(first[diverse] - edge, n) + np.arange(n.sum())
            yield common, edge, owner[row], start[row], copy[row]


def maximal_repeats(strings: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences as (string, start)) of every maximal repeat of at least ``length`` bytes."""
    for common, edge, owner, start, _ in repeats(strings, np.zeros(len(strings), dtype=bool), length):
        for own, at in zip(np.split(owner, edge[1:]), np.split(start, edge[1:])):
            yield common, list(zip(own.tolist(), at.tolist()))


def smallest_holders(strings: list[bytes], low: list[int], high: list[int], length: int = LENGTH) -> np.ndarray:
    """(string, start, end, smallest document) of every maximal repeat in a string that is in a larger document too, as rows.

    ``low`` and ``high``: the smallest and largest document that hold each (distinct) string. A string that several
    documents hold stands there twice, for its first holder and for the others, so that its copies are a repeat like any.
    """
    lows, highs = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)
    again = lows < highs
    out = [np.empty((0, 4), dtype=np.int64)]
    for common, edge, owner, start, copy in repeats(strings, again, length):
        holder = np.where(copy, highs[owner], lows[owner])
        least = np.repeat(np.minimum.reduceat(holder, edge), np.diff(np.append(edge, len(owner))))
        on = (least < holder) & (copy | ~again[owner])  # a string of several documents answers for the others
        out.append(np.stack((owner[on], start[on], start[on] + common, least[on]), axis=1))
    return np.concatenate(out)


def smallest_documents(strings: list[bytes], low: list[int], high: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """``smallest_holders`` one by one."""
    yield from map(tuple, smallest_holders(strings, low, high, length).tolist())


def squeeze(content: bytes) -> bytes:
    return zstandard.compress(content, 3)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers in one compressed value."""
    return squeeze(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpacked(content: bytes, kind: type = np.int64, columns: int = 1) -> np.ndarray:
    """What ``packed`` took, a row for each column."""
    return np.frombuffer(zstandard.decompress(content), dtype=kind).reshape(columns, -1)


def spans_of(docs: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined spans (overlapping or touching), in document order."""
    order = np.lexsort((start, docs))
    docs, start, end = docs[order], start[order], end[order]
    wide = np.int64(1) << 40
    reach = np.maximum.accumulate(docs * wide + end)
    fresh = np.ones(len(docs), dtype=bool)
    fresh[1:] = docs[1:] * wide + start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return docs[first], start[first], reach[np.append(first[1:], len(docs)) - 1] - docs[first] * wide if len(docs) else end


SHARED = "block int, bucket int, hashes binary"
FOUND = "part int, block int, own binary, sizes binary, bytes binary, low binary, high binary"
FOUND_SCHEMA = pa.schema([(c.split(" ")[0], pa.int32() if c.endswith(" int") else pa.binary()) for c in FOUND.split(", ")])


NO_ID = np.iinfo(np.int64).max


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the row's other columns as they are), ``content binary`` (the bytes that stay), ``text``, ``n_removed``, ``n_spans``
    for every row.

    ``text`` is ``content`` as a string, without characters that were cut in two; null for a null text.
    """
    total = text_bytes(docs, text)
    blocks = parts_for(total, BLOCK_BYTES)
    bits = max(0, (parts_for(total // 13, BUCKET_ANCHORS) - 1).bit_length())
    stretch_parts = max(12, 4 * blocks)
    shift = np.uint64(32 - bits)
    short = lambda h: h >> shift  # noqa: E731  the bucket's bits and 32 more

    # rows of one id spread over blocks, as long as their texts differ
    block = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks)).cast("int")
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("content"), block.alias("block"),
        F.struct(F.col(text).isNull().alias("null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]).alias("row"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct anchor hashes of each block's documents, by bucket, with a bit for those in two documents here."""
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out = []
            for block, parts in held.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                high = values >> np.uint64(32)
                edges = [0, *(np.flatnonzero(high[1:] != high[:-1]) + 1).tolist(), len(values)]  # buckets that are there, not all there are
                for a, b in zip(edges, edges[1:]):
                    out.append((int(high[a]), block, values[a:b].astype(np.uint32).tobytes(), np.packbits(counts[a:b] > 1).tobytes()))
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "hashes", "twice"])

        for batch in (part for whole in batches for part in slices(whole, 1)):
            contents = [x.as_py() for x in batch.column(1)]
            block_ids = batch.column(2).to_numpy()
            ids = batch.column(0).to_pylist()
            number: dict = {}
            same = np.array([number.setdefault(i, len(number)) for i in ids])  # rows of one doc_id are one document
            d, _, _, h = anchors(contents, length, gram)
            if not len(d):
                continue
            order = np.lexsort((short(h), same[d]))
            key, doc, own = short(h)[order], same[d][order], block_ids[d][order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
            key, own = key[fresh], own[fresh]
            by = np.argsort(own, kind="stable")
            key, own = key[by], own[by]
            edges = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for b, part in zip(own[edges].tolist(), np.split(key, edges[1:])):
                held.setdefault(b, []).append(part)
            size += len(key)
            if size > HELD:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    def shared(bucket: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(x, dtype=np.uint32) for x in part["hashes"]]
        every = np.sort(np.concatenate(values))
        seen = [every[1:][every[1:] == every[:-1]]]
        seen += [v[np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=len(v)).astype(bool)] for v, t in zip(values, part["twice"])]
        often = np.unique(np.concatenate(seen))
        out = []
        for block, v in zip(part["block"], values):
            i = np.minimum(np.searchsorted(often, v), max(0, len(often) - 1))
            if len(often) and len(x := v[often[i] == v]):
                out.append((block, bucket[0], x.tobytes()))
        return pd.DataFrame(out, columns=["block", "bucket", "hashes"])

    def in_order(left: pa.Table) -> tuple[np.ndarray, list[bytes], pa.Array]:
        """Ids and contents of a block's rows by id and content, the same in both passes, and their places in the table."""
        ids, contents = left.column("id").to_numpy(), left.column("content").to_pylist()
        order = sorted(range(len(contents)), key=lambda i: (ids[i], contents[i]))
        return ids[order], [contents[i] for i in order], pa.array(order, pa.int64())

    def stretches(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own_block = key[0].as_py()
        right = right.to_pydict()
        if not left.num_rows or not right["block"]:
            return FOUND_SCHEMA.empty_table()
        numbers, contents, _ = in_order(left)
        ids = numbers.tolist()
        often = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, x in zip(right["bucket"], right["hashes"])]))
        index: dict[bytes, int] = {}
        low: list[int] = []
        high: list[int] = []
        part: list[int] = []
        where = ([], [], [])
        for a in range(0, len(contents), 512):
            d, s, e, h = anchors(contents[a : a + 512], length, gram)
            k = short(h)
            on = often[np.minimum(np.searchsorted(often, k), len(often) - 1)] == k
            for doc, x, y, z in zip((d[on] + a).tolist(), s[on].tolist(), (e[on] + length).tolist(), (h[on] % np.uint64(stretch_parts)).tolist()):
                one = contents[doc][x:y]
                i = index.get(one)
                if i is None:
                    i = index[one] = len(low)
                    low.append(ids[doc])
                    high.append(ids[doc])
                    part.append(z)
                else:
                    high[i] = ids[doc]  # documents come in ascending order
                where[0].append(doc)
                where[1].append(x)
                where[2].append(i)
        if not index:
            return FOUND_SCHEMA.empty_table()
        own = packed(*[np.array(c, dtype=np.int64) for c in where])
        strings = list(index)
        by = np.argsort(np.array(part), kind="stable")
        place = np.array(part)[by]
        out = [(-1 - own_block, own_block, own, None, None, None, None)]  # goes past the search, to its own block
        for group in np.split(by, np.flatnonzero(place[1:] != place[:-1]) + 1):
            rows_of = group.tolist()
            out.append((
                part[rows_of[0]], own_block, packed(np.array(rows_of, dtype=np.int64)), packed(np.array([len(strings[i]) for i in rows_of], dtype=np.uint16)), squeeze(b"".join([strings[i] for i in rows_of])),
                packed(np.array([low[i] for i in rows_of], dtype=np.int64)), packed(np.array([high[i] for i in rows_of], dtype=np.int64)),
            ))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND_SCHEMA)], schema=FOUND_SCHEMA)

    def resolve(key: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "answer", "own"]
        if key[0] < 0:
            return pd.DataFrame({"block": part["block"], "answer": None, "own": part["own"]})
        index: dict[bytes, int] = {}
        low: list[int] = []
        high: list[int] = []
        holders: list[tuple[int, np.ndarray, np.ndarray]] = []
        for block, own, sizes, joined, lo, hi in zip(part["block"], part["own"], part["sizes"], part["bytes"], part["low"], part["high"]):
            at, numbers, joined = 0, [], zstandard.decompress(joined)
            for n, a, b in zip(unpacked(sizes, np.uint16)[0].tolist(), unpacked(lo)[0].tolist(), unpacked(hi)[0].tolist()):
                one = joined[at : at + n]
                at += n
                i = index.get(one)
                if i is None:
                    i = index[one] = len(low)
                    low.append(a)
                    high.append(b)
                else:
                    low[i], high[i] = min(low[i], a), max(high[i], b)
                numbers.append(i)
            holders.append((block, unpacked(own)[0], np.array(numbers, dtype=np.int64)))
        table = smallest_holders(list(index), low, high, length)
        if not len(table):
            return pd.DataFrame([], columns=columns)
        table = table[np.argsort(table[:, 0], kind="stable")]
        out = []
        for block, own, numbers in holders:
            a, b = np.searchsorted(table[:, 0], numbers), np.searchsorted(table[:, 0], numbers, side="right")
            n = b - a
            if n.sum():
                rows_of = table[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                out.append((block, packed(np.repeat(own, n), rows_of[:, 1], rows_of[:, 2], rows_of[:, 3]), None))
        return pd.DataFrame(out, columns=columns)

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, contents, order = in_order(left)
        right = right.to_pydict()
        gone: dict[int, list[tuple[int, int]]] = {}
        answers = [unpacked(x, columns=4) for x in right["answer"] if x is not None]
        owns = [unpacked(x, columns=3) for x in right["own"] if x is not None]
        if answers and owns:
            one = np.concatenate(answers, axis=1)
            one = one[:, np.argsort(one[0], kind="stable")]
            doc, at, number = np.concatenate(owns, axis=1)
            a, b = np.searchsorted(one[0], number), np.searchsorted(one[0], number, side="right")
            n = b - a
            row = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            doc, at = np.repeat(doc, n), np.repeat(at, n)
            _, start, end, least = one[:, row]
            on = least < ids[doc]
            for d, s, e in zip(*(x.tolist() for x in spans_of(doc[on], at[on] + start[on], at[on] + end[on]))):
                gone.setdefault(d, []).append((s, e))
        kept, text_of, removed, count = [], [], [], []
        for d, content in enumerate(contents):
            spans = gone.get(d, [])
            at, parts = 0, []
            for s, e in spans:
                parts.append(content[at:s])
                at = e
            parts.append(content[at:])
            kept.append(b"".join(parts))
            # part by part, so that halves of two characters don't make a third
            text_of.append("".join(x.decode("utf-8", "ignore") for x in parts) if spans else content.decode("utf-8", "replace"))
            removed.append(sum(e - s for s, e in spans))
            count.append(len(spans))
        row = left.column("row").combine_chunks().take(order)
        text_of = [None if none else t for none, t in zip(row.field("null").to_pylist(), text_of)]
        return pa.Table.from_arrays([row, pa.array(kept, pa.binary()), pa.array(text_of, pa.string()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], names=["row", "content", "text", "n_removed", "n_spans"])

    hashes = rows.select("id", "content", "block").mapInArrow(scan, "bucket int, block int, hashes binary, twice binary")
    often = hashes.groupBy("bucket").applyInPandas(shared, SHARED)
    by_block = rows.groupBy("block")
    # one plan from here on: both cogroups read the same exchange of the texts, which is written once
    found = by_block.cogroup(often.groupBy("block")).applyInArrow(stretches, FOUND)
    back = found.groupBy("part").applyInPandas(resolve, "block int, answer binary, own binary")
    shape = T.StructType([rows.schema["row"], *T.StructType.fromDDL("content binary, text string, n_removed long, n_spans long").fields])
    out = by_block.cogroup(back.groupBy("block")).applyInArrow(remove, shape)
    others = F.struct(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns) if c != text]) if len(docs.columns) > 1 else F.struct()
    return out.select(others.alias("row"), "content", "text", "n_removed", "n_spans")


def cleaned_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, their texts without what an earlier document has; ``size``, where there is such a
    column, counts the characters that stay. Rows of which nothing is removed stay as they are, null texts too."""
    out = cut_repeats(docs, doc_id=doc_id, text=text)
    own = lambda c: F.col("row")[c]
    count = lambda c: F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own(c))
    return out.select(*[F.col("text").alias(c) if c == text else count(c).alias(c) if c == size else own(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame, doc_id: str = "doc_id", **kw) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    out = cut_repeats(docs, doc_id=doc_id, **kw)
    size = F.octet_length("content").cast("long")
    return out.select(F.col("row")[doc_id].cast("long").alias("doc_id"), (size + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", F.sha2("content", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The same digest by looking at every string: for tests."""
    first: dict[bytes, int] = {}
    for d, c in rows:
        for i in range(len(c) - length + 1):
            s = c[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, c in rows:
        gone = bytearray(len(c))
        for i in range(len(c) - length + 1):
            if first[c[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(c, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(c), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
