"""Cost-balanced packing of tokenized documents into fixed-length sequences.

A document's ids (and a closing id) are cut into full pieces, each a sequence by itself, and one shorter rest. The rests
are dealt by a hash of the row into pools of about ``POOL`` documents, which bounds a task however large the table is. In a
pool, rests go in descending length to the open sequence with the lowest estimated attention cost (linear plus quadratic
in piece length) that has room. Where none has room, the rest is cut to fill the roomiest sequences, so that a pool wastes
less than one sequence of padding.

Defined cases: null and empty texts are the closing id alone; repeated rows are packed row by row; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, slices
from .tokens import unit_encoder

CAPACITY = 1024
POOL = 4096
#: Cost of a piece of n ids: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, pool int"


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


class OpenSequences:
    """Open sequences by room, with the cheapest one at least so roomy found in logarithmic time.

    A heap of (cost, sequence) stands at each room; a segment tree over rooms keeps the least heap top.
    """

    def __init__(self, n: int, capacity: int):
        import heapq

        self.heapq, self.size = heapq, 1 << (capacity + 1).bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree: list[tuple[float, int, int]] = [(float("inf"), -1, -1)] * (2 * self.size)
        self.heaps[capacity] = [(0.0, s) for s in range(n)]
        self.top(capacity)

    def top(self, room: int) -> None:
        i, h = self.size + room, self.heaps[room]
        self.tree[i] = (*h[0], room) if h else (float("inf"), -1, -1)
        while i > 1:
            i >>= 1
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def cheapest(self, room: int) -> tuple[float, int, int] | None:
        """Take out the lowest-cost sequence with at least this room."""
        best, lo, hi = (float("inf"), -1, -1), self.size + room, 2 * self.size
        while lo < hi:
            if lo & 1:
                best = min(best, self.tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, self.tree[hi])
            lo >>= 1
            hi >>= 1
        return self.take(best)

    def roomiest(self) -> tuple[float, int, int] | None:
        i = 1
        while i < self.size:
            i = 2 * i + 1 if self.tree[2 * i + 1][1] >= 0 else 2 * i
        return self.take(self.tree[i])

    def take(self, best: tuple[float, int, int]) -> tuple[float, int, int] | None:
        if best[1] < 0:
            return None
        self.heapq.heappop(self.heaps[best[2]])
        self.top(best[2])
        return best

    def put(self, total: float, s: int, room: int) -> None:
        if room:
            self.heapq.heappush(self.heaps[room], (total, s))
            self.top(room)


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(item, start in item, length, sequence, offset) for items given in descending length."""
    opened = OpenSequences(parts_for(sum(lengths), capacity), capacity)
    out = []
    for item, n in enumerate(lengths):
        at = 0
        while at < n:
            got = opened.cheapest(n - at) or opened.roomiest()
            if got is None:
                raise AssertionError("no room although the sequences were counted")
            total, s, room = got
            m = min(room, n - at)
            out.append((item, at, m, s, capacity - room))
            opened.put(total + cost(m), s, room - m)
            at += m
    return out


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    pools = parts_for(docs.count(), POOL)
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [c.split(" ")[0] for c in CUT.split(", ")][:-1]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = unit_encoder(tokenizer, pattern)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for d, t, pool in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = encode(t or "") + end
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    m = min(capacity, n - a)
                    x = ids[4 * a : 4 * (a + m)]
                    rows.append((d, a, m, crc(x), n, None if m == capacity else x, pool))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int32()])], names=[*names, "pool"])

    def fill(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) << 32
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        full = rows[rows["ids"].isna()]
        rest = rows[rows["ids"].notna()]
        out = list(zip(full["doc_id"], full["start"], full["length"], full["ids_crc32"], full["doc_tokens"], range(base, base + len(full)), [0] * len(full)))
        items = list(zip(rest["doc_id"], rest["start"], rest["doc_tokens"], rest["ids"]))
        for item, at, m, s, offset in pack(rest["length"].tolist(), capacity):
            d, start, n, ids = items[item]
            out.append((d, start + at, m, crc(ids[4 * at : 4 * (at + m)]), n, base + len(full) + s, offset))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in PIECE.split(", ")])

    # rows of one id or of one text spread over pools; a hash of the row gives the same pool when a task is run again
    pool = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(pools)).cast("int")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), pool.alias("pool"))
    return slim.mapInArrow(pieces, CUT).groupBy("pool").applyInPandas(fill, PIECE)
