"""Whole-text byte-level BPE through a cache of space-delimited units.

The split pattern never lets a match cross from a non-space to a space, so a text may be cut before each single space that
stands between two non-space characters, and each unit (with its leading space) encoded by itself. Units repeat, whole
texts don't: a bounded cache makes the common ones a dictionary lookup.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

#: Entries kept by one Python worker.
CACHE = 300_000
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space as UTF-8: which single bytes, and which numbers of two and of three bytes (there is none of four).
WHITE = [c.encode() for c in map(chr, range(1 << 16)) if c.isspace()]
WHITE_1 = np.isin(np.arange(256), [c[0] for c in WHITE if len(c) == 1])
WHITE_2, WHITE_3 = (np.array([int.from_bytes(c) for c in WHITE if len(c) == n]) for n in (2, 3))


def units_of(text: str) -> list[str]:
    """The units of a text; ``"".join`` of them gives the text again."""
    parts = text.split(" ")
    for p in parts:
        if not p or p[0].isspace() or p[-1].isspace():
            parts = INNER_SPACE.split(text)
            break
    return parts[:1] + [" " + p for p in parts[1:]]


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the units of many texts begin in their joined UTF-8; ``bounds`` has the texts' own ends, 0 first. An empty text has none."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    at = np.flatnonzero(data == 32)
    at = at[~edge[at] & ~edge[at + 1]]
    white = WHITE_1[data[at - 1]] | WHITE_1[data[at + 1]]

    def number(x: np.ndarray, n: int) -> np.ndarray:
        return functools.reduce(lambda a, i: a << 8 | data.take(x + i, mode="clip"), range(n), np.zeros(len(x), dtype=np.int64))

    for side, two, three in ((1, 1, 1), (-1, -2, -3)):
        wide = np.flatnonzero(data[at + side] >= 128)
        white[wide] |= np.isin(number(at[wide] + two, 2), WHITE_2) | np.isin(number(at[wide] + three, 3), WHITE_3)
    edge[at[~white]] = True
    return np.flatnonzero(edge[:-1])


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a ``.tiktoken`` file or a byte-level BPE ``.json`` whose ids follow its merges."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    alphabet = byte_alphabet()
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
    order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if any(a >= b for a, b in zip(order, order[1:])):
        raise ValueError(f"{path}: the ids don't follow the order of the merges")
    return ranks


class UnitEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str, limit: int = CACHE):
        import tiktoken

        self.encode = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=byte_ranks(path), special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}
        self.limit = limit

    def __call__(self, text: str) -> bytes:
        parts = text.split(" ")
        get = self.cache.get
        found = [get(p) for p in parts]
        if None in found or not parts[0]:
            for i, x in enumerate(found):
                if x is None:
                    p = parts[i]
                    if not p or p[0].isspace() or p[-1].isspace():
                        return b"".join([self.unit(u) for u in units_of(text)])
                    found[i] = self.unit(" " + p)
        found[0] = self.unit(parts[0])
        return b"".join(found)

    def unit(self, u: str) -> bytes:
        """Cached under the unit without its leading space; only units with one are kept."""
        key = u[1:] if u[:1] == " " else None
        got = self.cache.get(key) if key else None
        if got is None:
            got = np.array(self.encode(u), dtype="<u4").tobytes()
            if key and not key[0].isspace() and not key[-1].isspace() and len(self.cache) < self.limit:
                self.cache[key] = got
        return got


@functools.lru_cache(maxsize=4)
def unit_encoder(path: str, pattern: str) -> UnitEncoder:
    """One per Python worker: its cache lasts over tasks."""
    return UnitEncoder(path, pattern)
