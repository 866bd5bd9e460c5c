"""Progressive JPEG in numpy: a decoder that accumulates scans into coefficient arrays, and an encoder of raw payloads.

Decoding goes scan by scan over many images at once. A restart interval can be read by itself, so the intervals of all
images whose next scan has the same parameters advance in lock-step, one Huffman symbol of each per round. Correction bits
of a refinement scan whose end-of-band run covers an interval are gathered at once; other refinement intervals are read
one symbol at a time.

``encode_payload`` stores bytes as the coefficients themselves (64 bytes a block, value byte + 256, quantiser 1) in a 4:2:0
image with eleven scans: DC and two AC bands without their lowest bit, then the refinements.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

BLOCK = 64
#: Added to a payload byte: every coefficient then is non-zero at any point transform used here.
LIFT = 256
INTERVAL = 16
BANDS = ((1, 5), (6, 63))
MAX_SIDE = 65_535
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@functools.cache
def zigzag() -> np.ndarray:
    """Natural index of each coefficient in zigzag order."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8)))
    return np.array([8 * r + c for _, _, r, c in cells])


@functools.cache
def transform() -> np.ndarray:
    """Inverse transform of a zigzag block to 64 samples, in integers scaled by 2**22.

    Sums of products stay below 2**53, so float matrix products are exact whatever their order: equal coefficients give
    equal samples.
    """
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.round(2**11 * np.where(k == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * k * np.pi / 16))
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()]


# ---------------------------------------------------------------- Huffman tables


def table_segment(kind: int, number: int, by_length: dict[int, list[int]]) -> bytes:
    counts = bytes(len(by_length.get(n, ())) for n in range(1, 17))
    body = bytes([kind << 4 | number]) + counts + b"".join(bytes(by_length[n]) for n in sorted(by_length))
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


@functools.lru_cache(maxsize=64)
def lookup(spec: bytes) -> np.ndarray:
    """For each 16-bit prefix, length << 8 | symbol (0: no code)."""
    out = np.zeros(1 << 16, dtype=np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            first = code << (16 - n)
            out[first : first + (1 << (16 - n))] = n << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


# ---------------------------------------------------------------- encoder

DC_CODES = {4: list(range(9))}  # categories 0 to 8, codes 0000 to 1000
AC_CODES = {1: [0x08], 4: [0x00, 0x10, 0x20, 0x30, 0x40]}  # a value of 8 bits: 0; end of 1, 2, 4, 8, 16 bands: 1000 to 1100


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def scan_header(components: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([ss, se, ah << 4 | al]))


def joined(intervals: list[bytes]) -> bytes:
    """Entropy-coded intervals with stuffed bytes and restart markers."""
    out = []
    for i, x in enumerate(intervals):
        if i:
            out.append(bytes([0xFF, 0xD0 | (i - 1) % 8]))
        out.append(x.replace(b"\xff", b"\xff\x00"))
    return b"".join(out)


def packed(bits: np.ndarray) -> bytes:
    """Bits, filled up with ones."""
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, dtype=np.uint8)))).tobytes()


def bits_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    which = np.repeat(np.arange(len(values)), lengths)
    return (values[which] >> (ends[which] - 1 - np.arange(len(which))) & 1).astype(np.uint8)


def dc_intervals(values: np.ndarray, pattern: list[int]) -> list[bytes]:
    """First DC scan of (MCU, block) values; pattern: the component of each block in an MCU."""
    out = []
    for a in range(0, len(values), INTERVAL):
        part = values[a : a + INTERVAL]
        diff = np.empty_like(part)
        for c in set(pattern):
            own = [i for i, p in enumerate(pattern) if p == c]
            diff[:, own] = np.diff(part[:, own].ravel(), prepend=0).reshape(len(part), -1)
        d = diff.ravel()
        category = np.frexp(np.abs(d).astype(np.float64))[1].astype(np.int64)
        extra = np.where(d < 0, d + (1 << category) - 1, d)
        out.append(packed(bits_of(category << category | extra, 4 + category)))
    return out


def band_intervals(values: np.ndarray) -> list[bytes]:
    """First AC scan where every value has eight bits: each is the code 0 and the value."""
    n, k = values.shape
    bits = np.zeros((n, k, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(values.astype(np.uint8)[:, :, None], axis=2)
    bits = bits.reshape(n, -1)
    return [packed(bits[a : a + INTERVAL].ravel()) for a in range(0, n, INTERVAL)]


def refine_intervals(values: np.ndarray) -> list[bytes]:
    """AC refinement where every value is non-zero already: one end-of-band run, then a bit for each value."""
    low = (values & 1).astype(np.uint8)
    out = []
    for a in range(0, len(low), INTERVAL):
        part = low[a : a + INTERVAL]
        r = len(part).bit_length() - 1
        head = (8 + r) << r | (len(part) - (1 << r))
        out.append(packed(np.concatenate((bits_of(np.array([head]), np.array([4 + r])), part.ravel()))))
    return out


def layout(n_blocks: int) -> tuple[int, int]:
    """MCU columns and rows of the image that holds so many payload blocks, six to an MCU."""
    mcus = max(1, -(-n_blocks // 6))
    across = min(mcus, max(64, -(-mcus // (MAX_SIDE // 16))))
    return across, -(-mcus // across)


@functools.lru_cache(maxsize=512)
def block_places(across: int, down: int) -> np.ndarray:
    """For each (MCU, block): its index among all blocks, the luma raster first, then both chroma rasters."""
    m = np.arange(across * down)
    r, c = m // across, m % across
    luma = [(2 * r + y) * 2 * across + 2 * c + x for y in (0, 1) for x in (0, 1)]
    return np.stack([*luma, 4 * len(m) + m, 5 * len(m) + m], axis=1)


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload, a positive multiple of 64 bytes."""
    n = len(payload) // BLOCK
    across, down = layout(n)
    places = block_places(across, down)
    mcus = across * down
    ordered = np.full((6 * mcus, BLOCK), LIFT, dtype=np.int64)
    ordered[:n] += np.frombuffer(payload, dtype=np.uint8).reshape(n, BLOCK)
    blocks = np.empty_like(ordered)
    blocks[places.ravel()] = ordered
    parts = [(1, blocks[: 4 * mcus]), (2, blocks[4 * mcus : 5 * mcus]), (3, blocks[5 * mcus :])]
    dc = ordered[:, 0].reshape(mcus, 6)
    out = [
        b"\xff\xd8", segment(0xFE, struct.pack(">Q", len(payload))), segment(0xDB, b"\0" + b"\1" * 64),
        segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        table_segment(0, 0, DC_CODES), table_segment(1, 0, AC_CODES), segment(0xDD, struct.pack(">H", INTERVAL)),
        scan_header([1, 2, 3], 0, 0, 0, 1), joined(dc_intervals(dc >> 1, [0, 0, 0, 0, 1, 2])),
    ]
    for lo, hi in BANDS:
        for c, part in parts:
            out += [scan_header([c], lo, hi, 0, 1), joined(band_intervals(part[:, lo : hi + 1] >> 1))]
    low = (dc & 1).astype(np.uint8)
    out += [scan_header([1, 2, 3], 0, 0, 1, 0), joined([packed(low[a : a + INTERVAL].ravel()) for a in range(0, mcus, INTERVAL)])]
    for c, part in parts:
        out += [scan_header([c], 1, 63, 1, 0), joined(refine_intervals(part[:, 1:]))]
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- decoder


@dataclass
class Component:
    number: int
    h: int
    v: int
    quantiser: int
    across: int = 0  # blocks, whole MCUs
    down: int = 0
    seen_across: int = 0  # blocks that scans of this component alone go over
    seen_down: int = 0
    first: int = 0  # of its blocks among the image's


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[bytes, bytes]]
    ss: int
    se: int
    ah: int
    al: int
    interval: int
    data: bytes


@dataclass
class Image:
    width: int = 0
    height: int = 0
    mcus: tuple[int, int] = (0, 0)
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    first: int = 0  # of its blocks among the batch's
    blocks: int = 0


def parse(data: bytes) -> Image:
    image, tables, interval = Image(), {}, 0
    at = 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            return image
        n = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + n]
        at += n
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                size = 128 if wide else 64
                image.quantisers[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + size], dtype=">u2" if wide else np.uint8).astype(np.float64)
                i += 1 + size
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                size = 16 + sum(body[i + 1 : i + 17])
                tables[body[i]] = body[i + 1 : i + 1 + size]
                i += 1 + size
        elif marker == 0xC2:
            _, image.height, image.width, k = struct.unpack(">BHHB", body[:6])
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
            hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
            image.mcus = (-(-image.width // (8 * hm)), -(-image.height // (8 * vm)))
            for c in image.components:
                c.across, c.down = image.mcus[0] * c.h, image.mcus[1] * c.v
                c.seen_across, c.seen_down = -(-image.width * c.h // (8 * hm)), -(-image.height * c.v // (8 * vm))
                c.first = image.blocks
                image.blocks += c.across * c.down
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman JPEG")
        elif marker == 0xDA:
            numbers = [c.number for c in image.components]
            own = [numbers.index(body[1 + 2 * i]) for i in range(body[0])]
            used = [(tables.get(body[2 + 2 * i] >> 4, b""), tables.get(16 | body[2 + 2 * i] & 15, b"")) for i in range(body[0])]
            ss, se, a = body[1 + 2 * body[0] :][:3]
            end = SCAN_END.search(data, at).start()
            image.scans.append(Scan(own, used, ss, se, a >> 4, a & 15, interval, data[at:end]))
            at = end


@functools.lru_cache(maxsize=1024)
def unit_blocks(mcus: tuple[int, int], components: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, list[int], int]:
    """For components (h, v, across, seen_across, seen_down, first): their blocks among the image's, in scan order."""
    if len(components) == 1:
        _, _, across, seen_across, seen_down, first = components[0]
        return first + (np.arange(seen_down)[:, None] * across + np.arange(seen_across)[None, :]).ravel(), [0], 1
    m = np.arange(mcus[0] * mcus[1])
    places, pattern = [], []
    for i, (h, v, across, _, _, first) in enumerate(components):
        for y in range(v):
            for x in range(h):
                places.append(first + (m // mcus[0] * v + y) * across + m % mcus[0] * h + x)
                pattern.append(i)
    return np.stack(places, axis=1).ravel(), pattern, len(pattern)


def scan_blocks(image: Image, scan: Scan) -> tuple[np.ndarray, list[int], int]:
    """Indices of a scan's blocks in order, the scan's component of each block in a unit, blocks in a unit."""
    own = tuple((c.h, c.v, c.across, c.seen_across, c.seen_down, c.first) for c in (image.components[k] for k in scan.components))
    places, pattern, unit = unit_blocks(image.mcus, own)
    return image.first + places, pattern, unit


class Bits:
    """Windows into the joined bytes of many intervals."""

    def __init__(self, intervals: list[bytes]):
        sizes = np.array([len(x) + 8 for x in intervals], dtype=np.int64)
        self.start = (np.cumsum(sizes) - sizes) * 8
        raw = np.frombuffer(b"".join([x + b"\xff" * 8 for x in intervals]), dtype=np.uint8)
        self.raw = raw
        w = raw.astype(np.uint32)
        window = w << 24
        window[:-1] |= w[1:] << 16
        window[:-2] |= w[2:] << 8
        window[:-3] |= w[3:]
        self.window = window

    def peek(self, at: np.ndarray) -> np.ndarray:
        """25 valid bits from each place, at the top of 32."""
        return self.window[at >> 3] << (at & 7).astype(np.uint32)

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n (0 to 16) bits."""
        return (self.peek(at).astype(np.int64) >> 16) >> (16 - n)


def extended(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)


def read_dc(bits: Bits, firsts: np.ndarray, counts: np.ndarray, places: np.ndarray, pattern: list[int], luts: list[np.ndarray], al: int, out: np.ndarray) -> None:
    at = bits.start.copy()
    before = np.zeros((len(set(pattern)), len(at)), dtype=np.int64)
    on = np.argsort(-counts, kind="stable")
    ordered = counts[on]
    for t in range(int(counts.max(initial=0))):
        on = on[: np.searchsorted(-ordered, -t, side="left")]
        c = pattern[t % len(pattern)]
        got = luts[c][bits.peek(at[on]) >> 16]
        at[on] += got >> 8
        s = got & 255
        before[c, on] += extended(bits.take(at[on], s), s)
        at[on] += s
        out[places[firsts[on] + t], 0] = before[c, on] << al


def read_band(bits: Bits, firsts: np.ndarray, counts: np.ndarray, places: np.ndarray, lut: np.ndarray, ss: int, se: int, al: int, out: np.ndarray) -> None:
    """First AC scan, one symbol of every interval a round."""
    on = np.flatnonzero(counts)
    at, block, left = bits.start[on], firsts[on], firsts[on] + counts[on]
    k = np.full(len(on), ss)
    row = places[block] if len(on) else block
    flat, stride = out.reshape(-1), out.shape[1]
    while len(at):
        w = bits.peek(at)
        got = lut[w >> 16]
        length, r, s = got >> 8, got >> 4 & 15, got & 15
        if int((length + s).max()) <= 25:
            v = (w << length.astype(np.uint32)).astype(np.int64) >> (32 - s)
        else:
            v = bits.take(at + length, s)
        plain = s > 0
        ended = None
        if plain.all():
            at += length + s
            k += r
            flat[row * stride + k] = extended(v, s) << al
            k += 1
        else:
            run = bits.take(at + length, np.where(plain | (r == 15), 0, r))
            at += length + np.where(plain, s, np.where(r == 15, 0, r))
            k = np.where(plain, k + r, np.where(r == 15, k + 16, k))
            flat[(row * stride + k)[plain]] = (extended(v, s) << al)[plain]
            k += plain
            ended = ~plain & (r < 15)
            block = np.where(ended, block + (1 << np.minimum(r, 14)) + run - 1, block)
        over = k > se if ended is None else (k > se) | ended
        if over.any():
            block = block + over
            k[over] = ss
            alive = block < left
            if not alive.all():
                at, block, left, k = at[alive], block[alive], left[alive], k[alive]
            row = places[block] if len(block) else block


def refine_one(data: bytes, rows: np.ndarray, lut: np.ndarray, ss: int, se: int, al: int, out: np.ndarray) -> None:
    """An AC refinement interval read symbol by symbol."""
    stream = int.from_bytes(data + b"\xff" * 8, "big")
    total = 8 * (len(data) + 8)
    at = 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        return stream >> (total - at) & ((1 << n) - 1)

    bit, run = 1 << al, 0
    for row in rows.tolist():
        block = out[row]
        k = ss
        if not run:
            while k <= se:
                got = int(lut[stream >> max(0, total - at - 16) & 0xFFFF])
                at += got >> 8
                r, s = got >> 4 & 15, got & 15
                value = 0
                if s:
                    value = bit if take(1) else -bit
                elif r < 15:
                    run = (1 << r) + take(r)
                    break
                while k <= se:
                    old = int(block[k])
                    if old:
                        if take(1) and not abs(old) & bit:
                            block[k] = old + (bit if old > 0 else -bit)
                    elif r:
                        r -= 1
                    else:
                        block[k] = value
                        k += 1
                        break
                    k += 1
        if run:
            while k <= se:
                old = int(block[k])
                if old and take(1) and not abs(old) & bit:
                    block[k] = old + (bit if old > 0 else -bit)
                k += 1
            run -= 1


def read_refinement(bits: Bits, intervals: list[bytes], firsts: np.ndarray, counts: np.ndarray, places: np.ndarray, lut: np.ndarray, ss: int, se: int, al: int, out: np.ndarray) -> None:
    got = lut[bits.peek(bits.start) >> 16]
    length, r, s = got >> 8, got >> 4 & 15, got & 15
    run = (1 << np.minimum(r, 14)) + bits.take(bits.start + length, np.where(r < 15, r, 0))
    whole = (s == 0) & (r < 15) & (run >= counts)
    for i in np.flatnonzero(~whole & (counts > 0)).tolist():
        refine_one(intervals[i], places[firsts[i] : firsts[i] + counts[i]], lut, ss, se, al, out)
    some = np.flatnonzero(whole & (counts > 0))
    if not len(some):
        return
    n = counts[some]
    rows = places[np.repeat(firsts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    old = out[rows, ss : se + 1]
    live = old != 0
    per_row = live.sum(axis=1)
    before_row = np.cumsum(per_row) - per_row
    first_row = np.cumsum(n) - n
    base = np.repeat(bits.start[some] + length[some] + r[some] - before_row[first_row], n)
    at = (base[:, None] + before_row[:, None] + np.cumsum(live, axis=1) - 1)[live]
    on = bits.raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
    own = old[live]
    old[live] = np.where((on == 1) & (np.abs(own) & (1 << al) == 0), own + np.where(own > 0, 1 << al, -(1 << al)), own)
    out[rows, ss : se + 1] = old


def read_group(group: list[tuple[Image, Scan]], out: np.ndarray) -> None:
    """Scans of one kind, of different images or components."""
    scan = group[0][1]
    all_places, intervals, firsts, counts, pattern, base = [], [], [], [], [0], 0
    for image, one in group:
        places, pattern, unit = scan_blocks(image, one)
        parts = [x.replace(b"\xff\x00", b"\xff") for x in (RESTART.split(one.data) if one.interval else [one.data])]
        step = one.interval * unit if one.interval else len(places)
        for i, x in enumerate(parts):
            if i * step >= len(places):
                break
            intervals.append(x)
            firsts.append(base + i * step)
            counts.append(min(step, len(places) - i * step))
        all_places.append(places)
        base += len(places)
    places, firsts, counts = np.concatenate(all_places), np.array(firsts, dtype=np.int64), np.array(counts, dtype=np.int64)
    bits = Bits(intervals)
    if scan.ss == 0 and scan.ah == 0:
        read_dc(bits, firsts, counts, places, pattern, [lookup(t[0]) for t in scan.tables], scan.al, out)
    elif scan.ss == 0:
        at = np.repeat(bits.start - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        on = (bits.raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(out.dtype)
        rows = places[np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        out[rows, 0] |= on << scan.al
    elif scan.ah == 0:
        read_band(bits, firsts, counts, places, lookup(scan.tables[0][1]), scan.ss, scan.se, scan.al, out)
    else:
        read_refinement(bits, intervals, firsts, counts, places, lookup(scan.tables[0][1]), scan.ss, scan.se, scan.al, out)


def decode_coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Images and the quantised coefficients (zigzag) of all their blocks, after every scan."""
    images, first = [], 0
    for data in files:
        image = parse(data)
        image.first = first
        first += image.blocks
        images.append(image)
    out = np.zeros((first, BLOCK), dtype=np.int32)
    todo = [(image, list(image.scans)) for image in images]
    while any(scans for _, scans in todo):
        groups: dict[tuple, list[tuple[Image, Scan]]] = {}
        for image, scans in todo:
            if not scans:
                continue
            kind = lambda s: (len(s.components) > 1 and tuple((image.components[c].h, image.components[c].v) for c in s.components), s.ss, s.se, s.ah, s.al, tuple(s.tables))  # noqa: B023, E731
            head, seen = kind(scans[0]), set()
            while scans and kind(scans[0]) == head and not seen & set(scans[0].components):
                seen |= set(scans[0].components)
                groups.setdefault(head, []).append((image, scans.pop(0)))
        for group in groups.values():
            read_group(group, out)
    return images, out


def samples(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Inverse transform of (n, 64) zigzag blocks to (n, 8, 8) samples."""
    table = transform() * quantiser[:, None]
    out = np.empty((len(coefficients), 8, 8), dtype=np.uint8)
    for a in range(0, len(coefficients), 8192):
        x = coefficients[a : a + 8192].astype(np.float64) @ table
        out[a : a + 8192] = np.clip(np.floor(x * 2.0**-22 + 128.5), 0, 255).astype(np.uint8).reshape(-1, 8, 8)
    return out


def rgb(image: Image, coefficients: np.ndarray, ready: np.ndarray | None = None) -> np.ndarray:
    """Full-resolution (height, width, 3) tensor; chroma is repeated up to luma's grid. ready: samples of all blocks."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        a = image.first + c.first
        own = slice(a, a + c.across * c.down)
        blocks = ready[own] if ready is not None else samples(coefficients[own], image.quantisers[c.quantiser])
        plane = blocks.reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.down, 8 * c.across)
        plane = plane.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.stack(planes * 3, axis=2)
    y, cb, cr = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), dtype=np.uint8)
    # fixed values: the JFIF colour transform in 1/65536
    out[:, :, 0] = np.clip(y + ((91_881 * cr + 32_768) >> 16), 0, 255)
    out[:, :, 1] = np.clip(y - ((22_554 * cb + 46_802 * cr + 32_768) >> 16), 0, 255)
    out[:, :, 2] = np.clip(y + ((116_130 * cb + 32_768) >> 16), 0, 255)
    return out


def read_payload(image: Image, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    (size,) = struct.unpack(">Q", image.comment)
    rows = image.first + block_places(*image.mcus).ravel()[: size // BLOCK]
    values = coefficients[rows] - LIFT
    if values.min() < 0 or values.max() > 255:
        raise ValueError("a coefficient is out of the payload's range")
    return values.astype(np.uint8).tobytes()


def describe(tensor: np.ndarray) -> str:
    """Size, channel sums and checksum of a tensor."""
    h, w, _ = tensor.shape
    sums = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{w}x{h};" + ",".join(map(str, sums.tolist())) + f";{zlib.crc32(tensor.tobytes()):08x}"
