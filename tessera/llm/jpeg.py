"""Progressive JPEG in numpy: many images at a time, coefficients exactly as they were put in.

Images are three components at 4:2:0 with all quantizers 1. Every scan holds one component: for each component the
DC coefficients (all but the lowest bit, then that bit), the AC bands 1-5 and 6-63 (all but the lowest bit), then
their lowest bits. A restart marker follows every `RESTART` blocks; what stands between two markers can be decoded
alone, so the decoder steps through all such segments of all images of a batch at once, a symbol of each per step.
The decoder takes tables, sampling, quantizers and restart interval from the file; it reads files whose scans hold one
component each, as the encoder makes them, and raises ValueError for others.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

RESTART = 4
BANDS = ((1, 5), (6, 63))
COMPONENTS = ((1, 2), (2, 1), (3, 1))  # id, sampling in both directions
MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@lru_cache
def zigzag() -> np.ndarray:
    """Raster place of each coefficient: along diagonals, up the even ones and down the odd ones."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@lru_cache
def cosines() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: samples of a block by raster."""
    n = np.arange(8)
    c = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n == 0, np.sqrt(0.5), 1)[:, None] / 2
    return np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)[zigzag()]


def dc_lengths() -> dict[int, int]:
    return {s: 3 if s < 7 else 5 if s < 9 else 6 for s in range(12)}


def first_lengths() -> dict[int, int]:
    """Code lengths for letters' coefficients: long runs and great values are rare."""
    out = {0x00: 6} | dict(zip(range(1, 8), (6, 5, 3, 1, 4, 3, 5)))
    out |= {r << 4 | s: 10 if s < 7 else 13 for r in range(1, 16) for s in range(1, 8)}
    return out | {r << 4: 13 for r in range(1, 16)}


def refine_lengths() -> dict[int, int]:
    return {0x00: 1} | {r << 4 | 1: 6 for r in range(16)} | {r << 4: 8 for r in range(1, 16)}


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body (16 counts, symbols), and each symbol's code and length."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, now, last = np.zeros(256, "u8"), np.zeros(256, "i8"), 0, 0
    for s in order:
        now <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = now, last
        now += 1
    counts = np.bincount(list(lengths.values()), minlength=17)[1:17]
    return bytes(counts.astype("u1")) + bytes(order), code, size


DC, FIRST, REFINE = (canonical(f()) for f in (dc_lengths, first_lengths, refine_lengths))


def bit_sizes(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype("f8"))[1].astype("i8")


def blocks_of(n: int) -> tuple[int, int]:
    """Width and height in 16x16 units for n payload blocks: six blocks a unit, rows of at most 32 until too high."""
    units = max(-(-n // 6), 1)
    wide = min(units, max(32, -(-units // 4095)))
    return wide, -(-units // wide)


@dataclass
class Segments:
    """Blocks of a batch, dealt to restart segments: number of each block's segment, and where components begin."""

    counts: list[int]  # blocks of each (image, component)

    def __post_init__(self) -> None:
        c = np.array(self.counts, "i8")
        per = -(-c // RESTART)
        self.first = np.concatenate(([0], np.cumsum(per)))
        self.n = int(self.first[-1])
        self.inner = np.arange(self.n) - np.repeat(self.first[:-1], per)  # number within its scan
        start = np.repeat(np.concatenate(([0], np.cumsum(c)))[:-1], per) + self.inner * RESTART
        size = np.minimum(np.repeat(c, per) - self.inner * RESTART, RESTART)
        self.block0, self.of = start, np.repeat(np.arange(self.n), size)
        self.starts = np.zeros(int(c.sum()), bool)
        self.starts[start] = True

    def write(self, code: np.ndarray, size: np.ndarray, pos: np.ndarray, seg: np.ndarray, bits: np.ndarray) -> list[bytes]:
        """Entropy-coded bytes of each (image, component): codes of `size` bits at `pos` within their segment, ones to
        the next byte, a zero after each 255, restart markers between segments."""
        n_bytes = (bits + 7) // 8
        start = np.concatenate(([0], np.cumsum(n_bytes)))
        pad = n_bytes * 8 - bits
        at = np.concatenate((start[seg] * 8 + pos, start[:-1] * 8 + bits))
        code = np.concatenate((code.astype("u8"), (np.uint64(1) << pad.astype("u8")) - np.uint64(1)))
        size = np.concatenate((size, pad))
        some = size > 0
        at, code, size = at[some], code[some], size[some]
        v = code << (64 - size - (at & 31)).astype("u8")
        word, n_words = at >> 5, int(start[-1] // 4 + 2)
        w = np.bincount(word, (v >> np.uint64(32)).astype("f8"), n_words) + np.bincount(word + 1, (v & np.uint64(0xFFFFFFFF)).astype("f8"), n_words + 1)[:n_words]
        data = np.frombuffer(w.astype("u8").astype(">u4").tobytes(), "u1")[: start[-1]]
        return self.frame(data, n_bytes)

    def frame(self, data: np.ndarray, n_bytes: np.ndarray) -> list[bytes]:
        """A zero after each 255, restart markers between segments, cut by (image, component)."""
        start = np.concatenate(([0], np.cumsum(n_bytes)))
        full = data == 255
        later = self.inner > 0
        marks = np.cumsum(later)
        to = np.arange(len(data)) + np.cumsum(full) - full + 2 * np.repeat(marks, n_bytes)
        out = np.zeros(len(data) + int(full.sum()) + 2 * int(later.sum()), "u1")
        out[to] = data
        head = to[start[:-1]]
        out[head[later] - 2] = 255
        out[head[later] - 1] = 0xD0 + (self.inner[later] - 1) % 8
        ends = np.append(head[self.first[:-1]], len(out))
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def in_order(self, code: np.ndarray, size: np.ndarray) -> list[bytes]:
        """write() of a matrix of codes, one row a block; size 0 is no code."""
        flat = size.ravel()
        some = np.flatnonzero(flat)
        size_ = flat[some].astype("i8")
        ends = np.cumsum(size_)
        seg = np.repeat(self.of, np.count_nonzero(size, axis=1))
        bits = np.bincount(seg, size_, self.n).astype("i8")
        return self.write(code.ravel()[some], size_, ends - size_ - (np.cumsum(bits) - bits)[seg], seg, bits)

    def write_bits(self, bit: np.ndarray, pos: np.ndarray, seg: np.ndarray, bits: np.ndarray) -> list[bytes]:
        """write() of single bits."""
        n_bytes = (bits + 7) // 8
        start = np.cumsum(n_bytes) - n_bytes
        out = np.ones(int(n_bytes.sum()) * 8, "u1")
        out[(start * 8)[seg] + pos] = bit
        return self.frame(np.packbits(out), n_bytes)


@lru_cache
def first_table() -> tuple[np.ndarray, np.ndarray]:
    """Code and length for (zeros before & 15) * 129 + value + 64; value 0 has length 0."""
    v = np.arange(-64, 65)
    s = bit_sizes(np.abs(v))
    extra = np.where(v < 0, v + (1 << s) - 1, v)
    symbol = np.arange(16)[:, None] << 4 | s
    _, code, size = FIRST
    return (code[symbol] << s.astype("u8") | extra.astype("u8")).astype("u4").ravel(), np.where(v == 0, 0, size[symbol] + s).astype("u1").ravel()


def encode_first(c: np.ndarray, segs: Segments, lo: int, hi: int) -> list[bytes]:
    v = c[:, lo : hi + 1].astype("i2")
    v = ((v + (v < 0)) >> 1).astype("i1")  # halved towards zero
    n, w = v.shape
    at = np.arange(w, dtype="i1")
    full = np.maximum.accumulate(np.where(v != 0, at, np.int8(-1)), 1)
    run = np.empty((n, w), "i1")
    run[:, 0] = 0
    run[:, 1:] = at[1:] - full[:, :-1] - np.int8(1)
    code, size = np.full((n, w + 1), FIRST[1][0], "u4"), np.empty((n, w + 1), "u1")
    key = (run & np.int8(15)).astype("i2") * np.int16(129) + v + np.int16(64)
    codes, sizes = first_table()
    np.take(codes, key, out=code[:, :w], mode="clip")
    np.take(sizes, key, out=size[:, :w], mode="clip")
    last = full[:, -1:]
    if (run >= 15).any():
        skip = (v == 0) & ((run + 1) % 16 == 0) & (at < last)
        code[:, :w][skip], size[:, :w][skip] = FIRST[1][0xF0], FIRST[2][0xF0]
    size[:, w] = np.where(last[:, 0] < w - 1, FIRST[2][0], 0)
    return segs.in_order(code, size)


def encode_refine(c: np.ndarray, segs: Segments, lo: int, hi: int) -> list[bytes]:
    a = np.abs(c[:, lo : hi + 1])
    n, w = a.shape
    have = a > 1
    hard = (a == 1).any(1)  # blocks with coefficients that are new in this scan; in others the end code comes first
    per = 1 + have.sum(1)
    if hard.any():
        codes, sizes, places, owner, per[hard] = refine_new(c[hard, lo : hi + 1].astype("i8"))
    bits = np.bincount(segs.of, per, segs.n).astype("i8")
    block = np.cumsum(per) - per - (np.cumsum(bits) - bits)[segs.of]
    easy = np.flatnonzero(~hard)
    one = have if len(easy) == n else have[easy]
    many = one.sum(1)
    owner_ = np.repeat(easy, many)
    rank = np.arange(len(owner_)) - np.repeat(np.cumsum(many) - many, many)
    bit = [np.zeros(len(easy), "u1"), (a if len(easy) == n else a[easy])[one].astype("u1") & 1]
    pos, seg = [block[easy], block[owner_] + 1 + rank], [segs.of[easy], segs.of[owner_]]
    if hard.any():
        owner = np.flatnonzero(hard)[owner]
        each = np.repeat(np.arange(len(codes)), sizes)
        down = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bit.append((codes[each] >> (sizes[each] - 1 - down).astype("u8") & np.uint64(1)).astype("u1"))
        pos.append(block[owner][each] + places[each] + down)
        seg.append(segs.of[owner][each])
    return segs.write_bits(np.concatenate(bit), np.concatenate(pos), np.concatenate(seg), bits)


def refine_new(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths, places in their block and blocks of the codes of blocks with new coefficients; bits a block."""
    a = np.abs(v)
    n, w = v.shape
    at = np.arange(w)
    have, new, zero = a > 1, a == 1, a == 0
    zeros = np.cumsum(zero, 1)
    base = np.maximum.accumulate(np.where(new, zeros, 0), 1)
    base = np.concatenate((np.zeros((n, 1), "i8"), base[:, :-1]), 1)
    run = zeros - base
    last = np.max(np.where(new, at, -1), 1, keepdims=True)
    skip = zero & (run % 16 == 0) & (at < last)
    _, code_of, size_of = REFINE
    symbol = (run & 15) << 4 | 1
    code = np.where(new, code_of[symbol] << np.uint64(1) | (v > 0).astype("u8"), np.where(skip, code_of[0xF0], np.uint64(0)))
    size = np.where(new, size_of[symbol] + 1, np.where(skip, size_of[0xF0], 0))
    code = np.concatenate((code, np.full((n, 1), code_of[0])), 1)
    size = np.concatenate((size, np.where(last < w - 1, size_of[0], 0)), 1)
    event = size > 0
    codes_before = np.concatenate((np.zeros((n, 1), "i8"), np.cumsum(size, 1)), 1)
    bits_before = np.concatenate((np.zeros((n, 1), "i8"), np.cumsum(have, 1)), 1)
    col = np.arange(w + 1)
    after = np.minimum.accumulate(np.where(event, col, w)[:, ::-1], 1)[:, ::-1][:, :w]  # the code whose bits these are
    before = np.maximum.accumulate(np.where(event, col, -1), 1)
    before = np.concatenate((np.full((n, 1), -1), before[:, :-1]), 1)
    er, ec = np.nonzero(event)
    hr, hc = np.nonzero(have)
    pe = codes_before[er, ec] + bits_before[er, np.maximum(before[er, ec], 0)]
    ph = codes_before[hr, after[hr, hc] + 1] + bits_before[hr, hc]
    return (
        np.concatenate((code[er, ec], (a[hr, hc] & 1).astype("u8"))), np.concatenate((size[er, ec], np.ones(len(hr), "i8"))), np.concatenate((pe, ph)), np.concatenate((er, hr)), codes_before[:, -1] + bits_before[:, -1]
    )


def encode_dc(c: np.ndarray, segs: Segments) -> tuple[list[bytes], list[bytes]]:
    v = c[:, 0].astype("i8") >> 1
    d = v - np.where(segs.starts, 0, np.concatenate(([0], v[:-1])))
    s = bit_sizes(np.abs(d))
    code = DC[1][s] << s.astype("u8") | np.where(d < 0, d + (1 << s) - 1, d).astype("u8")
    bits = np.bincount(segs.of, minlength=segs.n)
    inner = np.arange(len(c)) - (np.cumsum(bits) - bits)[segs.of]
    return segs.in_order(code[:, None], (DC[2][s] + s)[:, None]), segs.write_bits((c[:, 0] & 1).astype("u1"), inner, segs.of, bits)


def marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, code, len(body) + 2) + body


def encode(images: list[np.ndarray], notes: list[bytes]) -> list[bytes]:
    """A file for each array of blocks (n, 64) in zigzag order, -128 to 127; blocks fill Y, then Cb, then Cr, zeros the
    rest. notes: comments to carry."""
    sizes = [blocks_of(len(x)) for x in images]
    counts = [k for w, h in sizes for k in (4 * w * h, w * h, w * h)]
    segs = Segments(counts)
    c = np.zeros((sum(counts), 64), "i2")
    at = 0
    for x, (w, h) in zip(images, sizes):
        c[at : at + len(x)] = x
        at += 6 * w * h
    dc, dc_low = encode_dc(c, segs)
    bands = [encode_first(c, segs, lo, hi) for lo, hi in BANDS]
    low = encode_refine(c, segs, 1, 63)
    tables = marker(0xDB, b"\0" + b"\1" * 64), marker(0xC4, b"\x00" + DC[0]) + marker(0xC4, b"\x10" + FIRST[0]) + marker(0xC4, b"\x11" + REFINE[0]) + marker(0xDD, struct.pack(">H", RESTART))
    out = []
    for i, ((w, h), note) in enumerate(zip(sizes, notes)):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"".join(bytes((k, s << 4 | s, 0)) for k, s in COMPONENTS)
        parts = [b"\xff\xd8", marker(0xFE, note), tables[0], marker(0xC2, frame), tables[1]]
        for data, table, span, bits in ((dc, 0, (0, 0), 0x01), (dc_low, 0, (0, 0), 0x10), (bands[0], 0, BANDS[0], 0x01), (bands[1], 0, BANDS[1], 0x01), (low, 1, (1, 63), 0x10)):
            for k in range(3):
                parts += [marker(0xDA, bytes((1, COMPONENTS[k][0], table, *span, bits))), data[3 * i + k]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


@lru_cache(64)
def lookup(body: bytes) -> tuple[np.ndarray, ...]:
    """For each 16 next bits: the code's length and symbol (length 0: no code); with the value bits of an AC symbol
    within the 16 also the whole length, or else 0, and the value."""
    counts, symbols = np.frombuffer(body[:16], "u1"), np.frombuffer(body[16:], "u1").astype("i8")
    lengths = np.repeat(np.arange(1, 17), counts)
    size, symbol, now, last = np.zeros(1 << 16, "i4"), np.zeros(1 << 16, "i4"), 0, 0
    for n, s in zip(lengths.tolist(), symbols.tolist()):
        now <<= n - last
        last = n
        size[now << (16 - n) : (now + 1) << (16 - n)] = n
        symbol[now << (16 - n) : (now + 1) << (16 - n)] = s
        now += 1
    s = symbol & 15
    whole = np.where((size > 0) & (s > 0) & (size + s <= 16), size + s, 0).astype("i4")
    raw = np.arange(1 << 16) >> (16 - size - s).clip(0, 16) & ((1 << s) - 1)
    value = np.where(whole > 0, np.where(raw < (1 << s >> 1), raw - (1 << s) + 1, raw), 0).astype("i4")
    return size, symbol, whole, value


@dataclass
class Scan:
    """Scans of one kind over a batch: cleaned bytes, and for each restart segment its first bit, block and end."""

    parts: list[bytes] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    restart: list[int] = field(default_factory=list)

    def ready(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(self.parts) + bytes(8), "u1")
        after = np.concatenate((raw[1:], [0]))
        full = raw == 255
        mark = full & (after >= 0xD0) & (after <= 0xD7)
        drop = mark.copy()
        drop[1:] |= full[:-1]  # the second byte of a pair: a stuffed zero or a marker's code
        new = np.zeros(len(raw), bool)
        new[np.flatnonzero(mark) + 2] = True
        new[np.cumsum([0, *map(len, self.parts)])[:-1]] = True
        to = np.cumsum(~drop) - ~drop
        data = raw[~drop].astype("u4")
        first = to[np.flatnonzero(new)] * 8
        three = (np.concatenate((data, [0, 0])).astype("u4"))
        window = (three[:-2] << 16 | three[1:-1] << 8 | three[2:]).astype("i8")
        base, count, restart = (np.array(x, "i8") for x in (self.base, self.count, self.restart))
        per = -(-count // restart)
        if per.sum() != len(first):
            raise ValueError("restart markers do not agree with the interval")
        inner = np.arange(len(first)) - np.repeat(np.cumsum(per) - per, per)
        block = np.repeat(base, per) + inner * np.repeat(restart, per)
        end = np.minimum(block + np.repeat(restart, per), np.repeat(base + count, per))
        return window, first, block, end


def peek(window: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return window[pos >> 3] >> (8 - (pos & 7)) & 0xFFFF


def bit(window: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return window[pos >> 3] >> (23 - (pos & 7)) & 1


def take(window: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The next n bits, 0 to 16."""
    return peek(window, pos) >> (16 - n)


def signed(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(x < (1 << s >> 1), x - (1 << s) + 1, x)


def decode_dc(d: np.ndarray, scan: Scan, table: bytes, low: int) -> None:
    window, pos, block, end = scan.ready()
    size, symbol, _, _ = lookup(table)
    value = np.zeros(len(pos), "i8")
    while len(pos):
        w = peek(window, pos)
        n, s = size[w], symbol[w]
        if not n.all():
            raise ValueError("no such code")
        pos = pos + n
        value = value + signed(take(window, pos, s), s)
        d[block, 0] = value << low
        pos, block = pos + s, block + 1
        on = block < end
        if not on.all():
            pos, block, end, value = pos[on], block[on], end[on], value[on]


def decode_dc_low(d: np.ndarray, scan: Scan, low: int) -> None:
    window, pos, block, end = scan.ready()
    while len(pos):
        d[block, 0] |= (bit(window, pos) << low).astype(d.dtype)
        pos, block = pos + 1, block + 1
        on = block < end
        if not on.all():
            pos, block, end = pos[on], block[on], end[on]


def decode_first(d: np.ndarray, scan: Scan, table: bytes, lo: int, hi: int, low: int) -> None:
    window, pos, block, end = scan.ready()
    size, symbol, whole, value = lookup(table)
    k = np.full(len(pos), lo)
    flat = d.reshape(-1)
    while len(pos):
        w = peek(window, pos)
        n, s, v = whole[w], symbol[w], value[w]
        k = k + (s >> 4)
        rare = np.flatnonzero(n == 0)
        if len(rare):
            # ends of bands, runs of 16 zeros, and values beyond the 16 bits
            n, v = n.copy(), v.copy()
            a, r, z = size[w[rare]], s[rare] >> 4, s[rare] & 15
            if not a.all():
                raise ValueError("no such code")
            extra = np.where(z > 0, z, np.where(r < 15, r, 0))
            x = take(window, pos[rare] + a, extra)
            n[rare] = a + extra
            v[rare] = np.where(z > 0, signed(x, z), 0)
            over = (z == 0) & (r < 15)
            skip = rare[over]
            block = block.copy()
            block[skip] += (1 << r[over]) + x[over] - 1
            k[skip] = hi
        some = np.flatnonzero(v)
        if len(some) and k[some].max() > hi:
            raise ValueError("a coefficient beyond its band")
        flat[block[some] * 64 + k[some]] = v[some] << low
        pos = pos + n
        k = k + 1
        over = k > hi
        block = block + over
        k = np.where(over, lo, k)
        on = block < end
        if not on.all():
            pos, block, end, k = pos[on], block[on], end[on], k[on]


def decode_refine(d: np.ndarray, scan: Scan, table: bytes, lo: int, hi: int, low: int) -> None:
    window, pos, block, end = scan.ready()
    size, symbol, _, _ = lookup(table)
    w, step = hi - lo + 1, 1 << low
    at = np.arange(w)
    k, idle = np.zeros(len(pos), "i8"), np.zeros(len(pos), "i8")  # idle: blocks that a run of ends still covers
    while len(pos):
        code = peek(window, pos)
        n, s = size[code], symbol[code]
        coded = idle == 0
        if not n[coded].all():
            raise ValueError("no such code")
        r, new = s >> 4, coded & ((s & 15) == 1)
        closing = coded & ((s & 15) == 0) & (r < 15)
        pos = pos + np.where(coded, n, 0)
        if closing.any():
            extra = np.where(closing, r, 0)
            idle = np.where(closing, (1 << extra) + take(window, pos, extra), idle)
            pos = pos + extra
        sign = np.where(new, np.where(bit(window, pos) > 0, step, -step), 0)
        pos = pos + new
        have = d[block, lo : hi + 1]
        there = have != 0
        rest = at >= k[:, None]
        target = np.full(len(pos), w)
        walk = np.flatnonzero(idle == 0)
        if len(walk):
            free = ~there[walk] & rest[walk]
            hit = (np.cumsum(free, 1) == (r[walk] + 1)[:, None]) & free
            if not hit.any(1).all():
                raise ValueError("a coefficient beyond its band")
            target[walk] = hit.argmax(1)
        fix = there & rest & (at < target[:, None])
        rows, cols = np.nonzero(fix)
        many = fix.sum(1)
        rank = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        one = bit(window, pos[rows] + rank) > 0
        rows, cols = rows[one], cols[one]
        d[block[rows], lo + cols] += np.where(have[rows, cols] > 0, step, -step).astype(d.dtype)
        set_ = np.flatnonzero(sign)
        d[block[set_], lo + target[set_]] = sign[set_]
        pos = pos + many
        k = target + 1
        over = k >= w
        idle = np.where(idle > 0, idle - 1, 0)
        block = block + over
        k = np.where(over, 0, k)
        on = block < end
        if not on.all():
            pos, block, end, k, idle = pos[on], block[on], end[on], k[on], idle[on]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    note: bytes = b""
    base: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, sampling, blocks wide and high
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    table_of: list[int] = field(default_factory=list)


def decode(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images' frames and the coefficients of all blocks, component after component, image after image."""
    images, scans, total = [], {}, 0
    for raw in files:
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        im, tables, restart, i = Image(base=total), {}, 0, 2
        firsts: dict[int, tuple[int, int]] = {}
        while True:
            code = raw[i + 1]
            if code == 0xD9:
                break
            n = raw[i + 2] << 8 | raw[i + 3]
            body = raw[i + 4 : i + 2 + n]
            i += 2 + n
            if code == 0xFE:
                im.note = body
            elif code == 0xDB:
                im.quant[body[0] & 15] = np.frombuffer(body[1:65], "u1").astype("f8")
            elif code == 0xC4:
                tables[body[0]] = body[1:]
            elif code == 0xDD:
                restart = body[0] << 8 | body[1]
            elif code == 0xC2:
                _, im.height, im.width, k = struct.unpack(">BHHB", body[:6])
                most = max(body[7 + 3 * j] >> 4 for j in range(k))
                for j in range(k):
                    cid, s, q = body[6 + 3 * j : 9 + 3 * j]
                    wide, high = (-(-(-(-x * (s & 15) // most)) // 8) for x in (im.width, im.height))
                    firsts[cid] = (total, wide * high)
                    im.parts.append((cid, s & 15, wide, high))
                    im.table_of.append(q)
                    total += wide * high
            elif code == 0xDA:
                if body[0] != 1:
                    raise ValueError("a scan of several components")
                cid, t, lo, hi, bits = body[1:6]
                stop = MARK.search(raw, i)
                if not stop:
                    raise ValueError("the file ends within a scan")
                high, low = bits >> 4, bits & 15
                kind = 0 if lo == 0 else 1
                body_ = tables[t >> 4] if kind == 0 else tables[0x10 | t & 15]
                scan = scans.setdefault((high > 0, kind, lo, hi, low, b"" if high and not kind else body_), Scan())
                base, count = firsts[cid]
                scan.parts.append(raw[i : stop.start()])
                scan.base.append(base), scan.count.append(count), scan.restart.append(restart or count)
                i = stop.start()
            elif 0xC0 <= code <= 0xCF:
                raise ValueError("not a progressive Huffman file")
        images.append(im)
    d = np.zeros((total, 64), "i4")
    for (again, kind, lo, hi, low, table), scan in sorted(scans.items(), key=lambda x: x[0][:1] + (-x[0][4],)):
        if kind == 0:
            decode_dc_low(d, scan, low) if again else decode_dc(d, scan, table, low)
        elif again:
            decode_refine(d, scan, table, lo, hi, low)
        else:
            decode_first(d, scan, table, lo, hi, low)
    return images, d


def tensors(images: list[Image], d: np.ndarray) -> list[np.ndarray]:
    """(height, width, 3) samples of each image: inverse transform, chroma repeated to full size, RGB.

    The product is in double precision and rounded with a margin, so that a value does not depend on its batch.
    """
    out = []
    q = {tuple(x) for im in images for x in im.quant.values()}
    if len(q) == 1:
        planes = np.floor((d * np.array(next(iter(q)))) @ cosines() + 128.5 + 1e-6).clip(0, 255).astype("i4")
    else:
        planes = np.zeros(d.shape, "i4")
        for im in images:
            at = im.base
            for (_, _, wide, high), t in zip(im.parts, im.table_of):
                planes[at : at + wide * high] = np.floor((d[at : at + wide * high] * im.quant[t]) @ cosines() + 128.5 + 1e-6).clip(0, 255)
                at += wide * high
    for im in images:
        at, full = im.base, []
        most = max(s for _, s, _, _ in im.parts)
        for _, s, wide, high in im.parts:
            x = planes[at : at + wide * high].reshape(high, wide, 8, 8).swapaxes(1, 2).reshape(8 * high, 8 * wide)
            at += wide * high
            if most > s:
                x = x.repeat(most // s, 0).repeat(most // s, 1)
            full.append(x[: im.height, : im.width])
        if len(full) == 1:
            out.append(np.repeat(full[0][..., None], 3, 2).astype("u1"))
            continue
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        rgb = np.stack((y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)), -1)
        out.append(rgb.clip(0, 255).astype("u1"))
    return out
