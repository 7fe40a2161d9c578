"""Progressive JPEG in numpy, over many images at a time.

Reading: scans are grouped by what they code (spectral band, bit position, tables). All restart intervals
of a group, over all images of a batch, are decoded side by side, one symbol a step, into one coefficient
array; later scans refine what earlier ones left there. Coefficients are then dequantised, transformed
back, chroma is upsampled by replication, and each image is returned as a full-resolution RGB tensor.

Writing: bytes are kept losslessly as quantised coefficients, 64 bytes to a block. Byte b becomes the
coefficient b if b >= 128, else b - 255, which are exactly the values of eight-bit magnitude.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Fixed values of the format: the zigzag order of an 8x8 block, and markers.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE

#: Restart interval of the files written here, in MCUs; the reader takes any, or none.
RESTART = 8
#: Scans written: (spectral start, end, high bit, low bit), luma and chroma apart but for the first two.
LOW_BAND, HIGH_BAND = (1, 20), (21, 63)


class Corrupt(ValueError):
    """The stream breaks the format or uses a part of it that is not supported."""


# ---- Huffman tables


def huffman_lookup(lengths: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bits, symbol) of the code that each 16-bit window starts with; 0 bits where there is none."""
    bits, found = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    code = at = 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            window = slice(code << (16 - n), (code + 1) << (16 - n))
            bits[window], found[window] = n, symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return bits, found


def huffman_codes(lengths: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) of each symbol."""
    codes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code = at = 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            codes[symbols[at]], bits[symbols[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return codes, bits


DC_SPEC = (bytes([0, 0, 0, 12, *[0] * 12]), bytes(range(12)))
#: Two bits for magnitudes of seven and eight bits without a zero run and for the end of a block, ten for the rest.
_RARE = [r << 4 | s for r in range(16) for s in range(11) if (r, s) not in ((0, 7), (0, 8), (0, 0))]
AC_SPEC = (bytes([0, 3, 0, 0, 0, 0, 0, 0, 0, len(_RARE), *[0] * 6]), bytes([0x07, 0x08, 0x00, *_RARE]))


# ---- Reading: files


@dataclass
class Component:
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row as stored, whole MCUs
    high: int = 0
    scan_wide: int = 0  # blocks in a row of a scan of its own
    scan_high: int = 0
    first: int = 0  # of its blocks in the batch's coefficient array


@dataclass
class Scan:
    components: list[int]
    dc: list[tuple | None]
    ac: tuple | None
    band: tuple[int, int]
    high_bit: int
    low_bit: int
    restart: int
    starts: list[int]
    stops: list[int]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)


def parse(data: bytes) -> Image:
    """Headers and the extents of the entropy-coded segments."""
    if data[:2] != bytes([0xFF, SOI]):
        raise Corrupt("no start of image")
    image, at, restart = Image(), 2, 0
    tables: dict[tuple[int, int], tuple] = {}
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & (raw[1:] != 0xFF))
    kinds = raw[marks + 1]
    others = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))  # all but restarts
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise Corrupt("no marker where one must be")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == EOI:
            return image
        size = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == DQT:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                image.quant[body[0] & 15] = values.astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == SOF2:
            if body[0] != 8:
                raise Corrupt("only 8-bit samples are read")
            image.height, image.width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            for i in range(body[5]):
                c = body[6 + 3 * i : 9 + 3 * i]
                image.components[c[0]] = Component(c[1] >> 4, c[1] & 15, c[2])
            _measure(image)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and kind != 0xC8:
            raise Corrupt("only progressive Huffman images are read")
        elif kind == DRI:
            restart = int.from_bytes(body[:2])
        elif kind == COM:
            image.comments.append(body)
        elif kind == SOS:
            n = body[0]
            ids = [body[1 + 2 * i] for i in range(n)]
            slots = [body[2 + 2 * i] for i in range(n)]
            start, end, bit = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            i = int(np.searchsorted(marks, at))
            j = int(np.searchsorted(others, i))
            if j == len(others):
                raise Corrupt("the scan does not end")
            stops = marks[i : others[j] + 1].tolist()
            starts = [at, *(x + 2 for x in stops[:-1])]
            at = stops[-1]
            dc = [tables.get((0, s >> 4)) for s in slots] if start == 0 and bit >> 4 == 0 else [None] * n
            image.scans.append(Scan(ids, dc, tables.get((1, slots[0] & 15)) if start else None, (start, end), bit >> 4, bit & 15, restart, starts, stops))


def _measure(image: Image) -> None:
    most_h, most_v = (max(getattr(c, x) for c in image.components.values()) for x in "hv")
    mcus_wide, mcus_high = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
    for c in image.components.values():
        c.wide, c.high = mcus_wide * c.h, mcus_high * c.v
        c.scan_wide = -(-(-(-image.width * c.h // most_h)) // 8)
        c.scan_high = -(-(-(-image.height * c.v // most_v)) // 8)


def _scan_blocks(image: Image, ids: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(stored block, component's position in the scan) of each coded block in order, and blocks to an MCU."""
    cs = [image.components[i] for i in ids]
    base = cs[0].first
    stored, which, per_mcu = _layout(tuple((c.h, c.v, c.wide, c.high, c.scan_wide, c.scan_high, c.first - base) for c in cs))
    return stored + base, which, per_mcu


@lru_cache(4096)
def _layout(cs: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray, int]:
    if len(cs) == 1:
        _, _, wide, _, scan_wide, scan_high, _ = cs[0]
        rows, columns = np.divmod(np.arange(scan_wide * scan_high), scan_wide)
        return rows * wide + columns, np.zeros(len(rows), np.int64), 1
    my, mx = np.divmod(np.arange((cs[0][2] // cs[0][0]) * (cs[0][3] // cs[0][1])), cs[0][2] // cs[0][0])
    stored, which = [], []
    for i, (h, v, wide, _, _, _, first) in enumerate(cs):
        for y in range(v):
            for x in range(h):
                stored.append(first + (my * v + y) * wide + mx * h + x)
                which.append(i)
    return np.stack(stored, 1).ravel(), np.tile(which, len(my)), len(which)


# ---- Reading: entropy-coded data


class Lanes:
    """Restart intervals that are decoded side by side: bit positions in one buffer without stuffing."""

    def __init__(self, pieces: list[np.ndarray], blocks: list[np.ndarray], which: list[np.ndarray]):
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.concatenate(pieces)
        # a piece never ends in a bare 255, so pairs do not reach over into the next one
        stuffed = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1
        ends = np.cumsum(sizes)
        ends -= np.searchsorted(stuffed, ends)
        starts = np.append(0, ends[:-1])
        flat = np.concatenate([np.delete(raw, stuffed), np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
        self.words = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:]
        self.words = np.append(self.words, np.full(4, 0xFFFFFFFF, np.uint32)).astype(np.int64)
        self.pos, self.stop = starts * 8, ends * 8
        self.counts = np.fromiter(map(len, blocks), np.int64, len(blocks))
        self.first = np.cumsum(self.counts) - self.counts
        self.blocks, self.which = np.concatenate(blocks), np.concatenate(which)

    def take(self, lanes: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The next ``n`` bits (up to 16) of each lane."""
        at = self.pos[lanes]
        out = (self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (32 - (at & 7) - n)) & ((1 << n) - 1 if isinstance(n, int) else (np.int64(1) << n) - 1)
        self.pos[lanes] = at + n
        return out

    def symbol(self, lanes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at = self.pos[lanes]
        window = (self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (16 - (at & 7))) & 0xFFFF
        bits = table[0][window]
        if not bits.all():
            raise Corrupt("a code that is not in the table")
        self.pos[lanes] = at + bits
        return table[1][window]

    def check(self) -> None:
        if (self.pos > self.stop).any():
            raise Corrupt("a scan is too short")


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value that ``size`` magnitude bits stand for."""
    return np.where((size > 0) & (bits < (np.int64(1) << np.maximum(size - 1, 0))), bits - (np.int64(1) << size) + 1, bits)


def _dc_first(lanes: Lanes, tables: list, low_bit: int, out: np.ndarray) -> None:
    last = np.zeros((len(lanes.counts), len(tables)), np.int64)
    for step in range(int(lanes.counts.max(initial=0))):
        alive = np.flatnonzero(lanes.counts > step)
        unit = lanes.first[alive] + step
        which = lanes.which[unit]
        for i, table in enumerate(tables):
            own = which == i
            if own.any():
                l = alive[own]
                size = lanes.symbol(l, table)
                last[l, i] += _extend(lanes.take(l, size), size)
                out[lanes.blocks[unit[own]], 0] = last[l, i] << low_bit


def _dc_refine(lanes: Lanes, low_bit: int, out: np.ndarray) -> None:
    for step in range(int(lanes.counts.max(initial=0))):
        alive = np.flatnonzero(lanes.counts > step)
        out[lanes.blocks[lanes.first[alive] + step], 0] |= lanes.take(alive, 1) << low_bit


def _ac_first(lanes: Lanes, table: tuple, band: tuple[int, int], low_bit: int, out: np.ndarray) -> None:
    start, end = band
    flat = out.reshape(-1)
    block = np.zeros(len(lanes.counts), np.int64)
    k = np.full(len(block), start)
    alive = np.flatnonzero(lanes.counts > 0)
    while alive.size:
        symbol = lanes.symbol(alive, table)
        size, run = symbol & 15, symbol >> 4
        value = size > 0
        if value.all():
            at = k[alive] + run
            coded, lane = at, alive
        else:
            zeros = ~value & (run == 15)
            k[alive[zeros]] += 16
            over = ~value & (run < 15)
            l = alive[over]
            block[l] += (np.int64(1) << run[over]) + lanes.take(l, run[over])
            k[l] = start
            lane, size = alive[value], size[value]
            coded = k[lane] + run[value]
        if lane.size:
            if coded.max() > end:
                raise Corrupt("a coefficient beyond its band")
            bits = _extend(lanes.take(lane, size), size)
            flat[lanes.blocks[lanes.first[lane] + block[lane]] * 64 + coded] = np.where(bits < 0, -(-bits << low_bit), bits << low_bit)
            k[lane] = coded + 1
        full = alive[k[alive] > end]
        if full.size:
            block[full] += 1
            k[full] = start
        if full.size or not value.all():
            alive = alive[block[alive] < lanes.counts[alive]]


def _ac_refine(lanes: Lanes, table: tuple, band: tuple[int, int], low_bit: int, out: np.ndarray) -> None:
    start, end = band
    flat, bit = out.reshape(-1), np.int64(1) << low_bit
    n = len(lanes.counts)
    ended = np.zeros(n, np.int64)  # blocks still to go, this one included, without new coefficients
    for step in range(int(lanes.counts.max(initial=0))):
        alive = np.flatnonzero(lanes.counts > step)
        base = np.zeros(n, np.int64)
        base[alive] = lanes.blocks[lanes.first[alive] + step] * 64
        run, fresh = np.full(n, -1), np.zeros(n, np.int64)  # zeros still to pass, then the new value; -1: a symbol is due
        for k in range(start, end + 1):
            due = alive[(ended[alive] == 0) & (run[alive] < 0)]
            if due.size:
                symbol = lanes.symbol(due, table)
                size, zeros = symbol & 15, symbol >> 4
                over = (size == 0) & (zeros < 15)
                l = due[over]
                ended[l] = (np.int64(1) << zeros[over]) + lanes.take(l, zeros[over])
                l = due[~over]
                run[l] = zeros[~over]
                fresh[l] = 0
                new = l[size[~over] > 0]
                fresh[new] = np.where(lanes.take(new, 1) == 1, bit, -bit)
            at = base[alive] + k
            old = flat[at]
            had = old != 0
            l = alive[had]
            if l.size:
                more = (lanes.take(l, 1) == 1) & ((np.abs(old[had]) & bit) == 0)
                flat[at[had]] = np.where(more, old[had] + np.sign(old[had]) * bit, old[had])
            l = alive[~had]
            l = l[ended[l] == 0]
            if l.size:
                hit = l[run[l] == 0]
                flat[base[hit] + k] = fresh[hit]
                run[l] -= 1
        ended[alive] = np.maximum(ended[alive] - 1, 0)


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images and their coefficients in zigzag order, a row per stored block."""
    images, raws = [parse(f) for f in files], [np.frombuffer(f, np.uint8) for f in files]
    n = 0
    for image in images:
        for c in image.components.values():
            c.first, n = n, n + c.wide * c.high
    out = np.zeros((n, 64), np.int64)
    lookups: dict[tuple, tuple] = {}

    def lookup(spec: tuple | None) -> tuple:
        if spec is None:
            raise Corrupt("a scan without its table")
        if spec not in lookups:
            lookups[spec] = huffman_lookup(*spec)
        return lookups[spec]

    # A scan waits only for earlier scans of the same components and coefficients.
    groups: dict[tuple, list[tuple[int, Scan]]] = {}
    for i, image in enumerate(images):
        turns: dict[int, np.ndarray] = {c: np.zeros(64, np.int64) for c in image.components}
        for s in image.scans:
            band = slice(s.band[0], s.band[1] + 1)
            turn = max(int(turns[c][band].max()) for c in s.components)
            for c in s.components:
                turns[c][band] = turn + 1
            groups.setdefault((turn, s.band, s.high_bit, s.low_bit, tuple(s.dc), s.ac), []).append((i, s))
    for key in sorted(groups, key=lambda k: k[:4]):
        _, band, high_bit, low_bit, dc, ac = key
        pieces, blocks, which = [], [], []
        for i, scan in groups[key]:
            stored, component, per_mcu = _scan_blocks(images[i], scan.components)
            step = scan.restart * per_mcu or max(1, len(stored))
            if -(-len(stored) // step) != len(scan.starts):
                raise Corrupt("restart intervals are missing")
            pieces += [raws[i][a:b] for a, b in zip(scan.starts, scan.stops)]
            blocks += [stored[a : a + step] for a in range(0, len(stored), step)]
            which += [component[a : a + step] for a in range(0, len(stored), step)]
        lanes = Lanes(pieces, blocks, which)
        if band[0] == 0 and high_bit == 0:
            _dc_first(lanes, [lookup(t) for t in dc], low_bit, out)
        elif band[0] == 0:
            _dc_refine(lanes, low_bit, out)
        elif high_bit == 0:
            _ac_first(lanes, lookup(ac), band, low_bit, out)
        else:
            _ac_refine(lanes, lookup(ac), band, low_bit, out)
        lanes.check()
    return images, out


# ---- Reading: samples


def _basis() -> np.ndarray:
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.cos((2 * x + 1) * u * math.pi / 16) * np.where(u == 0, math.sqrt(0.125), 0.5)
    return np.kron(a, a)[:, ZIGZAG].T  # zigzag coefficient by sample


BASIS = _basis()


def rgb_tensors(images: list[Image], coded: np.ndarray) -> list[np.ndarray]:
    """Full-resolution uint8 tensors (height, width, 3)."""
    planes: list[list[np.ndarray]] = [[] for _ in images]
    scale = np.concatenate([np.tile(i.quant[c.table], (c.wide * c.high, 1)) for i in images for c in i.components.values()]) if images else np.zeros((0, 64))
    samples = np.empty(coded.shape, np.uint8)
    for a in range(0, len(coded), 8192):
        # the offset keeps exact halves from hanging on the order of a sum
        samples[a : a + 8192] = np.clip(np.floor((coded[a : a + 8192] * scale[a : a + 8192]).astype(np.float64) @ BASIS + 128.5 + 1e-6), 0, 255)
    for i, image in enumerate(images):
        most_h, most_v = (max(getattr(c, x) for c in image.components.values()) for x in "hv")
        for c in image.components.values():
            own = samples[c.first : c.first + c.wide * c.high].reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)
            full = own.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)
            planes[i].append(full[: image.height, : image.width])
    out = []
    for p in planes:
        if len(p) == 1:
            out.append(np.stack([p[0]] * 3, 2))
            continue
        # The colour matrix, in units of 1 / 65536.
        y, cb, cr = p[0].astype(np.int32) << 16, p[1].astype(np.int32) - 128, p[2].astype(np.int32) - 128
        r, g, b = y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb
        out.append(np.clip((np.stack([r, g, b], 2) + 32768) >> 16, 0, 255).astype(np.uint8))
    return out


# ---- Writing


def _bits(values: np.ndarray, sizes: np.ndarray, segment: np.ndarray, segments: int) -> list[bytes]:
    """The codes (up to 32 bits) of each segment in a row, filled up with ones and stuffed."""
    total = np.bincount(segment, weights=sizes, minlength=segments).astype(np.int64)
    padded = -(-total // 8) * 8
    first = np.cumsum(padded) - padded
    at = np.cumsum(sizes) - sizes + (first - (np.cumsum(total) - total))[segment]
    fill = padded - total
    at, values, sizes = np.append(at, first + total), np.append(values, (1 << fill) - 1), np.append(sizes, fill)
    word = at >> 5
    placed = values.astype(np.uint64) << (64 - (at & 31) - sizes).astype(np.uint64)
    n = int(padded.sum() // 32) + 2
    # codes never overlap, so sums are as good as ors, and doubles hold 32 bits exactly
    out = np.bincount(word, weights=placed >> np.uint64(32), minlength=n) + np.bincount(word + 1, weights=placed & np.uint64(0xFFFFFFFF), minlength=n)
    raw = out.astype(np.int64).astype(">u4").tobytes()
    edges = [*(first // 8).tolist(), int(padded.sum() // 8)]
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(edges[:-1], edges[1:])]


def _magnitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, magnitude bits) of each value."""
    size = np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)
    return size, np.where(values < 0, values + (np.int64(1) << size) - 1, values)


def _write_dc(blocks: np.ndarray, which: np.ndarray, segment: np.ndarray, segments: int) -> list[bytes]:
    codes, bits = huffman_codes(*DC_SPEC)
    value = blocks >> 1
    diff = np.zeros(len(value), np.int64)
    for c in range(int(which.max()) + 1):
        own = np.flatnonzero(which == c)
        last = np.concatenate([[0], value[own][:-1]])
        last[np.flatnonzero(np.diff(segment[own], prepend=-1))] = 0
        diff[own] = value[own] - last
    size, extra = _magnitude(diff)
    return _bits((codes[size] << size) | extra, bits[size] + size, segment, segments)


def _write_ac(blocks: np.ndarray, low_bit: int, segment: np.ndarray, segments: int) -> list[bytes]:
    """First scan of a band: runs of zeros, values, ends of blocks."""
    codes, bits = huffman_codes(*AC_SPEC)
    value = np.sign(blocks) * (np.abs(blocks) >> low_bit)
    row, k = np.nonzero(value)
    last = np.where(np.diff(row, prepend=-1) != 0, -1, np.roll(k, 1)) if len(row) else k
    run = k - last - 1
    size, extra = _magnitude(value[row, k])
    symbol = (run % 16) << 4 | size
    top = np.full(len(blocks), -1)
    top[row] = k
    ends = np.flatnonzero(top < blocks.shape[1] - 1)
    skips = run // 16  # codes for sixteen zeros that go before a value
    upto = np.cumsum(skips)
    at = np.arange(len(row)) + upto + np.searchsorted(ends, row)
    code, width, owner = (np.empty(len(row) + int(skips.sum()) + len(ends), np.int64) for _ in range(3))
    code[:], width[:] = codes[0xF0], bits[0xF0]
    code[at], width[at], owner[at] = (codes[symbol] << size) | extra, bits[symbol] + size, row
    if len(ends):
        values_upto = np.searchsorted(row, ends, side="right")
        last = values_upto + np.append(0, upto)[values_upto] + np.arange(len(ends))
        code[last], width[last], owner[last] = codes[0], bits[0], ends
    for i in np.flatnonzero(skips):
        owner[at[i] - skips[i] : at[i]] = row[i]
    return _bits(code, width, segment[owner], segments)


def _write_refinement(blocks: np.ndarray, segment: np.ndarray, segments: int) -> list[bytes]:
    """The lowest bit of a band whose values are all zero or known to be at least two: an end of block, then bits."""
    codes, bits = huffman_codes(*AC_SPEC)
    code, width = np.full(len(blocks), codes[0]), np.full(len(blocks), bits[0])
    for k in range(blocks.shape[1]):
        has = blocks[:, k] != 0
        code = np.where(has, code << 1 | (np.abs(blocks[:, k]) & 1), code)
        width = width + has
    return _bits(code, width, segment, segments)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2) + body


def shape_of(payload_blocks: int) -> tuple[int, int]:
    """MCUs across and down that hold so many blocks, six to an MCU."""
    mcus = -(-payload_blocks // 6)
    wide = math.isqrt(mcus - 1) + 1
    return wide, -(-mcus // wide)


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive 4:2:0 file for each payload, whose size is a positive multiple of 64.

    Payload bytes are the coefficients of luma, then Cb, then Cr blocks, in zigzag order; blocks left
    over are zero. The payload's size is in a comment.
    """
    shapes = [shape_of(len(p) // 64) for p in payloads]
    luma = np.array([4 * w * h for w, h in shapes])
    total = luma // 2 * 3
    first = np.cumsum(total) - total
    coded = np.zeros((int(total.sum()), 64), np.int64)
    for p, a in zip(payloads, first):
        b = np.frombuffer(p, np.uint8).astype(np.int64).reshape(-1, 64)
        coded[a : a + len(b)] = np.where(b >= 128, b, b - 255)
    images = [Image(16 * w, 16 * h, {1: Component(2, 2, 0), 2: Component(1, 1, 0), 3: Component(1, 1, 0)}) for w, h in shapes]
    for image, a in zip(images, first.tolist()):
        _measure(image)
        for c in image.components.values():
            c.first, a = a, a + c.wide * c.high
    pieces: list[list[bytes]] = [[] for _ in payloads]

    def add(ids: list[int], band: tuple[int, int], bit: int, write) -> None:
        layout = [_scan_blocks(i, ids) for i in images]
        counts = [-(-len(s) // (RESTART * m)) for s, _, m in layout]
        ends = np.cumsum(counts)
        segment = np.concatenate([e - n + np.arange(len(s)) // (RESTART * m) for (s, _, m), n, e in zip(layout, counts, ends)])
        stored, which = (np.concatenate([x[j] for x in layout]) for j in (0, 1))
        coded_segments = write(stored, which, segment, int(ends[-1]))
        header = _segment(SOS, bytes([len(ids), *(b for i in ids for b in (i, 0)), *band, bit]))
        for own, e, n in zip(pieces, ends.tolist(), counts):
            own.append(header)
            for j, s in enumerate(coded_segments[e - n : e]):
                own += [bytes([0xFF, 0xD0 + (j - 1) % 8]), s] if j else [s]

    everything = [1, 2, 3]
    add(everything, (0, 0), 0x01, lambda s, w, g, n: _write_dc(coded[s, 0], w, g, n))
    low, high = slice(LOW_BAND[0], LOW_BAND[1] + 1), slice(HIGH_BAND[0], HIGH_BAND[1] + 1)
    for c in everything:
        add([c], LOW_BAND, 0x01, lambda s, w, g, n: _write_ac(coded[s, low], 1, g, n))
    for c in everything:
        add([c], HIGH_BAND, 0x00, lambda s, w, g, n: _write_ac(coded[s, high], 0, g, n))
    add(everything, (0, 0), 0x10, lambda s, w, g, n: _bits(coded[s, 0] & 1, np.ones(len(s), np.int64), g, n))
    for c in everything:
        add([c], LOW_BAND, 0x10, lambda s, w, g, n: _write_refinement(coded[s, low], g, n))
    head = bytes([0xFF, SOI]) + _segment(DQT, bytes([0, *[1] * 64]))
    tables = _segment(DHT, bytes([0x00]) + DC_SPEC[0] + DC_SPEC[1] + bytes([0x10]) + AC_SPEC[0] + AC_SPEC[1]) + _segment(DRI, RESTART.to_bytes(2))
    out = []
    for p, (w, h), own in zip(payloads, shapes, pieces):
        frame = _segment(SOF2, bytes([8]) + (16 * h).to_bytes(2) + (16 * w).to_bytes(2) + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(head + frame + tables + _segment(COM, b"payload %d" % len(p)) + b"".join(own) + bytes([0xFF, EOI]))
    return out


def read_payloads(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """(payload, RGB tensor) of files that ``write_payloads`` has made."""
    images, coded = coefficients(files)
    out = []
    for image in images:
        size = next((int(c.split()[1]) for c in image.comments if c.startswith(b"payload ")), None)
        if size is None:
            raise Corrupt("no payload in this file")
        a = min(c.first for c in image.components.values())
        own = coded[a : a + size // 64].ravel()
        out.append(np.where(own > 0, own, own + 255).astype(np.uint8).tobytes())
    return out, rgb_tensors(images, coded)
