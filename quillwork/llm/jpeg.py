"""Progressive JPEG in numpy, many images at once: coefficients to files, files to coefficients, coefficients to RGB.

Images have three components with chroma at half resolution (4:2:0) and quantisation by one. The scan script has DC first
and refined, spectral selection (luma's low and high bands apart) and successive approximation by one bit. Restart markers
every INTERVAL units make segments that don't depend on each other, so numpy decodes a symbol of every segment of every
image in one step. Blocks hold their coefficients in zigzag order throughout.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

INTERVAL = 8
#: Minimum coded units in a row, unless an image would be too tall.
ROW, MOST = 64, 4095
# The zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@dataclass(frozen=True)
class Scan:
    components: tuple[int, ...]
    low: int
    high: int
    before: int  # bits that earlier scans had left out; 0 for a first scan
    after: int  # bits that this scan leaves out


SCRIPT = (
    Scan((0, 1, 2), 0, 0, 0, 1), Scan((0,), 1, 5, 0, 1), Scan((1,), 1, 63, 0, 1), Scan((2,), 1, 63, 0, 1), Scan((0,), 6, 63, 0, 1),
    Scan((0, 1, 2), 0, 0, 1, 0), Scan((0,), 1, 63, 1, 0), Scan((1,), 1, 63, 1, 0), Scan((2,), 1, 63, 1, 0),
)

#: Code lengths by symbol. DC: sizes. AC first: (zeros before, size), ends of blocks, sixteen zeros. AC refined: the same
#: with size 1; there nearly all blocks are one end-of-block symbol.
_RUNS = [r << 4 | s for r in range(1, 16) for s in range(1, 9)]
_ENDS = [r << 4 for r in range(1, 15)]
LENGTHS = (
    {s: 4 for s in range(12)},
    {0: 4} | {s: 4 for s in range(1, 8)} | {8: 8, 0xF0: 9} | {x: 9 for x in _RUNS + _ENDS},
    {0: 1, 1: 3} | {x: 8 for x in [r << 4 | 1 for r in range(1, 16)] + _ENDS + [0xF0]},
)


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Canonical codes and lengths by symbol, and the table's specification."""
    code, size, at, last = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    for s in symbols:
        at <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = at, last
        at += 1
    counts = bytes(sum(1 for s in symbols if lengths[s] == n) for n in range(1, 17))
    return code, size, counts + bytes(symbols)


_TABLES = [_codes(x) for x in LENGTHS]


def _lookup(spec: bytes) -> np.ndarray:
    """Of each 16 bits: length << 8 | symbol of the code that they begin with (0: none)."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            a = code << (16 - n)
            out[a : a + (1 << (16 - n))] = n << 8 | spec[k]
            code += 1
            k += 1
        code <<= 1
    return out


def grid(units: int) -> tuple[int, int]:
    """Units in a row, and rows."""
    width = max(1, min(units, ROW), -(-units // MOST))
    return width, -(-units // width)


def _size(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _bits_of(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _packed(code: np.ndarray, size: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Items' bits, segment after segment, each filled up with ones; and where each segment's bytes begin (and the end)."""
    total = np.bincount(segment, weights=size, minlength=segments).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(-(-total // 8))])
    filled = np.concatenate([[0], np.cumsum(total)])[:-1]
    at = np.cumsum(size) - size
    at += (begin[:-1] * 8 - filled)[segment]
    fill = -total % 8
    word = code << (np.uint64(64) - size.astype(np.uint64) - (at & 7).astype(np.uint64))
    reach, byte = (at & 7) + size, at >> 3
    out = np.zeros(begin[-1] + 1)
    live = None
    for j in range(8):
        more = np.flatnonzero(reach > 8 * j) if live is None else live[reach[live] > 8 * j]
        if not len(more):
            break
        part = ((word[more] >> np.uint64(56 - 8 * j)) & np.uint64(255)).astype(np.float64)
        out += np.bincount(byte[more] + j, weights=part, minlength=len(out))
        live = more
    data = out[:-1].astype(np.uint8)
    open_ = np.flatnonzero(fill)
    data[begin[1:][open_] - 1] |= ((1 << fill[open_]) - 1).astype(np.uint8)
    return data, begin


def _framed(data: np.ndarray, begin: np.ndarray, image: np.ndarray, images: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments with stuffed zeros and restart markers between; and where each image's bytes begin."""
    stuffed = 1 + (data == 255)
    place = np.concatenate([[0], np.cumsum(stuffed)])
    last = np.append(image[1:] != image[:-1], True)
    length = np.diff(place[begin]) + np.where(last, 0, 2)
    start = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(start[-1], np.uint8)
    segment = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    out[place[:-1] + (start[:-1] - place[begin[:-1]])[segment]] = data
    head = np.flatnonzero(np.concatenate([[True], ~(image[1:] == image[:-1])]))
    number = np.arange(len(image)) - np.repeat(head, np.diff(np.append(head, len(image))))
    mark = start[1:][~last] - 2
    out[mark], out[mark + 1] = 255, 0xD0 + (number[~last] % 8)
    return out, start[np.searchsorted(image, np.arange(images + 1))]


def _first_items(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and sizes of first AC scans; a slot for each coefficient, and one for the block's end."""
    code_of, size_of, _ = _TABLES[1]
    n, k = v.shape
    code, bits = np.zeros((n, k + 1), np.uint64), np.zeros((n, k + 1), np.int64)
    symbol = np.arange(-128, 129)
    s = _size(symbol)
    by_code = (code_of[s] << s.astype(np.uint64)) | _bits_of(symbol, s)
    by_size = np.where(symbol == 0, 0, size_of[s] + s)
    code[:, :k], bits[:, :k] = by_code[v + 128], by_size[v + 128]
    some = np.flatnonzero((v == 0).any(axis=1))
    if len(some):
        code[some, :k] = 0
        row, col = np.nonzero(v[some])
        new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        run = col - np.where(new, 0, np.concatenate([[0], col[:-1] + 1])) if len(row) else col
        value = v[some][row, col]
        size = _size(value)
        symbol = (run & 15) << 4 | size
        c, b = (code_of[symbol] << size.astype(np.uint64)) | _bits_of(value, size), size_of[symbol] + size
        for _ in range(3):
            long = run >= 16
            c[long] |= code_of[0xF0] << b[long].astype(np.uint64)
            b[long] += size_of[0xF0]
            run = np.where(long, run - 16, run)
        code[some[row], col], bits[some[row], col] = c, b
        last = np.full(len(some), -1)
        last[row] = col  # the last one of a row is what stays
        end = some[last < k - 1]
        code[end, k], bits[end, k] = code_of[0], size_of[0]
    return code, bits


def _refined_items(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, sizes and rows of refined AC scans. ``v`` has whole values; earlier scans had their halves, towards zero.

    A block without new values is its end-of-block symbol and a bit for each value that was known: two items. In others each
    symbol stands before the bits of the values that it passes.
    """
    code_of, size_of, _ = _TABLES[2]
    n, k = v.shape
    known, new = np.abs(v) > 1, np.abs(v) == 1
    bit = (np.abs(v) & 1).astype(bool)
    plain = np.flatnonzero(known.all(axis=1) & (k == 63))
    rest = np.setdiff1d(np.arange(n), plain, assume_unique=True)
    row_bits = np.zeros((len(plain), 64), bool)
    row_bits[:, 1:] = bit[plain] if len(plain) else False
    assert size_of[0] == 1 and code_of[0] == 0
    halves = np.packbits(row_bits, axis=1).view(">u4").astype(np.uint64).reshape(-1)
    rows, codes, sizes, order = [np.repeat(plain, 2)], [halves], [np.full(len(halves), 32, np.int64)], [np.tile([0, 1], len(plain))]
    if len(rest):
        known, new, bit, value = known[rest], new[rest], bit[rest], v[rest]
        zero = ~known & ~new
        zeros = np.cumsum(zero, axis=1)
        base = np.maximum.accumulate(np.where(new, zeros, 0), axis=1)
        base = np.concatenate([np.zeros((len(rest), 1), base.dtype), base[:, :-1]], axis=1)
        later = np.cumsum(new[:, ::-1], axis=1)[:, ::-1] > 0
        sixteen = zero & later & ((zeros - base) % 16 == 0) & (zeros > base)
        mark = new | sixteen
        group = np.cumsum(mark, axis=1) - mark
        passed = np.cumsum(known, axis=1) - known
        r, c = np.nonzero(known)
        rows.append(rest[r])
        codes.append(bit[r, c].astype(np.uint64))
        sizes.append(np.ones(len(r), np.int64))
        order.append(group[r, c] + 1 + passed[r, c])
        r, c = np.nonzero(mark)
        before = np.zeros(len(r), np.int64)
        if len(r):
            same = np.concatenate([[False], r[1:] == r[:-1]])
            before[same] = passed[r, c][np.flatnonzero(same) - 1]
        run = (zeros - base)[r, c] % 16
        fresh = new[r, c]
        symbol = np.where(fresh, run << 4 | 1, 0xF0)
        rows.append(rest[r])
        codes.append(np.where(fresh, code_of[symbol] << np.uint64(1) | (value[r, c] > 0).astype(np.uint64), code_of[symbol]))
        sizes.append(size_of[symbol] + fresh)
        order.append(group[r, c] + before)
        last = np.where(mark.any(axis=1), k - 1 - mark[:, ::-1].argmax(axis=1), -1)
        end = np.flatnonzero(last < k - 1)
        rows.append(rest[end])
        codes.append(np.full(len(end), code_of[0]))
        sizes.append(np.full(len(end), size_of[0]))
        order.append(mark.sum(axis=1)[end] + np.where(last[end] >= 0, passed[end, np.maximum(last[end], 0)], 0))
    row, code, size, place = (np.concatenate(x) for x in (rows, codes, sizes, order))
    if len(rest):
        by = np.argsort(row * 256 + place, kind="stable")
        row, code, size = row[by], code[by], size[by]
    return code, size, row


@dataclass
class Layout:
    """Where the images' blocks lie in one array of blocks: each image's luma in raster order, then its two chromas."""

    units: np.ndarray  # of each image, rows filled
    width: np.ndarray
    first: np.ndarray  # blocks before the image's

    @classmethod
    def of(cls, widths: np.ndarray, heights: np.ndarray) -> Layout:
        units = widths * heights
        return cls(units, widths, np.concatenate([[0], np.cumsum(units * 6)]))

    def runs(self, component: int) -> tuple[np.ndarray, np.ndarray]:
        """First block and number of blocks of a component, by image."""
        offset = self.units * (0, 4, 5)[component]
        return self.first[:-1] + offset, self.units * (4, 1, 1)[component]

    def unit_blocks(self, image: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The six blocks of units, in the order of interleaved scans."""
        w, base, n = self.width[image], self.first[image], self.units[image]
        y, x = np.divmod(unit, w)
        corner = base + 4 * y * w + 2 * x
        return np.stack([corner, corner + 1, corner + 2 * w, corner + 2 * w + 1, base + 4 * n + unit, base + 5 * n + unit], axis=-1)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _segmented(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``counts`` things by image: each thing's segment, each segment's image, and the segments' sizes."""
    per = -(-counts // INTERVAL)
    image = np.repeat(np.arange(len(counts)), per)
    size = np.full(per.sum(), INTERVAL)
    last = np.cumsum(per) - 1
    size[last] = counts - (per - 1) * INTERVAL
    return np.repeat(np.arange(len(size)), size), image, size


def encode(blocks: np.ndarray, layout: Layout, notes: list[bytes]) -> list[bytes]:
    """Files of all images; ``blocks`` has a row of 64 coefficients (-128 to 127) a block, ``notes`` a comment an image."""
    images = len(layout.units)
    scans = []
    half = np.sign(blocks) * (np.abs(blocks) >> 1)
    for scan in SCRIPT:
        if not scan.high:
            segment, image, _ = _segmented(layout.units)
            unit = _ranges(np.zeros(images, np.int64), layout.units)
            order = layout.unit_blocks(image[segment], unit)
            dc = blocks[order, 0].astype(np.int64)
            if scan.before:
                code, size = (dc & 1).astype(np.uint64).reshape(-1), np.ones(dc.size, np.int64)
            else:
                dc >>= 1
                fresh = np.concatenate([[True], segment[1:] != segment[:-1]])
                before = np.zeros_like(dc)
                before[:, 1:4] = dc[:, 0:3]
                for a, b in ((0, 3), (4, 4), (5, 5)):
                    before[1:, a] = dc[:-1, b]
                before[fresh] = np.where([True, False, False, False, True, True], 0, before[fresh])
                diff = (dc - before).reshape(-1)
                s = _size(diff)
                code, size = (_TABLES[0][0][s] << s.astype(np.uint64)) | _bits_of(diff, s), _TABLES[0][1][s] + s
            item = np.repeat(segment, 6)
        else:
            first, count = layout.runs(scan.components[0])
            segment, image, _ = _segmented(count)
            rows = _ranges(first, count)
            if scan.before:
                code, size, row = _refined_items(blocks[rows, scan.low : scan.high + 1])
                item = segment[row]
            else:
                code, size = _first_items(half[rows, scan.low : scan.high + 1])
                item = np.repeat(segment, code.shape[1])
                code, size = code.reshape(-1), size.reshape(-1)
                used = np.flatnonzero(size)
                code, size, item = code[used], size[used], item[used]
        scans.append(_framed(*_packed(code, size, item, len(image)), image, images))
    tables = [struct.pack(">HHB", 0xFFDB, 67, 0) + b"\1" * 64, struct.pack(">HHH", 0xFFDD, 4, INTERVAL)]
    for kind, spec in ((0x00, 0), (0x10, 1), (0x11, 2)):
        tables.append(struct.pack(">HHB", 0xFFC4, 3 + len(_TABLES[spec][2]), kind) + _TABLES[spec][2])
    heads = []
    for scan in SCRIPT:
        table = 0x01 if scan.before and scan.high else 0x00
        heads.append(struct.pack(">HHB", 0xFFDA, 6 + 2 * len(scan.components), len(scan.components)) + b"".join(bytes([c + 1, table]) for c in scan.components) + bytes([scan.low, scan.high, scan.before << 4 | scan.after]))
    out = []
    for i in range(images):
        w, h = int(layout.width[i]) * 16, int(layout.units[i] // layout.width[i]) * 16
        frame = struct.pack(">HHBHHB", 0xFFC2, 17, 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", struct.pack(">HH", 0xFFFE, 2 + len(notes[i])), notes[i], *tables, frame]
        for head, (data, at) in zip(heads, scans, strict=True):
            parts += [head, data[at[i] : at[i + 1]].tobytes()]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


class _Lanes:
    """Segments being read: bit positions in the bytes of all files without stuffed zeros."""

    def __init__(self, data: np.ndarray):
        keep = np.ones(len(data), bool)
        keep[1:] = ~((data[1:] == 0) & (data[:-1] == 255))
        self.place = np.concatenate([[0], np.cumsum(keep)])
        plain = np.concatenate([data[keep], np.full(16, 255, np.uint8)])
        self.bytes = plain
        window = np.zeros(len(plain) - 8, np.uint64)
        for j in range(8):
            window |= plain[j : j + len(window)].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.window = window

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, from the top."""
        return self.window[at >> 3] << (at & 7).astype(np.uint64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


def _top(word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` bits (none: 0)."""
    return ((word >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)


def _value(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def decode(files: list[bytes]) -> tuple[np.ndarray, Layout, list[bytes]]:
    """Coefficients, layout and comments of files whose frames are as ``encode`` makes them."""
    data = np.frombuffer(b"".join(files), np.uint8)
    lengths = np.array([len(f) for f in files])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    marks = np.flatnonzero((data[:-1] == 255) & (data[1:] != 0))
    codes = data[marks + 1]
    restart = (codes >= 0xD0) & (codes <= 0xD7)
    ends = marks[~restart]
    widths, heights, notes = [], [], []
    scans: list[tuple] = []
    lookups: dict[bytes, int] = {}
    tables: list[np.ndarray] = []
    for i, f in enumerate(files):
        at, spec, interval = 2, {}, 0
        while True:
            if f[at + 1] == 0xD9:
                break
            code, size = struct.unpack_from(">HH", f, at)
            body = f[at + 4 : at + 2 + size]
            at += 2 + size
            if code == 0xFFFE:
                notes.append(body)
            elif code == 0xFFDD:
                interval = struct.unpack(">H", body)[0]
            elif code == 0xFFC4:
                if body[1:] not in lookups:
                    lookups[body[1:]] = len(tables)
                    tables.append(_lookup(body[1:]))
                spec[body[0]] = lookups[body[1:]]
            elif code == 0xFFC2:
                _, h, w, _ = struct.unpack_from(">BHHB", body)
                widths.append(-(-w // 16))
                heights.append(-(-h // 16))
                if (body[7], body[10], body[13]) != (0x22, 0x11, 0x11):
                    raise ValueError("only 4:2:0 is read")
            elif code == 0xFFDB and body[1:] != b"\1" * 64:
                raise ValueError("only quantisation by one is read")
            elif code == 0xFFDA:
                n = body[0]
                low, high, bits = body[1 + 2 * n : 4 + 2 * n]
                stop = int(ends[np.searchsorted(ends, starts[i] + at)] - starts[i])
                table = spec.get(0x10 | body[2] & 15 if high else body[2] >> 4, 0)
                scans.append((i, body[1] - 1, low, high, bits >> 4, bits & 15, table, starts[i] + at, starts[i] + stop, interval))
                at = stop
    layout = Layout.of(np.array(widths), np.array(heights))
    blocks = np.zeros((layout.first[-1], 64), np.int16)
    lanes = _Lanes(data)
    lookup = np.concatenate(tables)
    restarts = marks[restart]
    # Scans of one kind are read together, in the order in which an image may have them.
    kinds = sorted({(s[4] > 0, s[3] > 0) for s in scans}, key=lambda x: (x[0], x[1]))
    for refined, ac in kinds:
        own = [s for s in scans if (s[4] > 0, s[3] > 0) == (refined, ac)]
        image, component, low, high, _, after, table, a, b, interval = (np.array(x) for x in zip(*own, strict=True))
        i, j = np.searchsorted(restarts, a), np.searchsorted(restarts, b)
        n = j - i + 1
        of = np.repeat(np.arange(len(own)), n)
        inner = _ranges(i, n - 1)
        begin = np.zeros(len(of), np.int64)
        head = np.concatenate([[0], np.cumsum(n)[:-1]])
        begin[head] = a
        rest = np.ones(len(of), bool)
        rest[head] = False
        begin[rest] = restarts[inner] + 2
        number = np.arange(len(of)) - head[of]
        bit = lanes.place[begin] * 8
        shared = (lanes, lookup, bit, table[of] << 16, after[of], blocks)
        if not ac:
            most = layout.units[image[of]]
            start = number * interval[of]
            _read_dc(*shared, layout, image[of], start, np.minimum(interval[of], most - start), refined)
        else:
            firsts, counts = (np.stack([layout.runs(c)[x] for c in range(3)]) for x in (0, 1))
            start = number * interval[of]
            count = np.minimum(interval[of], counts[component[of], image[of]] - start)
            f = _read_refined if refined else _read_first
            f(*shared, firsts[component[of], image[of]] + start, count, low[of], high[of])
    return blocks, layout, notes


def _read_dc(lanes, lookup, bit, table, after, blocks, layout, image, start, count, refined) -> None:
    before = np.zeros((len(bit), 3), np.int64)
    for u in range(int(count.max())):
        live = np.flatnonzero(count > u)
        order = layout.unit_blocks(image[live], start[live] + u)
        for j in range(6):
            c, rows = max(0, j - 3), order[:, j]
            if refined:
                blocks[rows, 0] |= lanes.bit(bit[live]).astype(np.int16) << after[live].astype(np.int16)
                bit[live] += 1
                continue
            word = lanes.peek(bit[live])
            found = lookup[table[live] + (word >> np.uint64(48)).astype(np.int64)]
            size, length = found & 255, found >> 8
            extra = _top(word << length.astype(np.uint64), size)
            before[live, c] += _value(extra, size)
            blocks[rows, 0] = before[live, c] << after[live]
            bit[live] += length + size


def _read_first(lanes, lookup, bit, table, after, blocks, first, count, low, high) -> None:
    flat = blocks.reshape(-1)
    block, k = np.zeros(len(bit), np.int64), low.copy()
    first = first * 64
    while len(bit):
        word = lanes.peek(bit)
        found = lookup[table + (word >> np.uint64(48)).astype(np.int64)]
        symbol, length = found & 255, found >> 8
        run, size = symbol >> 4, symbol & 15
        end = (size == 0) & (run < 15)
        some_end = end.any()
        extra = _top(word << length.astype(np.uint64), np.where(end, run, size) if some_end else size)
        k += run
        if size.all():
            flat[first + block * 64 + k] = _value(extra, size) << after
        else:
            put = np.flatnonzero(size)
            flat[first[put] + block[put] * 64 + k[put]] = _value(extra[put], size[put]) << after[put]
        k += 1
        bit = bit + length + size
        over = k > high
        if some_end:
            bit += np.where(end, run, 0)
            block += np.where(end, (1 << run) + extra - 1, 0)
            over |= end
        block += over
        k = np.where(over, low, k)
        done = block >= count
        if done.any():
            go = np.flatnonzero(~done)
            bit, table, after, first, count, low, high, block, k = (x[go] for x in (bit, table, after, first, count, low, high, block, k))


def _read_refined(lanes, lookup, bit, table, after, blocks, first, count, low, high) -> None:
    """A symbol of every lane in each step, with all the bits of the known values that it passes."""
    block, k, ends = np.zeros(len(bit), np.int64), low.copy(), np.zeros(len(bit), np.int64)
    column = np.arange(64)
    while len(bit):
        word = lanes.peek(bit)
        found = lookup[table + (word >> np.uint64(48)).astype(np.int64)]
        ask = ends == 0
        symbol, length = np.where(ask, found & 255, 0), np.where(ask, found >> 8, 0)
        run, size = symbol >> 4, symbol & 15
        end = (size == 0) & (run < 15)
        after_code = word << length.astype(np.uint64)
        fresh = np.where(_top(after_code, np.ones_like(run)) > 0, 1, -1)
        started = ask & end
        ends = np.where(started, (1 << run) + _top(after_code, np.where(end, run, 0)), ends)
        bit = bit + length + np.where(started, run, size)
        row = first + block
        value = blocks[row]
        inside = (column >= k[:, None]) & (column <= high[:, None])
        known = (value != 0) & inside
        if end.all():
            passed, stop = known, high
        else:
            zero = np.cumsum((value == 0) & inside, axis=1)
            reached = (zero == (run + 1)[:, None]) & inside
            stop = np.where(end | ~reached.any(axis=1), high, reached.argmax(axis=1))
            passed = known & (column <= stop[:, None])
        number = np.cumsum(passed, axis=1)
        at = bit[:, None] + number - 1
        add = np.zeros_like(value)
        add[passed] = lanes.bit(at[passed])
        add <<= after[:, None].astype(np.int16)
        blocks[row] = value + np.where(value < 0, -add, add)
        put = np.flatnonzero(~end & (size > 0))
        blocks[row[put], stop[put]] = fresh[put] << after[put]
        bit = bit + number[:, -1]
        k = stop + 1
        over = end | (k > high)
        ends = np.where(end, ends - 1, ends)
        block = block + over
        k = np.where(over, low, k)
        done = block >= count
        if done.any():
            go = np.flatnonzero(~done)
            bit, table, after, first, count, low, high, block, k, ends = (x[go] for x in (bit, table, after, first, count, low, high, block, k, ends))


def _inverse() -> np.ndarray:
    """Zigzag coefficients to samples, times 2**12, in whole numbers: sums are exact in any order."""
    n = np.arange(8)
    basis = np.cos((2 * n[:, None] + 1) * n * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    both = np.einsum("yu,xv->uvyx", basis, basis).reshape(64, 64)
    return np.round(both[ZIGZAG] * 4096)


_INVERSE = _inverse()


def samples(blocks: np.ndarray) -> np.ndarray:
    """Samples (0 to 255) of each block, row after row."""
    out = np.floor((blocks.astype(np.float64) @ _INVERSE + 2048) / 4096) + 128
    return np.clip(out, 0, 255).astype(np.uint8)


def rgb(pixels: np.ndarray, layout: Layout, image: int) -> np.ndarray:
    """The image's full-resolution tensor (height, width, 3); each chroma sample stands for two by two of luma."""
    w, n = int(layout.width[image]), int(layout.units[image])
    h, at = n // w, int(layout.first[image])
    plane = lambda a, rows, cols: pixels[a : a + rows * cols].reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8).astype(np.int32)
    y = plane(at, 2 * h, 2 * w)
    cb, cr = (plane(at + c * n, h, w) - 128 for c in (4, 5))
    red, green, blue = 91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb
    parts = [y + ((x + 32768) >> 16).repeat(2, axis=0).repeat(2, axis=1) for x in (red, green, blue)]
    return np.clip(np.stack(parts, axis=-1), 0, 255).astype(np.uint8)
