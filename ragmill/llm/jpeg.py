"""Progressive JPEG in numpy, many images at a time.

Entropy-coded data is read in lockstep: every restart interval of every image of a chunk is a lane, and
each numpy step takes one Huffman symbol from each lane. Spectral-selection and successive-approximation
scans accumulate into one coefficient array (rows: blocks, columns: zigzag positions), which an exact
integer inverse transform turns into samples; chroma is upsampled and converted to RGB.
"""

from __future__ import annotations

import re
import struct

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: ((s := i // 8 + i % 8), i // 8 if s % 2 else i % 8)))
SHIFT = 20


def _basis() -> np.ndarray:
    """Rows: zigzag coefficients; columns: samples of a block, as integers scaled by 2**SHIFT."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.rint(np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)[ZIGZAG] * (1 << SHIFT))


BASIS = _basis()

#: Huffman tables of the encoder as {length: symbols}, made by rule. ZRL is short, so that three and a symbol fit in 32 bits.
DC_CODES = {4: list(range(12))}
AC_CODES = {4: list(range(8)), 5: [0xF0], 8: [r << 4 | s for r in range(1, 16) for s in range(8) if r << 4 | s != 0xF0]}


def canonical(codes: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol."""
    code, value, length = 0, np.zeros(256, np.uint32), np.zeros(256, np.int32)
    for n in range(1, 17):
        for s in codes.get(n, ()):
            value[s], length[s] = code, n
            code += 1
        code <<= 1
    return value, length


def lookup(codes: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) by the next 16 bits; length 0 where no code begins."""
    sym, size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    value, length = canonical(codes)
    for n, symbols in codes.items():
        for s in symbols:
            at = int(value[s]) << (16 - n)
            sym[at : at + (1 << (16 - n))], size[at : at + (1 << (16 - n))] = s, length[s]
    return sym, size


# ---------------------------------------------------------------- encoder


def pack(value: np.ndarray, nbits: np.ndarray, per: int, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of items, ``per`` items to an interval, as stuffed bytes with restart markers between intervals.

    first: the intervals that begin an image's scan. Returns the bytes and where each such scan begins, with the end."""
    n = len(value) // per
    nbits = nbits.reshape(n, per)
    before = np.cumsum(nbits, axis=1, dtype=np.int32)
    total = before[:, -1]
    size = (total + 7) >> 3
    start = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    after = (before + (start[:-1] * 8)[:, None]).ravel()
    nbits = nbits.ravel()
    if not nbits.all():
        live = np.flatnonzero(nbits)
        after, nbits, value = after[live], nbits[live], value[live]
    pos = after - nbits
    v = value.astype(np.uint64) << (64 - nbits - (pos & 31)).astype(np.uint64)
    word = pos >> 5
    at = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
    words = np.zeros((start[-1] >> 2) + 3, np.uint64)
    words[word[at]] += np.add.reduceat(v >> np.uint64(32), at)
    words[word[at] + 1] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), at)
    out = words.astype(">u4").view(np.uint8)[: start[-1]].copy()
    out[start[1:] - 1] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)
    index_in = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    add = np.zeros(len(out) + 1, np.int64)
    add[np.flatnonzero(out == 0xFF) + 1] += 1
    marked = np.flatnonzero(index_in)
    add[start[marked]] += 2
    to = np.arange(len(out)) + np.cumsum(add)[:-1]
    long = np.zeros(len(out) + int(add.sum()), np.uint8)
    long[to] = out
    long[to[start[marked]] - 2] = 0xFF
    long[to[start[marked]] - 1] = 0xD0 + (index_in[marked] - 1) % 8
    return long.tobytes(), np.append(to[start[first]], len(long))


CATEGORY = np.array([n.bit_length() for n in range(4096)], np.int32)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category of each value, and its bits."""
    s = CATEGORY[np.abs(v)]
    return s, (v + (v < 0) * ((1 << s) - 1)).astype(np.uint32)


def encode_dc_first(dc: np.ndarray, comp: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray]:
    """dc: (intervals, blocks); comp: component of each block of an interval."""
    v = dc >> al
    diff = v.copy()
    last: dict[int, int] = {}
    for j, c in enumerate(comp):
        if c in last:
            diff[:, j] = v[:, j] - v[:, last[c]]
        last[c] = j
    code, length = canonical(DC_CODES)
    s, bits = _magnitude(diff.ravel())
    return code[s] << s.astype(np.uint32) | bits, length[s] + s


def encode_ac_first(c: np.ndarray, ss: int, se: int, al: int) -> tuple[np.ndarray, np.ndarray]:
    code, length = canonical(AC_CODES)
    c = c[:, ss : se + 1]
    v = np.where(c < 0, -(-c >> al), c >> al)
    n, w = v.shape
    col = np.arange(w, dtype=np.int32)
    last = np.maximum.accumulate(np.where(v != 0, col, np.int32(-1)), axis=1)
    run = col - 1 - np.concatenate((np.full((n, 1), -1, np.int32), last[:, :-1]), axis=1)
    s, bits = _magnitude(v)
    sym = (run & 15) << 4 | s
    value, nbits = np.zeros((n, w + 1), np.uint32), np.zeros((n, w + 1), np.int32)
    value[:, :w] = code[sym] << s.astype(np.uint32) | bits
    nbits[:, :w] = np.where(v != 0, length[sym] + s, 0)
    long = np.nonzero((v != 0) & (run > 15))
    for _ in range(3):
        k = run[long] > 15
        long = (long[0][k], long[1][k])
        value[long] |= code[0xF0] << nbits[long].astype(np.uint32)
        nbits[long] += length[0xF0]
        run[long] -= 16
    value[:, w], nbits[:, w] = code[0], np.where(last[:, -1] < w - 1, length[0], 0)
    return value.ravel(), nbits.ravel()


def encode_ac_refine(c: np.ndarray, ss: int, se: int, al: int) -> tuple[np.ndarray, np.ndarray]:
    code, length = canonical(AC_CODES)
    c = c[:, ss : se + 1]
    a = np.abs(c) >> al
    n, w = a.shape
    old, new = a > 1, a == 1
    value, nbits = np.zeros((n, w + 1), np.uint32), np.zeros((n, w + 1), np.int32)
    corr = np.cumsum(old, axis=1, dtype=np.int32)
    if old.all():  # one symbol closes the band, then comes a bit of each coefficient
        value[:, 0], nbits[:, 0], nbits[:, 1:] = code[0], length[0], 1
        value[:, 1:] = a & 1
        return value.ravel(), nbits.ravel()
    zero = np.cumsum(a == 0, axis=1, dtype=np.int32)
    since = zero - np.maximum.accumulate(np.where(new, zero, 0), axis=1)
    seen = np.cumsum(new, axis=1, dtype=np.int32)
    event = new | ((a == 0) & (since > 0) & (since % 16 == 0) & (seen < seen[:, -1:]))
    done = np.cumsum(event, axis=1, dtype=np.int32)
    # correction bits follow the symbol whose span they lie in
    i, j = np.nonzero(old)
    slot = corr[i, j] + done[i, j]
    value[i, slot], nbits[i, slot] = a[i, j] & 1, 1
    closed = np.maximum.accumulate(np.where(event, corr, 0), axis=1)
    i, j = np.nonzero(event)
    slot = done[i, j] - 1 + np.where(j > 0, closed[i, np.maximum(j - 1, 0)], 0)
    run = since[i, j] + zero_before_new(zero, new, i, j)
    sym = np.where(new[i, j], (run & 15) << 4 | 1, 0xF0)
    value[i, slot] = np.where(new[i, j], code[sym] << np.uint32(1) | (c[i, j] > 0).astype(np.uint32), code[sym])
    nbits[i, slot] = length[sym] + new[i, j]
    open_ = ~event[:, -1]
    i = np.flatnonzero(open_)
    slot = done[i, -1] + closed[i, -1]
    value[i, slot], nbits[i, slot] = code[0], length[0]
    return value.ravel(), nbits.ravel()


def zero_before_new(zero, new, i, j):
    """At a new coefficient ``since`` is 0 already; the zeros since the one before it."""
    base = np.maximum.accumulate(np.where(new, zero, 0), axis=1)
    prev = np.where(j > 0, base[i, np.maximum(j - 1, 0)], 0)
    return np.where(new[i, j], zero[i, j] - prev, 0)


SLOTS = np.array([0, 0, 0, 0, 1, 2])  # component of each block of an MCU: 4:2:0
MOST_ROWS = 4095


def grid(blocks: int) -> tuple[int, int]:
    """Columns and rows of MCUs for so many blocks."""
    mcus = -(-blocks // 6)
    cols = -(-mcus // MOST_ROWS)
    return cols, -(-mcus // cols)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, codes: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(len(codes.get(n, ())) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in codes.get(n, ())))


HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _dht(0x00, DC_CODES) + _dht(0x10, AC_CODES) + _segment(0xDD, struct.pack(">H", 1))
BANDS = ((1, 5), (6, 63))


def _sof(cols: int, rows: int) -> bytes:
    return _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))


def _sos(comps: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0x00]) for c in comps) + bytes([ss, se, ah << 4 | al]))


def raster(cols: int, rows: int) -> np.ndarray:
    """Blocks of the first component in raster order, as indices in MCU order."""
    if cols == 1:
        return (np.arange(rows)[:, None] * 6 + np.arange(4)).ravel()
    y, x = np.divmod(np.arange(rows * cols * 4), cols * 2)
    return (y // 2 * cols + x // 2) * 6 + (y & 1) * 2 + (x & 1)


def encode(payload: np.ndarray, blocks: np.ndarray) -> list[bytes]:
    """An image for each payload: ``blocks`` times 64 bytes each, one after another in ``payload``.

    Byte k of a block, taken as signed, is the quantised coefficient at zigzag position k, which the format
    stores without loss. Blocks fill the MCUs in order; the last ones are filled up with zeros."""
    shapes = [grid(int(b)) for b in blocks]
    mcus = np.array([c * r for c, r in shapes])
    coef = np.zeros((int(mcus.sum()) * 6, 64), np.int32)
    first = np.concatenate(([0], np.cumsum(mcus)))
    to = np.repeat(first[:-1] * 6 - np.concatenate(([0], np.cumsum(blocks)))[:-1], blocks) + np.arange(int(blocks.sum()))
    coef[to] = payload.view(np.int8).reshape(-1, 64)
    luma = np.concatenate([raster(c, r) + f * 6 for (c, r), f in zip(shapes, first, strict=False)])
    orders = [luma, np.arange(first[-1]) * 6 + 4, np.arange(first[-1]) * 6 + 5]
    starts = [first[:-1] * 4, first[:-1], first[:-1]]
    dc = coef[:, 0].reshape(-1, 6)
    scans = [(_sos([0, 1, 2], 0, 0, 0, 1), pack(*encode_dc_first(dc, SLOTS, 1), 6, first[:-1]))]
    for c in range(3):
        mine = coef[orders[c]]
        for ss, se in BANDS:
            scans.append((_sos([c], ss, se, 0, 1), pack(*encode_ac_first(mine, ss, se, 1), se - ss + 2, starts[c])))
        scans.append((_sos([c], 1, 63, 1, 0), pack(*encode_ac_refine(mine, 1, 63, 0), 64, starts[c])))
    scans.append((_sos([0, 1, 2], 0, 0, 1, 0), pack((dc & 1).astype(np.uint32).ravel(), np.ones(dc.size, np.int32), 6, first[:-1])))
    return [HEAD + _sof(*shapes[i]) + b"".join(sos + data[at[i] : at[i + 1]] for sos, (data, at) in scans) + b"\xff\xd9" for i in range(len(blocks))]


# ---------------------------------------------------------------- decoder


#: A marker that ends entropy-coded data: neither a stuffed byte nor a restart.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


class Image:
    __slots__ = ("comps", "h", "is_rgb", "mcux", "mcuy", "orders", "quant", "scans", "w")


def parse(data: bytes) -> Image:
    """Headers and where the scans lie. Raises ValueError for what is not a progressive 8-bit JPEG of one or three
    components whose sampling factors divide the largest."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    im, at, quant, tables, interval = Image(), 2, {}, {}, 0
    im.scans, im.orders, im.is_rgb = [], {}, False
    while True:
        at = data.index(b"\xff", at)
        marker = data[at + 1]
        if marker in (0xFF, 0x00) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
            im.is_rgb = body[11] == 0
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            depth, im.h, im.w, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit samples")
            raw = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hmax, vmax = max(r[1] for r in raw), max(r[2] for r in raw)
            if n not in (1, 3) or any(hmax % r[1] or vmax % r[2] for r in raw):
                raise ValueError("components or sampling not known")
            im.mcux, im.mcuy = -(-im.w // (8 * hmax)), -(-im.h // (8 * vmax))
            # id, h, v, blocks a row and column of the padded grid, of the grid a single-component scan covers, quantiser
            im.comps = [(i, h, v, im.mcux * h, im.mcuy * v, -(-(-(-im.w * h // hmax)) // 8), -(-(-(-im.h * v // vmax)) // 8), q) for i, h, v, q in raw]
        elif marker in (0xC0, 0xC1) or 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not progressive")
        elif marker == 0xDA:
            n = body[0]
            which = tuple((next(k for k, c in enumerate(im.comps) if c[0] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n))
            ss, se, ahl = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get(t >> 4, b"") if ss == 0 else tables.get(0x10 | t & 15, b"") for _, t in which)
            behind = MARKER.search(data, at)
            if not behind:
                raise ValueError("a scan without an end")
            end = behind.start()
            im.scans.append(((tuple(c for c, _ in which), ss, se, ahl >> 4, ahl & 15, interval, used), at, end))
            at = end
    im.quant = [quant[c[7]] for c in im.comps]
    return im


_TABLES: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if raw not in _TABLES:
        codes, at = {}, 16
        for n in range(16):
            codes[n + 1] = list(raw[at : at + raw[n]])
            at += raw[n]
        _TABLES[raw] = lookup(codes)
    return _TABLES[raw]


class Bits:
    """Entropy-coded data of scans of one kind, without stuffing and markers; ``start``: first bit of each interval."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts])
        raw = np.frombuffer(b"".join(parts), np.uint8)
        ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
        after = raw[ff + 1] if len(ff) else raw[:0]
        keep = np.ones(len(raw), bool)
        keep[ff[after == 0] + 1] = False
        rst = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep[rst] = keep[rst + 1] = False
        heads = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        begins = np.sort(np.concatenate((heads, rst + 2)))
        kept = np.concatenate(([0], np.cumsum(keep)))
        self.start = kept[begins] * 8
        self.bytes = np.concatenate((raw[keep], np.zeros(16, np.uint8)))
        self.words = np.ndarray((len(self.bytes) - 8,), ">u8", self.bytes.tobytes(), strides=(1,)).astype(np.uint64)

    def window(self, pos: np.ndarray) -> np.ndarray:
        """64 bits, at least 57 of them valid, from each bit position."""
        return self.words[np.minimum(pos >> 3, len(self.words) - 1)] << (pos & 7).astype(np.uint64)

    def bit(self, pos: np.ndarray) -> np.ndarray:
        return self.bytes[np.minimum(pos >> 3, len(self.bytes) - 1)] >> (7 - (pos & 7)).astype(np.uint8) & 1


def _symbol(win, table):
    at = (win >> np.uint64(48)).astype(np.int64)
    sym, size = table[0][at], table[1][at]
    if not size.all():
        raise ValueError("no such Huffman code")
    return sym, size, win << size.astype(np.uint64)


def _take(win, n):
    """The first n bits of each window; n may be 0."""
    return np.where(n > 0, win >> (64 - np.maximum(n, 1)).astype(np.uint64), 0).astype(np.int64)


def _extend(bits, s):
    return np.where(bits < (1 << np.maximum(s - 1, 0)), bits - (1 << s) + 1, bits)


def dc_first(coef, bits, order, begin, end, comp, tables, al):
    """order: block rows in scan order; lanes read order[begin:end]; comp: component slot by place in order."""
    pos, at = bits.start.copy(), begin.copy()
    pred = np.zeros((len(at), len(tables)), np.int64)
    lane = np.arange(len(at))
    while len(lane):
        which = comp[at[lane]]
        for c, table in enumerate(tables):
            mine = lane[which == c]
            if len(mine):
                sym, size, win = _symbol(bits.window(pos[mine]), table)
                pred[mine, c] += _extend(_take(win, sym), sym)
                coef[order[at[mine]], 0] = pred[mine, c] << al
                pos[mine] += size + sym
        at[lane] += 1
        lane = lane[at[lane] < end[lane]]


def dc_refine(coef, bits, order, begin, end, al):
    n = end - begin
    each = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    coef[order[begin[each] + inner], 0] |= bits.bit(bits.start[each] + inner).astype(np.int64) << al


def ac_first(coef, bits, order, begin, end, table, ss, se, al):
    pos, at, stop = bits.start.copy(), begin.copy(), end
    k = np.full(len(at), ss)
    flat = coef.reshape(-1)
    while len(at):
        sym, size, win = _symbol(bits.window(pos), table)
        r, s = sym >> 4, sym & 15
        eob = (s == 0) & (r < 15)
        more = np.where(eob, r, s)
        got = _take(win, more)
        k = k + r
        live = np.flatnonzero(s)
        if (k[live] > se).any():
            raise ValueError("a run leaves its band")
        flat[order[at[live]] * 64 + k[live]] = _extend(got[live], s[live]) << al
        k += 1
        pos = pos + size + more
        over = eob | (k > se)
        if over.any():
            at = at + np.where(eob, (1 << r) + got, over)
            k[over] = ss
            left = at < stop
            if not left.all():
                pos, at, stop, k = pos[left], at[left], stop[left], k[left]


def ac_refine(coef, bits, order, begin, end, table, ss, se, al):
    pos, at, stop = bits.start.copy(), begin.copy(), end
    k, run = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    w = se - ss + 1
    col = np.arange(w)
    flat = coef.reshape(-1)
    while len(at):
        rows = order[at]
        band = coef[rows, ss : se + 1]
        old = band != 0
        ahead = col >= k[:, None]
        fresh = np.flatnonzero(run == 0)
        value, target = np.zeros(len(at), np.int64), np.full(len(at), w)
        if len(fresh):
            sym, size, win = _symbol(bits.window(pos[fresh]), table)
            r, s = sym >> 4, sym & 15
            eob = (s == 0) & (r < 15)
            more = np.where(eob, r, s)
            got = _take(win, more)
            pos[fresh] += size + more
            run[fresh[eob]] = (1 << r[eob]) + got[eob]
            step = np.flatnonzero(~eob)
            if len(step):
                i = fresh[step]
                nth = np.cumsum(~old[i] & ahead[i], axis=1) == (r[step] + 1)[:, None]
                if not nth.any(axis=1).all():
                    raise ValueError("a run leaves its band")
                target[i] = nth.argmax(axis=1)
                value[i] = np.where(s[step] > 0, np.where(got[step] > 0, 1, -1), 0)
        fix = old & ahead & (col < target[:, None])
        count = fix.sum(axis=1)
        where = (np.repeat(rows * 64 + ss, count) + np.broadcast_to(col, fix.shape)[fix])
        on = bits.bit(np.repeat(pos - np.cumsum(count) + count, count) + np.arange(len(where))).astype(np.int32) << al
        value_was = flat[where]
        flat[where] = value_was + on * np.sign(value_was)
        pos += count
        new = np.flatnonzero(value)
        coef[rows[new], ss + target[new]] = value[new] << al
        k = target + 1
        over = k >= w
        run -= over & (run > 0)
        at = at + over
        k[over] = 0
        left = at < stop
        if not left.all():
            pos, at, stop, k, run = pos[left], at[left], stop[left], k[left], run[left]


def coefficients(files: list[bytes]) -> tuple[np.ndarray, list[Image], list[list[int]]]:
    """All quantised coefficients in zigzag order, the images, and the first row of each component of each image."""
    images = [parse(f) for f in files]
    first, rows = [], 0
    for im in images:
        mine = []
        for c in im.comps:
            mine.append(rows)
            rows += c[3] * c[4]
        first.append(mine)
    coef = np.zeros((rows, 64), np.int32)
    for n in range(max((len(im.scans) for im in images), default=0)):
        kinds: dict[tuple, list[int]] = {}
        for i, im in enumerate(images):
            if n < len(im.scans):
                kinds.setdefault(im.scans[n][0], []).append(i)
        for (comps, ss, se, ah, al, interval, used), which in kinds.items():
            order, comp, lanes = [], [], []
            at = 0
            for i in which:
                o, c, mcu = scan_order(images[i], first[i], comps)
                step = (interval or max(1, len(o) // mcu)) * mcu
                lanes.append(np.arange(0, len(o), step) + at)
                order.append(o)
                comp.append(c)
                at += len(o)
            order, comp = np.concatenate(order), np.concatenate(comp)
            begin = np.concatenate(lanes)
            end = np.append(begin[1:], at)
            bits = Bits([files[i][images[i].scans[n][1] : images[i].scans[n][2]] for i in which])
            if len(bits.start) != len(begin):
                raise ValueError("restart markers do not match")
            if ss == 0 and ah == 0:
                dc_first(coef, bits, order, begin, end, comp, [_table(t) for t in used], al)
            elif ss == 0:
                dc_refine(coef, bits, order, begin, end, al)
            else:
                (ac_refine if ah else ac_first)(coef, bits, order, begin, end, _table(used[0]), ss, se, al)
    return coef, images, first


def scan_order(im: Image, first: list[int], comps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Block rows in the order of a scan, the component slot of each, and blocks per MCU; found once an image."""
    if comps not in im.orders:
        im.orders[comps] = _scan_order(im, first, comps)
    return im.orders[comps]


def _scan_order(im, first, comps):
    if len(comps) == 1:
        _, _, _, wide, _, bw, bh, _ = im.comps[comps[0]]
        o = (np.arange(bh)[:, None] * wide + np.arange(bw) + first[comps[0]]).ravel()
        return o, np.zeros(len(o), np.int8), 1
    my, mx = np.divmod(np.arange(im.mcux * im.mcuy), im.mcux)
    parts, slots = [], []
    for slot, c in enumerate(comps):
        _, h, v, wide, *_ = im.comps[c]
        for y in range(v):
            for x in range(h):
                parts.append(first[c] + (my * v + y) * wide + mx * h + x)
                slots.append(slot)
    return np.stack(parts, axis=1).ravel(), np.tile(np.array(slots, np.int8), im.mcux * im.mcuy), len(parts)


def payload_of(coef: np.ndarray, im: Image, first: list[int]) -> bytes:
    """The bytes that encode() put into an image, with the blocks that filled it up."""
    order = scan_order(im, first, (0, 1, 2))[0]
    return coef[order].astype(np.int8).tobytes()


def rgb(coef: np.ndarray, im: Image, first: list[int]) -> np.ndarray:
    """(height, width, 3) uint8, at full resolution."""
    hmax, vmax = max(c[1] for c in im.comps), max(c[2] for c in im.comps)
    planes = []
    for k, (_, h, v, wide, tall, *_) in enumerate(im.comps):
        block = coef[first[k] : first[k] + wide * tall] * im.quant[k]
        x = np.floor_divide(block.astype(np.float64) @ BASIS + (1 << (SHIFT - 1)), 1 << SHIFT)
        x = np.clip(x + 128, 0, 255).astype(np.int32).reshape(tall, wide, 8, 8).transpose(0, 2, 1, 3).reshape(tall * 8, wide * 8)
        if v < vmax:
            x = np.repeat(x, vmax // v, axis=0)
        if h < hmax:
            x = np.repeat(x, hmax // h, axis=1)
        planes.append(x[: im.h, : im.w])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    if im.is_rgb:
        return np.stack(planes, axis=2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    out = np.empty((im.h, im.w, 3), np.int32)
    out[:, :, 0] = (y + 91881 * cr + half) >> 16
    out[:, :, 1] = (y - 22554 * cb - 46802 * cr + half) >> 16
    out[:, :, 2] = (y + 116130 * cb + half) >> 16
    return np.clip(out, 0, 255).astype(np.uint8)


def decode(files: list[bytes]) -> list[np.ndarray]:
    """RGB tensors of progressive JPEG files."""
    coef, images, first = coefficients(files)
    return [rgb(coef, im, f) for im, f in zip(images, first, strict=True)]
