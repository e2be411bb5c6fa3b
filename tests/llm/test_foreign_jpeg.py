"""Progressive files as other coders make them, written one symbol at a time, against the decoder."""

import struct

import numpy as np
import pytest

from ragmill.llm import jpeg, op4_media

DC = {3: [0, 1, 2], 5: [3, 4, 5, 6], 9: list(range(7, 12))}
AC = {4: [0x00, 0x01, 0x11, 0x10], 7: [0xF0, 0x02, 0x20], 16: [s for s in range(256) if s & 15 < 12 and s not in (0x00, 0x01, 0x11, 0x10, 0xF0, 0x02, 0x20)][:180]}


def words(table):
    code, out = 0, {}
    for n in range(1, 17):
        for s in table.get(n, []):
            out[s] = format(code, f"0{n}b")
            code += 1
        code *= 2
    return out


class Scan:
    """Bits of one scan; ``restart`` MCUs to an interval."""

    def __init__(self, restart):
        self.out, self.bits, self.restart, self.mcus, self.marks = b"", "", restart, 0, 0
        self.run, self.held, self.dc, self.ac = 0, "", words(DC), words(AC)

    def flush_run(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.bits += self.ac[n << 4] + (format(self.run - (1 << n), f"0{n}b") if n else "") + self.held
            self.run, self.held = 0, ""

    def close(self):
        self.flush_run()
        self.bits += "1" * (-len(self.bits) % 8)
        for i in range(0, len(self.bits), 8):
            b = int(self.bits[i : i + 8], 2)
            self.out += bytes([b]) + (b"\0" if b == 255 else b"")
        self.bits = ""

    def mcu(self):
        """Before an MCU; True where prediction begins anew."""
        new = self.mcus == 0 or bool(self.restart) and self.mcus % self.restart == 0
        if new and self.mcus:
            self.close()
            self.out += bytes([0xFF, 0xD0 + self.marks % 8])
            self.marks += 1
        self.mcus += 1
        return new


def signed(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def shifted(v, al):
    return -(-v >> al) if v < 0 else v >> al


def ac_first(s, block, ss, se, al):
    zeros = 0
    for k in range(ss, se + 1):
        v = shifted(int(block[k]), al)
        if not v:
            zeros += 1
            continue
        s.flush_run()
        while zeros > 15:
            s.bits += s.ac[0xF0]
            zeros -= 16
        n, b = signed(v)
        s.bits += s.ac[zeros << 4 | n] + b
        zeros = 0
    if zeros:
        s.run += 1


def ac_refine(s, block, ss, se, al):
    a = [abs(int(v)) >> al for v in block]
    fresh = max((k for k in range(ss, se + 1) if a[k] == 1), default=-1)
    zeros, fixes = 0, ""
    for k in range(ss, se + 1):
        if not a[k]:
            zeros += 1
            continue
        while zeros > 15 and k <= fresh:
            s.flush_run()
            s.bits += s.ac[0xF0] + fixes
            zeros, fixes = zeros - 16, ""
        if a[k] > 1:
            fixes += str(a[k] & 1)
            continue
        s.flush_run()
        s.bits += s.ac[zeros << 4 | 1] + ("1" if block[k] > 0 else "0") + fixes
        zeros, fixes = 0, ""
    if zeros or fixes:
        s.run += 1
        s.held += fixes


def segment(marker, body):
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def made(seed, w, h, sampling, restart, high, wide, extra=b""):
    """A file, its coefficients as (rows, columns, 64) by component in zigzag order, and its quantisers."""
    rng = np.random.default_rng(seed)
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    mx, my = -(-w // (8 * hm)), -(-h // (8 * vm))
    coefs, sizes, quants = [], [], []
    for sh, sv in sampling:
        c = np.zeros((my * sv, mx * sh, 64), int)
        bw, bh = -(-(-(-w * sh // hm)) // 8), -(-(-(-h * sv // vm)) // 8)
        dense = rng.random((bh, bw, 1)) < 0.4  # the other blocks make runs of ends
        c[:bh, :bw] = np.where(dense & (rng.random((bh, bw, 64)) < 0.3), rng.integers(-30, 31, (bh, bw, 64)), 0)
        c[:, :, 0] = rng.integers(-60, 61, c.shape[:2])
        coefs.append(c)
        sizes.append((bw, bh))
        quants.append(rng.integers(1, 400 if wide else 9, 64))
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + extra + segment(0xFE, b"not a \xff\xda scan")
    for i, q in enumerate(quants):
        out += segment(0xDB, bytes([i | 16 * wide]) + (struct.pack(">64H", *q) if wide else bytes(q.tolist())))
    out += segment(0xC2, struct.pack(">BHHB", 8, h, w, len(sampling)) + b"".join(bytes([10 + i, x << 4 | y, i]) for i, (x, y) in enumerate(sampling)))
    for kind, table in ((0, DC), (16, AC)):
        out += segment(0xC4, bytes([kind]) + bytes(len(table.get(n, [])) for n in range(1, 17)) + bytes(sum((table.get(n, []) for n in range(1, 17)), [])))
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))

    def sos(comps, ss, se, ah, al, s):
        s.close()
        return segment(0xDA, bytes([len(comps)]) + b"".join(bytes([10 + c, 0]) for c in comps) + bytes([ss, se, ah << 4 | al])) + s.out

    def mcus():
        if len(sampling) == 1:
            bw, bh = sizes[0]
            yield from ([(0, y, x)] for y in range(bh) for x in range(bw))
        else:
            for y in range(my):
                for x in range(mx):
                    yield [(i, y * sv + j, x * sh + k) for i, (sh, sv) in enumerate(sampling) for j in range(sv) for k in range(sh)]

    every = list(range(len(sampling)))
    for al in range(high, -1, -1):
        s, last = Scan(restart), {}
        for mcu in mcus():
            if s.mcu():
                last = {}
            for i, y, x in mcu:
                v = int(coefs[i][y, x, 0]) >> al
                if al == high:
                    n, b = signed(v - last.get(i, 0))
                    s.bits += s.dc[n] + b
                    last[i] = v
                else:
                    s.bits += str(v & 1)
        out += sos(every, 0, 0, 0 if al == high else al + 1, al, s)
        for i in every:
            for ss, se in ((1, 5), (6, 63)):
                s = Scan(restart)
                for y in range(sizes[i][1]):
                    for x in range(sizes[i][0]):
                        s.mcu()
                        (ac_first if al == high else ac_refine)(s, coefs[i][y, x], ss, se, al)
                out += b"\xff" + sos([i], ss, se, 0 if al == high else al + 1, al, s)  # a fill byte before the marker
    if len(sampling) == 1:
        coefs[0][sizes[0][1] :] = coefs[0][:, sizes[0][0] :] = 0
    return out + b"\xff\xd9", coefs, quants


def picture(coefs, quants, sampling, w, h, as_rgb=False):
    """By the formulas, in floats."""
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    planes = []
    for c, q, (sh, sv) in zip(coefs, quants, sampling, strict=True):
        square = np.zeros((*c.shape[:2], 64))
        square[:, :, jpeg.ZIGZAG] = c * q
        s = np.einsum("abvu,vy,ux->aybx", square.reshape(*c.shape[:2], 8, 8), basis, basis).reshape(c.shape[0] * 8, -1)
        s = np.clip(np.floor(s + 0.5) + 128, 0, 255)
        planes.append(s[np.arange(h)[:, None] * sv // vm, np.arange(w)[None, :] * sh // hm])
    if len(planes) == 1:
        return np.stack(planes * 3, axis=2)
    if as_rgb:
        return np.stack(planes, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)


GREY, FULL, WIDE, TALL, QUARTER = [(1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)]


@pytest.mark.parametrize("restart", [0, 1, 5])
@pytest.mark.parametrize("sampling", [GREY, [(2, 2)], FULL, WIDE, TALL, QUARTER])
@pytest.mark.parametrize("high", [0, 1, 3])
def test_foreign_scans(sampling, restart, high):
    w, h = 61, 43
    wide = high == 1
    file, coefs, quants = made(high * 10 + restart, w, h, sampling, restart, high, wide)
    got, images, first = jpeg.coefficients([file])
    for c, at in zip(coefs, first[0], strict=True):
        assert np.array_equal(got[at : at + c.shape[0] * c.shape[1]].reshape(c.shape), c)
    assert all(np.array_equal(a, b) for a, b in zip(images[0].quant, quants, strict=True))
    made_of = jpeg.rgb(got, images[0], first[0])
    off = np.abs(made_of - picture(coefs, quants, sampling, w, h))
    assert made_of.shape == (h, w, 3) and off.max() < 1.772 + 1 and off.mean() < 0.5  # a sample of .5 may fall either way


def test_files_of_all_kinds_together():
    files = [made(i, 20 + i, 17, s, r, 1, False)[0] for i, (s, r) in enumerate([(GREY, 0), (QUARTER, 2), (FULL, 0), (QUARTER, 0)])]
    for alone, got in zip([jpeg.decode([f])[0] for f in files], jpeg.decode(files), strict=True):
        assert np.array_equal(alone, got)


def test_adobe_marker_says_rgb():
    file, coefs, quants = made(3, 24, 16, FULL, 0, 1, False, segment(0xEE, b"Adobe\0\x64\0\0\0\0\0"))
    assert np.abs(jpeg.decode([file])[0] - picture(coefs, quants, FULL, 24, 16, as_rgb=True)).max() <= 1


def test_what_is_not_decoded(spark):
    """Four components, sampling that does not divide, cut files and baseline ones give null; their neighbours stay."""
    good = made(1, 24, 16, QUARTER, 0, 1, False)[0]
    four = made(1, 16, 16, [(1, 1)] * 4, 0, 1, False)[0]
    odd = made(1, 48, 16, [(3, 1), (2, 1), (1, 1)], 0, 1, False)[0]
    rows = [(1, good), (2, four), (3, odd), (4, good[: len(good) // 2]), (5, good.replace(b"\xff\xc2", b"\xff\xc0")), (6, b""), (None, good)]
    got = op4_media.decode_media(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    assert {r.id: r.width for r in got} == {1: 24, 2: None, 3: None, 4: None, 5: None, 6: None, None: 24}
