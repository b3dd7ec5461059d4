"""Lossless WebP (VP8L): a complete decoder and an encoder, in numpy.

decode() handles all of the format: simple and normal prefix codes, meta
prefix codes, back-references, the colour cache, and the predictor,
cross-colour, subtract-green and colour-indexing transforms. Images in which
only green varies, as literals and back-references, take a vectorised way: the
length of the symbol that would start at every bit is looked up, steps are
doubled three times and only each eighth symbol is walked to; copies are then
made one after another. Predictors that are the same all over an image and take
a pixel's left or upper neighbour are inverted by running sums. QUICK = False
turns both off, which leaves the plain decoder, pixel by pixel.

encode() writes literals under one prefix code a channel, after the transforms
asked for; with cache_bits or copies it also uses the colour cache and
back-references, pixel by pixel. encode_grey() is for bytes: it picks a palette
or a predictor by what each would take and writes runs and repeated lines as
back-references. Pixels are uint32 ARGB arrays of shape (height, width).
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

PREDICTOR, CROSS, GREEN, PALETTE = range(4)
MOST = 1 << 14
#: Fixed by the format: the order in which lengths of the code length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed by the format: (x, y) that the first 120 distance codes stand for.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
ALPHA = 0xFF000000
#: Whether decoding takes the vectorised ways where it can.
QUICK = True
#: Longest code that encode() makes for pixels; the format allows 15.
LONGEST = 12


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        first = self.at >> 3
        value = int.from_bytes(self.raw[first : first + (n + 14 >> 3)], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.raw):
            raise ValueError("the image data end early")
        return value & (1 << n) - 1

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.raw[first : first + (n + 14 >> 3)], "little") >> (self.at & 7) & (1 << n) - 1


def mirrored(depth: int) -> np.ndarray:
    """Each number below 2^depth with its bits in the other order."""
    out = np.zeros(1, np.int64)
    for k in range(depth):
        out = np.concatenate([out, out | 1 << k]) if not k else np.concatenate([out << 1, out << 1 | 1])
    return out


MIRROR = [mirrored(n) for n in range(16)]
MIRROR_LIST = [m.tolist() for m in MIRROR[:13]]


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits lowest first, length)."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        out[s] = (MIRROR_LIST[n][code] if n < 13 else int(MIRROR[n][code]), n)
        code, before = code + 1, n
    return out


class Code:
    """A prefix code for decoding: one table of 2^depth entries; a lone symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        self.used = used
        if not used:
            raise ValueError("a prefix code has no symbol")
        if self.only is not None:
            return
        if sum(1 << 15 - lengths[s] for s in used) != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.depth = max(lengths)
        ranked = sorted((lengths[s], s) for s in used)
        own = np.array(ranked)
        spread = 1 << self.depth - own[:, 0]  # in canonical order, then with the bits mirrored
        self.symbols = np.repeat(own[:, 1], spread)[MIRROR[self.depth]].astype(np.int32)
        self.lengths = np.repeat(own[:, 0], spread)[MIRROR[self.depth]]
        self.quick = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.quick is None:
            self.quick = (self.symbols.tolist(), self.lengths.tolist())
        window = bits.peek(self.depth)
        bits.at += self.quick[1][window]
        return self.quick[0][window]


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of = [0] * 19
    for place in LENGTH_ORDER[: 4 + bits.read(4)]:
        of[place] = bits.read(3)
    most = size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
        if most > size:
            raise ValueError("a prefix code has too many symbols")
    code, s, before = Code(of), 0, 8
    while s < size and most:
        most -= 1
        n = code.read(bits)
        if n < 16:
            lengths[s] = n
            s += 1
            before = n or before
            continue
        again = bits.read((2, 3, 7)[n - 16]) + (3, 3, 11)[n - 16]
        if s + again > size:
            raise ValueError("a repeated code length goes beyond its alphabet")
        if n == 16:
            lengths[s : s + again] = [before] * again
        s += again
    return Code(lengths)


def amount(prefix: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + bits.read(extra) + 1


def halved(n: int, bits: int) -> int:
    return n + (1 << bits) - 1 >> bits


EXTRA_OF = np.array([max(0, p - 2 >> 1) for p in range(40)], np.int64)


def walk(bits: Bits, total: int, width: int, green: Code, far: Code) -> np.ndarray:
    """Green values of `total` pixels, of literals and copies; the reader stands behind them. Segments bound the memory."""
    raw, segment, margin = np.frombuffer(bits.raw, np.uint8), 1 << 13, 12
    out, done = np.empty(total, np.int32), 0
    copies = green.only is None and green.used[-1] >= 256
    while done < total:
        first = bits.at >> 3
        size = min(segment, len(raw) - first)
        if size <= 0:
            raise ValueError("the image data end early")
        part = np.zeros(size + margin + 2, np.int64)
        own = raw[first : first + size + margin + 2]
        part[: len(own)] = own
        stop = 8 * size
        windows = ((part[:-2] | part[1:-1] << 8 | part[2:] << 16)[:, None] >> np.arange(8)).ravel()
        window = windows[:stop] & (1 << green.depth) - 1
        ahead = green.lengths.take(window)
        if copies:  # a copy is its length's extra bits, a distance symbol and that one's extra bits longer
            symbols = green.symbols.take(window)
            some = np.flatnonzero(symbols >= 256)
            place = some + ahead[some]
            place += EXTRA_OF[symbols[some] - 256]
            if far.only is None:
                wide = windows.take(place) & (1 << far.depth) - 1
                place += far.lengths.take(wide) + EXTRA_OF[far.symbols.take(wide)]
            else:
                place += EXTRA_OF[far.only]
            ahead[some] = place - some
        step1 = np.arange(stop + 64)  # places behind the segment lead to themselves
        step1[:stop] += ahead
        step2 = step1.take(step1)
        step4 = step2.take(step2)
        step8 = memoryview(step4.take(step4))
        p, eighths = bits.at - 8 * first, []
        while p < stop:
            eighths.append(p)
            p = step8[p]
        all_p = np.empty((8, len(eighths)), np.int64)
        all_p[0] = eighths
        for k in range(1, 8):
            step1.take(all_p[k - 1], out=all_p[k])
        all_p = all_p.T.ravel()
        all_p = all_p[all_p < stop]
        found = green.symbols.take(window.take(all_p))
        at = 0
        for i in np.flatnonzero(found >= 256).tolist() if copies else ():
            n = min(i - at, total - done)
            out[done : done + n] = found[at : at + n]
            done, at = done + n, at + n
            if done == total:
                break
            bits.at = 8 * first + int(all_p[i]) + int(green.lengths[window[all_p[i]]])
            length = amount(int(found[i]) - 256, bits)
            away = distance(amount(far.read(bits), bits), width)
            if away > done or done + length > total:
                raise ValueError("a back-reference leaves the image")
            out[done : done + length] = out[done - away : done - away + length] if away >= length else np.resize(out[done - away : done], length)
            done, at = done + length, i + 1
        n = min(len(found) - at, total - done)
        out[done : done + n] = found[at : at + n]
        done, at = done + n, at + n
        bits.at = 8 * first + int(step1[all_p[at - 1]])
    if bits.at > 8 * len(raw):
        raise ValueError("the image data end early")
    return out


def distance(value: int, width: int) -> int:
    """Pixels back that a distance value stands for."""
    if value > 120:
        return value - 120
    x, y = NEAR[value - 1]
    return max(1, x + y * width)


def pixels_of(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: flat uint32 ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, tile = None, 0
    n_groups = 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        groups = pixels_of(bits, halved(width, tile), halved(height, tile), False) >> 8 & 0xFFFF
        n_groups = int(groups.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, size) for size in sizes] for _ in range(n_groups)]
    total = width * height
    green, red, blue, alpha, far = codes[0]
    if QUICK and n_groups == 1 and not cache_bits and red.only is not None and blue.only is not None and alpha.only is not None and (green.only is None or green.only < 256):
        rest = alpha.only << 24 | red.only << 16 | blue.only
        if green.only is not None:
            return np.full(total, rest | green.only << 8, np.uint32)
        return walk(bits, total, width, green, far).astype(np.uint32) << np.uint32(8) | np.uint32(rest)
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    cached = 0
    across = halved(width, tile) if groups is not None else 0
    while len(out) < total:
        if groups is not None:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, far = codes[groups[(y >> tile) * across + (x >> tile)]]
        else:
            far = codes[0][4]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length = amount(s - 256, bits)
            away = distance(amount(far.read(bits), bits), width)
            if away > len(out) or len(out) + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-away])
        else:
            while cached < len(out):
                cache[(0x1E35A7BD * out[cached] & 0xFFFFFFFF) >> 32 - cache_bits] = out[cached]
                cached += 1
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


def added(a, b):
    """Sums of each channel modulo 256."""
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def subtracted(a: int, b: int) -> int:
    return sum(((a >> k & 0xFF) - (b >> k & 0xFF) & 0xFF) << k for k in (0, 8, 16, 24))


def average(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def clamped(v: int) -> int:
    return min(255, max(0, v))


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """right is the pixel above and to the right, corner above and to the left."""
    if mode == 0:
        return ALPHA
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return average(average(left, right), top)
    if mode <= 10:
        if mode == 10:
            return average(average(left, corner), average(top, right))
        return average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    channels = [[p >> k & 0xFF for k in (0, 8, 16, 24)] for p in (left, top, corner)]
    if mode == 11:
        to_left = sum(abs(t - c) for _, t, c in zip(*channels, strict=True))
        to_top = sum(abs(a - c) for a, _, c in zip(*channels, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        parts = [clamped(a + t - c) for a, t, c in zip(*channels, strict=True)]
    elif mode == 13:
        parts = [clamped(m + int((m - c) / 2)) for m, c in ((a + t >> 1, c) for a, t, c in zip(*channels, strict=True))]
    else:
        return ALPHA
    return sum(v << 8 * i for i, v in enumerate(parts))


def predict_all(flat: list[int], modes, tile: int, width: int, height: int, forward: bool) -> list[int]:
    """Residuals to pixels, or with forward pixels to residuals."""
    out = [0] * len(flat)
    own = flat if forward else out
    across = halved(width, tile)
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                guess = own[i - 1] if x else ALPHA
            elif not x:
                guess = own[i - width]
            else:
                guess = predicted(int(modes[(y >> tile) * across + (x >> tile)]), own[i - 1], own[i - width], own[i - width + 1], own[i - width - 1])
            out[i] = subtracted(flat[i], guess) if forward else added(flat[i], guess)
    return out


def summed(flat: np.ndarray, mode: int, width: int, height: int, forward: bool) -> np.ndarray:
    """predict_all() for mode 1 (left) or 2 (above) all over an image, by differences or running sums."""
    out = flat.astype("<u4").view(np.uint8).reshape(height, width, 4)
    if forward:
        own = out.copy()
        if mode == 1:
            out[:, 1:] -= own[:, :-1]
            out[1:, 0] -= own[:-1, 0]
        else:
            out[1:] -= own[:-1]
            out[0, 1:] -= own[0, :-1]
        out[:1, :1, 3] -= np.uint8(255)
    else:
        out[:1, :1, 3] += np.uint8(255)
        if mode == 1:
            out[:, 0] = out[:, 0].cumsum(axis=0, dtype=np.uint8)
            out = out.cumsum(axis=1, dtype=np.uint8)
        else:
            out[0] = out[0].cumsum(axis=0, dtype=np.uint8)
            out = out.cumsum(axis=0, dtype=np.uint8)
    return np.ascontiguousarray(out).reshape(-1).view("<u4").astype(np.uint32)


def crossed(flat: np.ndarray, elements: np.ndarray, tile: int, width: int, height: int, forward: bool) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    e = elements[(y >> tile) * halved(width, tile) + (x >> tile)]
    part = lambda v, k: (v >> np.uint32(k) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    r, g, b = part(flat, 16), part(flat, 8), part(flat, 0)
    sign = -1 if forward else 1
    new_r = r + sign * (part(e, 0) * g >> 5)
    red_seen = r if forward else (new_r & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    new_b = b + sign * (part(e, 8) * g >> 5) + sign * (part(e, 16) * red_seen >> 5)
    return flat & np.uint32(0xFF00FF00) | (new_r & 255).astype(np.uint32) << np.uint32(16) | (new_b & 255).astype(np.uint32)


def greened(flat: np.ndarray, sign: int) -> np.ndarray:
    """Green added to (sign 1) or taken from (-1) red and blue."""
    out = flat.astype("<u4").view(np.uint8).reshape(-1, 4)
    other = out[:, 1] if sign > 0 else -out[:, 1]
    out[:, 2] += other
    out[:, 0] += other
    return out.reshape(-1).view("<u4")


def packing(colours: int) -> int:
    """log2 of the indices in a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(raw: bytes) -> np.ndarray:
    """The pixels of one lossless WebP file."""
    if raw[:4] != b"RIFF" or raw[8:16] != b"WEBPVP8L" or raw[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", raw[16:20])[0]
    bits = Bits(raw[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, own = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(s[0] == kind for s in steps):
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS):
            tile = bits.read(3) + 2
            steps.append((kind, tile, own, pixels_of(bits, halved(own, tile), halved(height, tile), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            deltas = pixels_of(bits, n, 1, False)
            table = np.stack([np.cumsum(deltas >> np.uint32(k) & np.uint32(255), dtype=np.uint32) & np.uint32(255) for k in (0, 8, 16, 24)])
            steps.append((kind, packing(n), own, table[0] | table[1] << 8 | table[2] << 16 | table[3] << 24))
            own = halved(own, packing(n))
        else:
            steps.append((kind, 0, own, None))
    flat = pixels_of(bits, own, height, True)
    for kind, tile, across, data in reversed(steps):
        if kind == GREEN:
            flat = greened(flat, 1)
        elif kind == PREDICTOR:
            modes = data >> 8 & 15
            if QUICK and modes[0] in (1, 2) and (modes == modes[0]).all():
                flat = summed(flat, int(modes[0]), across, height, False)
            else:
                flat = np.array(predict_all(flat.tolist(), modes, tile, across, height, False), np.uint32)
        elif kind == CROSS:
            flat = crossed(flat, data, tile, across, height, False)
        else:
            indices = (flat >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
            if tile:
                shifts = np.arange(1 << tile, dtype=np.uint32) * np.uint32(8 >> tile)
                indices = (indices[:, :, None] >> shifts & np.uint32((1 << (8 >> tile)) - 1)).reshape(height, -1)[:, :across]
            full = np.zeros(256, np.uint32)
            full[: len(data)] = data
            flat = full[indices].ravel()
    return flat.reshape(height, width)


class Out:
    """Writes bits, lowest first."""

    def __init__(self):
        self.value = self.n = 0
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def flush(self) -> None:
        raw = np.frombuffer(self.value.to_bytes(self.n + 7 >> 3, "little"), np.uint8)
        self.parts.append(np.unpackbits(raw, bitorder="little")[: self.n])
        self.value = self.n = 0

    def put_bits(self, bits: np.ndarray) -> None:
        self.flush()
        self.parts.append(bits)

    def done(self) -> bytes:
        self.flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def lengths_for(counts: list[int], most: int) -> list[int]:
    """Prefix code lengths of at most `most` bits; a lone symbol gets 1."""
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
    least = 1
    while len(used) > 1:
        heap = [(max(least, counts[s]), i) for i, s in enumerate(used)]
        heapq.heapify(heap)
        above, n = [0] * (2 * len(used)), len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            above[i] = above[j] = n
            heapq.heapreplace(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth[: len(used)]) <= most:
            for i, s in enumerate(used):
                out[s] = depth[i]
            break
        least = 2 * least + max(1, sum(counts) >> most)
    return out


def put_code(out: Out, counts: list[int]) -> dict[int, tuple[int, int]]:
    """Write a prefix code for these counts; symbol -> (bits, length)."""
    used = [s for s, n in enumerate(counts) if n] or [0]
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1
        out.put(int(wide), 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 1:
            return {used[0]: (0, 0)}
        out.put(used[1], 8)
        return {used[0]: (0, 1), used[1]: (1, 1)}
    lengths = lengths_for(counts, LONGEST)
    runs: list[tuple[int, int, int]] = []
    at = 0
    for s in [*(s for s, n in enumerate(lengths) if n), len(lengths)]:
        while (gap := min(s - at, 138)) > 0:
            runs += [(18, gap - 11, 7)] if gap >= 11 else [(17, gap - 3, 3)] if gap >= 3 else [(0, 0, 0)] * gap
            at += gap
        if s < len(lengths):
            runs.append((lengths[s], 0, 0))
            at = s + 1
    kinds = [r[0] for r in runs]
    of = lengths_for([kinds.count(k) for k in range(19)], 7)
    out.put(0, 1)
    stored = max(4, max(i for i, k in enumerate(LENGTH_ORDER) if of[k]) + 1)
    out.put(stored - 4, 4)
    for k in LENGTH_ORDER[:stored]:
        out.put(of[k], 3)
    out.put(0, 1)
    own = canonical(of)
    if len(own) == 1:
        own = {next(iter(own)): (0, 0)}
    for k, extra, n in runs:
        out.put(*own[k])
        out.put(extra, n)
    found = canonical(lengths)
    return {next(iter(found)): (0, 0)} if len(found) == 1 else found


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits' value, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    high = value.bit_length() - 1
    return 2 * high + (value >> high - 1 & 1), value & (1 << high - 1) - 1, high - 1


def tabled(code: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    bits, sizes = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    own = list(code)
    bits[own], sizes[own] = [v for v, _ in code.values()], [n for _, n in code.values()]
    return bits, sizes


def joined(bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits of codes one after another; four codes of up to 16 bits fill a word."""
    fill = -len(bits) % 4
    if fill:
        bits, sizes = np.append(bits, np.zeros(fill, np.uint64)), np.append(sizes, np.zeros(fill, np.uint64))
    b, n = bits.reshape(-1, 4), sizes.reshape(-1, 4)
    first, second = b[:, 0] | b[:, 1] << n[:, 0], b[:, 2] | b[:, 3] << n[:, 2]
    half = n[:, 0] + n[:, 1]
    words, ends = first | second << half, half + n[:, 2] + n[:, 3]
    room = -(-int(ends.max()) // 8)
    raw = words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :room]
    return np.unpackbits(raw, axis=1, bitorder="little")[np.arange(8 * room) < ends[:, None].astype(np.int64)]


#: Shortest copy that encode_grey() makes, longest that the format allows, and the greatest distance value whose extra bits fit a field.
SHORTEST, LONGEST_COPY, FARTHEST = 16, 4096, 1 << 17


def repeats(data: bytes, lines: bool) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs of a byte and, with lines, of lines that came before; ascending, apart."""
    values = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(values)) + 1
    starts, ends = np.concatenate([[0], edge]), np.append(edge, len(values))
    long = ends - starts > SHORTEST
    found = [(a + 1, b - a - 1, 1) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    if lines:
        seen: dict[bytes, int] = {}
        at = 0
        for line in data.split(b"\n"):
            if len(line) >= SHORTEST:
                if (before := seen.get(line)) is not None and at - before + 120 <= FARTHEST:
                    found.append((at, len(line), at - before))
                seen[line] = at
            at += len(line) + 1
        found.sort()
    out, until = [], 0
    for a, n, away in found:
        if a >= until:
            until = a + n
            out += [(x, min(LONGEST_COPY, until - x), away) for x in range(a, until, LONGEST_COPY)]
    return out


def put_grey(out: Out, green: np.ndarray, width: int, copies: list[tuple[int, int, int]], rest: tuple[int, int, int]) -> None:
    """An entropy-coded image in which only green varies, with the copies given; rest: its red, blue and alpha."""
    out.put(0, 1)
    out.put(0, 1)
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width > 0}
    literal = np.ones(len(green), bool)
    coded = []
    for a, n, away in copies:
        literal[a : a + n] = False
        coded.append((prefix_of(n), prefix_of(near.get(away, away + 120))))
    counts, distances = np.bincount(green[literal], minlength=280).tolist(), [0] * 40
    for length, away in coded:
        counts[256 + length[0]] += 1
        distances[away[0]] += 1
    code = put_code(out, counts)
    for value in rest:
        single = [0] * 256
        single[value] = 1
        put_code(out, single)
    far = put_code(out, distances)
    if len(code) == 1:
        return
    table = [np.zeros(280, np.uint64), np.zeros(280, np.uint64)]
    for symbol, (value, n) in code.items():
        table[0][symbol], table[1][symbol] = value, n

    def literals(a: int, b: int) -> None:
        for x in range(a, b, 1 << 16):
            some = green[x : min(b, x + (1 << 16))]
            out.put_bits(joined(table[0][some], table[1][some]))

    at = 0
    for (a, n, _), (length, away) in zip(copies, coded, strict=True):
        if a > at:
            literals(at, a)
        out.put(*code[256 + length[0]])
        out.put(length[1], length[2])
        out.put(*far[away[0]])
        out.put(away[1], away[2])
        at = a + n
    if at < len(green):
        literals(at, len(green))


def entropy(values: np.ndarray) -> float:
    """Bits of all values under the best code of their own frequencies."""
    n = np.bincount(values, minlength=256)
    n = n[n > 0]
    return float(-(n * np.log2(n / n.sum())).sum())


def encode_grey(grey: np.ndarray) -> bytes:
    """A lossless WebP file of bytes (height, width) as grey pixels.

    Up to 16 values are indexed by a palette, several to a pixel. Of others the
    left or upper neighbour is predicted where that takes fewer bits.
    """
    height, width = grey.shape
    if not (0 < width <= MOST and 0 < height <= MOST):
        raise ValueError(f"sides are 1 to {MOST}")
    out = Out()
    for value, n in ((width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        out.put(value, n)
    values = np.flatnonzero(np.bincount(grey.ravel(), minlength=256))
    if len(values) <= 16:
        out.put(1 | PALETTE << 1, 3)
        out.put(len(values) - 1, 8)
        colours = [ALPHA | int(v) * 0x010101 for v in values]
        put_pixels(out, np.array([subtracted(c, b) for b, c in zip([0, *colours], colours)], np.uint32), len(colours), False)  # noqa: B905
        fold = packing(len(values))
        own = halved(width, fold)
        index = np.pad(np.searchsorted(values, grey), ((0, 0), (0, (own << fold) - width))).reshape(height, own, 1 << fold)
        green = (index << np.arange(1 << fold) * (8 >> fold)).sum(axis=2).astype(np.uint8)
        out.put(0, 1)
        put_grey(out, green.ravel(), own, repeats(green.tobytes(), False), (0, 0, 255))
    else:
        left, above = grey.copy(), grey.copy()
        left[:, 1:] -= grey[:, :-1]
        left[1:, 0] -= grey[:-1, 0]
        above[1:] -= grey[:-1]
        above[0, 1:] -= grey[0, :-1]
        cost = [entropy(x.ravel()) for x in (grey, left, above)]
        mode = int(np.argmin(cost))
        green = (grey, left, above)[mode]
        if mode:
            tile = 9  # the largest tiles: the mode is the same everywhere
            out.put(1 | PREDICTOR << 1, 3)
            out.put(tile - 2, 3)
            put_pixels(out, np.full(halved(width, tile) * halved(height, tile), ALPHA | mode << 8, np.uint32), halved(width, tile), False)
        out.put(1 | GREEN << 1, 3)
        out.put(0, 1)
        data = np.ascontiguousarray(green).tobytes()
        put_grey(out, np.frombuffer(data, np.uint8), width, repeats(data, not mode), (0, 0, 0 if mode else 255))
    data = b"\x2f" + out.done()
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def put_pixels(out: Out, flat: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = False) -> None:
    """An entropy-coded image under one group of prefix codes."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    parts = np.ascontiguousarray(flat, "<u4").view(np.uint8).reshape(-1, 4)
    channels = [parts[:, 1], parts[:, 2], parts[:, 0], parts[:, 3]]
    if not cache_bits and not copies:
        fields = []
        for i, c in enumerate(channels):
            size = 256 if i else 280
            if (c == c[0]).all():
                counts = [0] * size
                counts[int(c[0])] = 1
            else:
                counts = np.bincount(c, minlength=size).tolist()
            code = put_code(out, counts)
            if len(code) > 1:
                fields.append((c, *tabled(code)))
        put_code(out, [0] * 40)
        for at in range(0, len(flat), 1 << 16):
            if fields:
                part = [(bits[c[at : at + (1 << 16)]], sizes[c[at : at + (1 << 16)]]) for c, bits, sizes in fields]
                out.put_bits(joined(np.stack([p[0] for p in part], axis=1).ravel(), np.stack([p[1] for p in part], axis=1).ravel()))
        return
    tokens: list[tuple] = []
    cache: dict[int, int] = {}
    seen: dict[tuple[int, ...], int] = {}
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width > 0}
    values, i = flat.tolist(), 0
    while i < len(values):
        length = 0
        if copies and (j := seen.get(tuple(values[i : i + 3]), -1)) >= 0 and i + 3 <= len(values):
            while i + length < len(values) and length < 4096 and values[j + length] == values[i + length]:
                length += 1
        if length >= 3:
            tokens.append(("copy", length, near.get(i - j, i - j + 120)))
        else:
            length = 1
            slot = (0x1E35A7BD * values[i] & 0xFFFFFFFF) >> 32 - cache_bits if cache_bits else -1
            tokens.append(("slot", slot) if cache.get(slot) == values[i] else ("pixel", i))
        for k in range(i, i + length):
            if cache_bits:
                cache[(0x1E35A7BD * values[k] & 0xFFFFFFFF) >> 32 - cache_bits] = values[k]
            seen[tuple(values[k : k + 3])] = k
        i += length
    counts = [[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
    for t in tokens:
        if t[0] == "pixel":
            for k in range(4):
                counts[k][channels[k][t[1]]] += 1
        elif t[0] == "slot":
            counts[0][280 + t[1]] += 1
        else:
            counts[0][256 + prefix_of(t[1])[0]] += 1
            counts[4][prefix_of(t[2])[0]] += 1
    codes = [put_code(out, c) for c in counts]
    for t in tokens:
        if t[0] == "pixel":
            for k in range(4):
                out.put(*codes[k][int(channels[k][t[1]])])
        elif t[0] == "slot":
            out.put(*codes[0][280 + t[1]])
        else:
            for code, value, base in ((codes[0], t[1], 256), (codes[4], t[2], 0)):
                s, extra, n = prefix_of(value)
                out.put(*code[base + s])
                out.put(extra, n)


def encode(pixels: np.ndarray, *, green: bool = False, palette: bool = False, predictor: int | None = None, cross: tuple[int, int, int] | None = None, tile: int = 4, cache_bits: int = 0, copies: bool = False) -> bytes:
    """A lossless WebP file; predictor is a mode, cross is (green_to_red, green_to_blue, red_to_blue) as bytes."""
    height, width = pixels.shape
    if not (0 < width <= MOST and 0 < height <= MOST):
        raise ValueError(f"sides are 1 to {MOST}")
    out, flat, own = Out(), pixels.astype(np.uint32).ravel(), width
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(bool((flat < ALPHA).any())), 1)
    out.put(0, 3)
    if palette:
        colours = np.unique(flat)
        if len(colours) > 256:
            raise ValueError("a palette has up to 256 colours")
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        listed = colours.tolist()
        deltas = np.array([subtracted(c, b) for b, c in zip([0, *listed], listed)], np.uint32)  # noqa: B905
        put_pixels(out, deltas, len(colours), False)
        fold = packing(len(colours))
        index = np.searchsorted(colours, flat).astype(np.uint32).reshape(height, width)
        own = halved(width, fold)
        index = np.pad(index, ((0, 0), (0, (own << fold) - width))).reshape(height, own, 1 << fold)
        shifts = np.arange(1 << fold, dtype=np.uint32) * np.uint32(8 >> fold)
        flat = ((index << shifts).sum(axis=2).astype(np.uint32) << np.uint32(8) | np.uint32(ALPHA)).ravel()
    if predictor is not None:
        out.put(1 | PREDICTOR << 1, 3)
        out.put(tile - 2, 3)
        blocks = halved(own, tile) * halved(height, tile)
        put_pixels(out, np.full(blocks, ALPHA | predictor << 8, np.uint32), halved(own, tile), False)
        flat = np.array(predict_all(flat.tolist(), [predictor] * blocks, tile, own, height, True), np.uint32)
    if cross is not None:
        out.put(1 | CROSS << 1, 3)
        out.put(tile - 2, 3)
        elements = np.full(halved(own, tile) * halved(height, tile), ALPHA | cross[2] << 16 | cross[1] << 8 | cross[0], np.uint32)
        put_pixels(out, elements, halved(own, tile), False)
        flat = crossed(flat, elements, tile, own, height, True)
    if green:
        out.put(1 | GREEN << 1, 3)
        flat = greened(flat, -1)
    out.put(0, 1)
    put_pixels(out, flat, own, True, cache_bits, copies)
    data = b"\x2f" + out.done()
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data
