"""Lossless WebP files to and from arrays, with numpy.

Written are colours with alpha: the difference of red and blue from green, predictions from neighbours chosen a block,
a cache of recent colours and prefix codes. Read is every lossless file: those, back references, groups of codes by
place, colour transforms and palettes. Lossy files are refused by name.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

from .jpeg import code_lengths, codes, in_order

# Symbols for lengths of back references and for distances, the order of code lengths, the hash of the colour cache.
LENGTHS, DISTANCES, ORDER, HASH = 24, 40, (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15), 0x1E35A7BD
#: Neighbours by number, the nearest first: how far to the left and up.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
#: What the writer uses: blocks of 2^BLOCK pixels, a cache of 2^CACHE colours, predictions by number.
BLOCK, CACHE, TRIED = 4, 8, (1, 2, 7, 11, 12)
_OPAQUE = np.array([0, 0, 0, 255])


class BadWebp(ValueError):
    """A file that is broken or ends early."""


class OtherWebp(ValueError):
    """A kind of WebP that is not read here."""


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The file's chunks by kind."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadWebp("not a WebP")
    out, at = {}, 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > len(data):
            raise BadWebp("the file ends early")
        out.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def _stream(held: dict[bytes, bytes]) -> bytes:
    if b"VP8L" not in held:
        raise OtherWebp("lossy or animated WebP") if held.keys() & {b"VP8 ", b"ANIM"} else BadWebp("no picture in the file")
    if held[b"VP8L"][:1] != b"\x2f" or len(held[b"VP8L"]) < 5:
        raise BadWebp("no lossless picture")
    return held[b"VP8L"]


def size(data: bytes) -> tuple[int, int]:
    head = int.from_bytes(_stream(chunks(data))[1:5], "little")
    return (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1


# -- predictions, which both sides need -----------------------------------------------------------


def _half(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    """Left or top, whichever is nearer to left + top - corner over all four values."""
    nearer = np.abs(top - corner).sum(axis=-1, keepdims=True) < np.abs(left - corner).sum(axis=-1, keepdims=True)
    return np.where(nearer, left, top)


def _towards_zero(a):
    return np.where(a < 0, -(-a >> 1), a >> 1)


def predicted(mode: int, left, top, corner, right):
    """The prediction of a mode from the neighbours left, above, above left and above right, for arrays of four values."""
    match mode:
        case 0 | 14 | 15:
            return np.broadcast_to(_OPAQUE, left.shape)
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _half(_half(left, right), top)
        case 6:
            return _half(left, corner)
        case 7:
            return _half(left, top)
        case 8:
            return _half(corner, top)
        case 9:
            return _half(top, right)
        case 10:
            return _half(_half(left, corner), _half(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case _:
            mean = _half(left, top)
            return np.clip(mean + _towards_zero(mean - corner), 0, 255)


# -- writing --------------------------------------------------------------------------------------


class _Writer:
    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: tuple[list[int], list[int]] = [], []

    def put(self, value, size) -> None:
        """Arrays of values and sizes, or a few of either; one size holds for all."""
        if not isinstance(value, np.ndarray):
            value = value if isinstance(value, list) else [value]
            self.few[0].extend(value)
            self.few[1].extend(size if isinstance(size, list) else [size] * len(value))
            return
        self._flush()
        self.values.append(value)
        self.sizes.append(size)

    def _flush(self) -> None:
        for held, few in zip((self.values, self.sizes), self.few, strict=True):
            held.append(np.array(few, np.int64))
            few.clear()

    def bytes(self) -> bytes:
        self._flush()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        up = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.packbits((values[owner] >> up & 1).astype(np.uint8), bitorder="little").tobytes()


#: 16 bits with the first one last.
_TURNED = np.sum([(np.arange(1 << 16) >> k & 1) << (15 - k) for k in range(16)], axis=0)


def _reversed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Codes with their first bit lowest."""
    return _TURNED[values] >> (16 - sizes)


def _put_code(out: _Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for such counts; its lengths and codes."""
    used = np.flatnonzero(counts)
    if len(used) <= 1 and (used < 256).all():
        symbol = int(used[0]) if len(used) else 0
        out.put([1, 0, 1, symbol], [1, 1, 1, 8])
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(used) == 1:
        counts = counts.copy()
        counts[0] += 1
    lengths = code_lengths(counts, 15)
    tokens, at, small = [], 0, [0] * 19  # a token's kind, and above it what follows it
    used = np.flatnonzero(lengths)
    for symbol, length in zip([*used.tolist(), len(lengths)], [*lengths[used].tolist(), 0], strict=True):
        while at < symbol:  # zeros before it
            run = min(138, symbol - at)
            at += run
            tokens += [0] * run if run < 3 else [17 | run - 3 << 5] if run < 11 else [18 | run - 11 << 5]
        if length:
            tokens.append(length)
            at += 1
    for token in tokens:
        small[token & 31] += 1
    if sum(n > 0 for n in small) == 1:
        small[0 if small[0] == 0 else 1] += 1
    widths = code_lengths(np.array(small), 7)
    words, widths = _reversed(codes(widths), widths).tolist(), widths.tolist()
    many = max(4, 1 + max(k for k, s in enumerate(ORDER) if widths[s]))
    out.put([0, many - 4], [1, 4])
    out.put([widths[s] for s in ORDER[:many]], 3)
    out.put(0, 1)
    out.put([words[t] if t < 17 else words[t & 31] | t >> 5 << widths[t & 31] for t in tokens], [widths[t] if t < 17 else widths[t & 31] + (3 if t & 31 == 17 else 7) for t in tokens])
    return lengths, _reversed(codes(lengths), lengths)


def _put_image(out: _Writer, pixels: np.ndarray, cache: int, top: bool) -> None:
    """Pixels (n, 4: red, green, blue, alpha) as literals and cached colours."""
    out.put([1, cache] if cache else [0], [1, 4] if cache else [1])
    if top:
        out.put(0, 1)  # one group of codes for the whole picture
    flat = pixels.astype(np.int64)
    hit, slot = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64)
    if cache:
        word = flat[:, 3] << 24 | flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2]
        slot = (word * HASH & 0xFFFFFFFF) >> (32 - cache)
        order = np.argsort(slot, kind="stable")
        again = (slot[order][1:] == slot[order][:-1]) & (word[order][1:] == word[order][:-1])
        hit[order[1:]] = again
    green = np.where(hit, 256 + LENGTHS + slot, flat[:, 1])
    literal = ~hit
    value, size = np.zeros((len(flat), 4), np.int64), np.zeros((len(flat), 4), np.int64)
    sources = [(green, np.ones(len(flat), bool), 256 + LENGTHS + (1 << cache if cache else 0)), *((flat[:, c], literal, 256) for c in (0, 2, 3))]
    for k, (symbols, some, alphabet) in enumerate(sources):
        lengths, words = _put_code(out, np.bincount(symbols[some], minlength=alphabet))
        value[some, k], size[some, k] = words[symbols[some]], lengths[symbols[some]]
    _put_code(out, np.zeros(DISTANCES, int))
    out.put(value.reshape(-1), size.reshape(-1))


def _neighbours(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, above, above left and above right of every pixel of pictures (n, h, w, 4); beyond the right edge the next row begins."""
    n, h, w, _ = p.shape
    padded = np.zeros((n, h * w + w + 1, 4), p.dtype)
    padded[:, w + 1 :] = p.reshape(n, -1, 4)
    shift = lambda k: padded[:, w + 1 - k : w + 1 - k + h * w].reshape(p.shape)
    return shift(1), shift(w), shift(w + 1), shift(w - 1) if w > 1 else p * 0


def encode(pixels: np.ndarray, profile: bytes | None = None) -> bytes:
    """uint8 (h, w, 3 or 4) to a lossless WebP."""
    return all_encoded(pixels[None], profile)[0]


def all_encoded(pixels: np.ndarray, profile: bytes | None = None) -> list[bytes]:
    """`encode` for pictures of one size, (n, h, w, 3 or 4)."""
    n, h, w, channels = pixels.shape
    if max(h, w) > 1 << 14:
        raise OtherWebp("WebP holds at most 16384 pixels a side")
    p = np.full((n, h, w, 4), 255, np.int16)
    p[..., :channels] = pixels
    p[..., 0], p[..., 2] = (p[..., 0] - p[..., 1]) & 255, (p[..., 2] - p[..., 1]) & 255
    left, top, corner, right = _neighbours(p)
    rest = [(p - predicted(mode, left, top, corner, right)) & 255 for mode in TRIED]
    rows, columns = -(-h >> BLOCK), -(-w >> BLOCK)

    def a_block(field: np.ndarray) -> np.ndarray:
        full = np.zeros((n, rows << BLOCK, columns << BLOCK), np.int64)
        full[:, :h, :w] = field
        return full.reshape(n, rows, 1 << BLOCK, columns, 1 << BLOCK).sum(axis=(2, 4))

    best = np.argmin([a_block(np.minimum(r, 256 - r).sum(axis=3)) for r in rest], axis=0)
    fine = best.repeat(1 << BLOCK, axis=1).repeat(1 << BLOCK, axis=2)[:, :h, :w]
    residual = np.choose(fine[..., None], rest)
    residual[:, 0, 1:], residual[:, 1:, 0], residual[:, 0, 0] = (p - left)[:, 0, 1:] & 255, (p - top)[:, 1:, 0] & 255, (p[:, 0, 0] - _OPAQUE) & 255
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    made = []
    for k in range(n):
        out = _Writer()
        out.put([0x2F, w - 1, h - 1, int(channels == 4), 0], [8, 14, 14, 1, 3])
        out.put([1, 2, 1, 0, BLOCK - 2], [1, 2, 1, 2, 3])  # green taken off, then predictions
        modes = np.zeros((rows * columns, 4), np.int64)
        modes[:, 1], modes[:, 3] = np.array(TRIED)[best[k].reshape(-1)], 255
        _put_image(out, modes, 0, False)
        out.put(0, 1)
        _put_image(out, residual[k].reshape(-1, 4), CACHE, True)
        body = chunk(b"VP8L", out.bytes())
        if profile:
            flags = 0x20 | (0x10 if channels == 4 else 0)
            body = chunk(b"VP8X", bytes([flags, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")) + chunk(b"ICCP", profile) + body
        made.append(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body)
    return made


# -- reading --------------------------------------------------------------------------------------


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end = data + b"\0" * 10, at, 8 * len(data)

    def window(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def take(self, size: int) -> int:
        out = self.window() & ((1 << size) - 1)
        self.at += size
        if self.at > self.end:
            raise BadWebp("the file ends early")
        return out


class _Code:
    """A prefix code as a table over its longest code's bits: symbol and, in the lowest four bits, length."""

    def __init__(self, lengths: np.ndarray, only: int | None = None):
        used = np.flatnonzero(lengths) if only is None else [only]
        if len(used) == 1:
            self.mask, self.array = 0, np.array([int(used[0]) << 4])
            return
        if not len(used) or (2.0 ** -lengths[used]).sum() != 1:
            raise BadWebp("a code that leaves gaps")
        most = int(lengths.max())
        order = in_order(lengths)
        table = np.repeat(order << 4 | lengths[order], 1 << (most - lengths[order]))
        self.mask, self.array = (1 << most) - 1, table[_TURNED[: 1 << most] >> (16 - most)]

    @cached_property
    def table(self) -> list[int]:
        return self.array.tolist()

    def take(self, bits: _Reader) -> int:
        found = self.table[bits.window() & self.mask]
        bits.at += found & 15
        return found >> 4


def _read_code(bits: _Reader, alphabet: int) -> _Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1)] + ([bits.take(8)] if two else [])
        if max(symbols) >= alphabet:
            raise BadWebp("a symbol beyond the alphabet")
        if len(set(symbols)) == 1:
            return _Code(lengths, symbols[0])
        lengths[symbols] = 1
        return _Code(lengths)
    small = np.zeros(19, np.int64)
    many = 4 + bits.take(4)
    widths = bits.take(3 * many)
    small[list(ORDER[:many])] = [widths >> 3 * k & 7 for k in range(many)]
    code = _Code(small)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    at, last, found = 0, 8, []
    table, mask, data, place, integer = code.table, code.mask, bits.data, bits.at, int.from_bytes
    while at < alphabet and left:
        left -= 1
        window = integer(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        s = table[window & mask]
        size, s = s & 15, s >> 4
        place += size
        if s < 16:
            if s:
                found.append((at, s))
                last = s
            at += 1
            continue
        extra, least = (2, 3) if s == 16 else (3, 3) if s == 17 else (7, 11)
        many = least + (window >> size & ((1 << extra) - 1))
        place += extra
        if at + many > alphabet:
            raise BadWebp("more lengths than symbols")
        if s == 16:
            found += [(k, last) for k in range(at, at + many)]
        at += many
    if place > bits.end:
        raise BadWebp("the file ends early")
    bits.at = place
    if found:
        where, values = zip(*found, strict=True)
        lengths[list(where)] = values
    return _Code(lengths)


def _number(bits: _Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def _read_image(bits: _Reader, w: int, h: int, top: bool) -> np.ndarray:
    """Pixels (h, w, 4: red, green, blue, alpha) before transforms."""
    cache = bits.take(4) if bits.take(1) else 0
    if cache > 11:
        raise BadWebp("a colour cache too large")
    groups, deep = None, 0
    if top and bits.take(1):
        deep = bits.take(3) + 2
        meta = _read_image(bits, -(-w >> deep), -(-h >> deep), False)
        groups = (meta[..., 0].astype(int) << 8 | meta[..., 1]).tolist()
    sizes = (256 + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES)
    many = 1 + max(map(max, groups)) if groups else 1
    every = [[_read_code(bits, n) for n in sizes] for _ in range(many)]
    if groups is None and w * h >= FEW_PIXELS:
        flat = _read_at_once(bits, w * h, every[0], cache)
        if flat is not None:
            return _parted(flat, w, h)
    store, cached, total = [0] * (w * h), [0] * (1 << cache if cache else 0), w * h
    at, shift, unstored = 0, 32 - cache, 0
    green, red, blue, alpha, far = every[0]
    data, place, end, integer = bits.data, bits.at, bits.end, int.from_bytes
    while at < total:
        if groups:
            green, red, blue, alpha, far = every[groups[at // w >> deep][at % w >> deep]]
        window = integer(data[place >> 3 : (place >> 3) + 9], "little") >> (place & 7)  # four codes of at most 15 bits
        found = green.table[window & green.mask]
        s, size = found >> 4, found & 15
        if s < 256:
            window >>= size
            r = red.table[window & red.mask]
            window >>= r & 15
            b = blue.table[window & blue.mask]
            window >>= b & 15
            a = alpha.table[window & alpha.mask]
            place += size + (r & 15) + (b & 15) + (a & 15)
            store[at] = a >> 4 << 24 | r >> 4 << 16 | s << 8 | b >> 4
            at += 1
        elif s < 256 + LENGTHS:
            bits.at = place + size
            length, distance = _number(bits, s - 256), _number(bits, far.take(bits))
            if distance > 120:
                back = distance - 120
            else:
                x, y = NEAR[distance - 1]
                back = max(1, x + y * w)
            if back > at or at + length > total:
                raise BadWebp("a reference out of the picture")
            for k in range(at, at + length):
                store[k] = store[k - back]
            at += length
            place = bits.at
        else:
            place += size
            while unstored < at:
                cached[(store[unstored] * HASH & 0xFFFFFFFF) >> shift] = store[unstored]
                unstored += 1
            store[at] = cached[s - 256 - LENGTHS]
            at += 1
        if place > end:
            raise BadWebp("the file ends early")
    bits.at = place
    return _parted(np.array(store, np.int64), w, h)


def _parted(flat: np.ndarray, w: int, h: int) -> np.ndarray:
    return (flat[:, None] >> np.array([16, 8, 0, 24]) & 255).reshape(h, w, 4)


#: Smaller pictures are read pixel by pixel, larger ones so many bits at a time; a pixel takes fewer than BEYOND.
FEW_PIXELS, STRETCH, BEYOND = 64, 1 << 16, 64


def _read_at_once(bits: _Reader, total: int, code: list[_Code], cache: int) -> np.ndarray | None:
    """So many pixels of literals and cached colours, as numbers: what begins at every bit is looked up at once, then steps are followed from pixel to pixel.

    None, and nothing read, where there are back references or colours that the cache does not hold.
    """
    green, *others = ((c.mask, c.array.astype(np.int32)) for c in code[:4])
    at, parts, done = bits.at, [], 0
    while done < total:
        first, span = at >> 3, min(STRETCH, bits.end - at + 8)
        if span <= 0:
            raise BadWebp("the file ends early")
        raw = np.frombuffer(bits.data[first : first + (span + BEYOND >> 3) + 4].ljust((span + BEYOND >> 3) + 4, b"\0"), np.uint8).astype(np.int32)
        windows = ((raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16)[:, None] >> np.arange(8)).reshape(-1)
        found = green[1][windows[:span] & green[0]]
        place, pixel = np.arange(span) + (found & 15), (found >> 4).astype(np.int64) << 8
        after, shift = place, (16, 0, 24)
        for (mask, table), up in zip(others, shift, strict=True):
            if mask:
                more = table[windows[after] & mask]
                after = after + (more & 15)
                pixel |= (more >> 4).astype(np.int64) << up
            else:
                pixel |= int(table[0] >> 4) << up
        literal = found < 256 << 4
        steps = np.where(literal, after, np.where(found < 256 + LENGTHS << 4, -1, place)).tolist()
        p, path, left = at & 7, [], total - done
        while 0 <= p < span and left:
            path.append(p)
            p = steps[p]
            left -= 1
        if p < 0:
            return None
        path = np.array(path, np.int64)
        parts.append((literal[path], np.where(literal[path], pixel[path], (found[path] >> 4) - 256 - LENGTHS)))
        done, at = total - left, 8 * first + p
        if at > bits.end:
            raise BadWebp("the file ends early")
    literal, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    if cache and not literal.all():  # the last literal before, whose place in the cache it is
        own, hits = np.flatnonzero(literal), np.flatnonzero(~literal)
        keys = ((value[own] * HASH & 0xFFFFFFFF) >> (32 - cache)) * total + own
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        wanted = value[hits] * total + hits
        last = np.searchsorted(keys, wanted) - 1
        if (last < 0).any() or (keys[last] // total != value[hits]).any():
            return None
        value[hits] = value[own[last]]
    bits.at = at
    return value


#: Shorter slants are gone through point by point, with a pixel's four values as one number: 16 bits each.
FEW_POINTS = 256
_LOW, _ONE, _TWO = (sum(v << 16 * k for k in range(4)) for v in (0xFF, 0x100, 0x300))
_SOLID = 255 << 48


def _apart(a: int, b: int) -> int:
    """How far two pixels are apart over all four values."""
    return abs((a & 255) - (b & 255)) + abs((a >> 16 & 255) - (b >> 16 & 255)) + abs((a >> 32 & 255) - (b >> 32 & 255)) + abs((a >> 48) - (b >> 48))


def _clipped(first: int, more: int, less: int) -> int:
    """first + more - less, each value kept in 0..255."""
    out = first + more - less + _ONE
    if out & _TWO == _ONE:
        return out & _LOW
    return sum(min(255, max(0, (out >> k & 1023) - 256)) << k for k in (0, 16, 32, 48))


def _beyond_mean(left: int, top: int, corner: int) -> int:
    """The mean of left and top and half its way from the corner, each value kept in 0..255."""
    mean, out = (left + top) >> 1 & _LOW, 0
    for k in (0, 16, 32, 48):
        m = mean >> k & 255
        way = m - (corner >> k & 255)
        out |= min(255, max(0, m + (-(-way >> 1) if way < 0 else way >> 1))) << k
    return out


#: `predicted` for one pixel.
_POINT = {
    **dict.fromkeys((0, 14, 15), lambda left, top, corner, right: _SOLID),
    1: lambda left, top, corner, right: left,
    2: lambda left, top, corner, right: top,
    3: lambda left, top, corner, right: right,
    4: lambda left, top, corner, right: corner,
    5: lambda left, top, corner, right: (((left + right) >> 1 & _LOW) + top) >> 1 & _LOW,
    6: lambda left, top, corner, right: (left + corner) >> 1 & _LOW,
    7: lambda left, top, corner, right: (left + top) >> 1 & _LOW,
    8: lambda left, top, corner, right: (corner + top) >> 1 & _LOW,
    9: lambda left, top, corner, right: (top + right) >> 1 & _LOW,
    10: lambda left, top, corner, right: (((left + corner) >> 1 & _LOW) + ((top + right) >> 1 & _LOW)) >> 1 & _LOW,
    11: lambda left, top, corner, right: top if left == corner else left if top == corner or _apart(top, corner) < _apart(left, corner) else top,
    12: lambda left, top, corner, right: top if left == corner else left if top == corner else _clipped(left, top, corner),
    13: lambda left, top, corner, right: _beyond_mean(left, top, corner),
}


#: Predictions of pixels whose neighbours to the left, above and above left are alike: as these are.
_EVEN = (1, 2, 4, 6, 7, 8, 11, 12, 13)


def _by_points(p: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """`_unpredicted` behind the first row and column, pixel by pixel; those of one kind that follow one another in a row together."""
    h, w, _ = p.shape
    flat = p.astype("<u2").view("<u8").reshape(-1).tolist()
    for y in range(1, h):
        row, start = kinds[y], y * w
        changes = (np.flatnonzero(row[2:] != row[1:-1]) + 2).tolist()
        left, x0 = flat[start], 1
        for x1 in [*changes, w]:
            if x1 <= x0:
                continue
            kind, begin, end, corner = int(row[x0]), start + x0, start + x1, flat[start + x0 - 1 - w]
            rest, above, out = flat[begin:end], flat[begin - w : end - w], []
            if kind in _EVEN and corner == left and not any(rest) and above.count(left) == len(above):
                out = above  # what is even stays so
            elif kind == 1:
                for value in rest:
                    left = (value + left) & _LOW
                    out.append(left)
            elif kind == 2:
                out = [(value + top) & _LOW for value, top in zip(rest, above, strict=True)]
            elif kind == 7:
                for value, top in zip(rest, above, strict=True):
                    left = (value + ((left + top) >> 1 & _LOW)) & _LOW
                    out.append(left)
            elif kind == 11:
                for value, top in zip(rest, above, strict=True):
                    if left == corner or top != corner and _apart(top, corner) >= _apart(left, corner):
                        left = (value + top) & _LOW
                    else:
                        left = (value + left) & _LOW
                    out.append(left)
                    corner = top
            elif kind == 12:
                for value, top in zip(rest, above, strict=True):
                    if left == corner:
                        left = (value + top) & _LOW
                    elif top == corner:
                        left = (value + left) & _LOW
                    else:
                        sum_ = left + top - corner + _ONE
                        left = (value + (sum_ & _LOW if sum_ & _TWO == _ONE else _clipped(left, top, corner))) & _LOW
                    out.append(left)
                    corner = top
            else:
                guess = _POINT[kind]
                for value, at in zip(rest, range(begin - w, end - w), strict=True):
                    left = (value + guess(left, flat[at], flat[at - 1], flat[at + 1])) & _LOW
                    out.append(left)
            flat[begin:end] = out
            left, x0 = out[-1], x1
    return np.array(flat, "<u8").view("<u2").reshape(h, w, 4).astype(np.int64)


def _unpredicted(p: np.ndarray, modes: np.ndarray, deep: int) -> np.ndarray:
    """Adds predictions back. Pixels on a slant, two to the left for each row down, do not need one another."""
    h, w, _ = p.shape
    out = p.copy()
    out[0, 0] = (out[0, 0] + _OPAQUE) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    out[:, 0] = np.cumsum(out[:, 0], axis=0) & 255
    kinds = (modes[..., 1] & 15).repeat(1 << deep, axis=0).repeat(1 << deep, axis=1)[:h, :w]
    if h * w < FEW_POINTS * (w + 2 * h):
        return _by_points(out, kinds)
    for slant in range(3, w + 2 * h - 2):
        y = np.arange(max(1, -(-(slant - w + 1) // 2)), min(h - 1, (slant - 1) // 2) + 1)
        x = slant - 2 * y
        last = x == w - 1
        left, top, corner, right = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], out[np.where(last, y, y - 1), np.where(last, 0, x + 1)]
        mode, guess = kinds[y, x], np.empty_like(left)
        for m in np.unique(mode):
            mine = mode == m
            guess[mine] = predicted(int(m), left[mine], top[mine], corner[mine], right[mine])
        out[y, x] = (out[y, x] + guess) & 255
    return out


def _signed(v: np.ndarray) -> np.ndarray:
    return np.where(v > 127, v - 256, v)


def _uncoloured(p: np.ndarray, blocks: np.ndarray, deep: int) -> np.ndarray:
    m = _signed(blocks.repeat(1 << deep, axis=0).repeat(1 << deep, axis=1)[: p.shape[0], : p.shape[1]])
    out, green = p.copy(), _signed(p[..., 1])
    out[..., 0] = (p[..., 0] + (m[..., 2] * green >> 5)) & 255
    out[..., 2] = (p[..., 2] + (m[..., 1] * green >> 5) + (m[..., 0] * _signed(out[..., 0]) >> 5)) & 255
    return out


def decode(data: bytes) -> tuple[np.ndarray, bytes | None, bytes | None]:
    """Values (h, w, 3 or 4) in 0..1, the profile and the Exif block, where there are any."""
    held = chunks(data)
    bits = _Reader(_stream(held), 8)
    w, h, clear, version = bits.take(14) + 1, bits.take(14) + 1, bits.take(1), bits.take(3)
    if version:
        raise OtherWebp("a later kind of WebP")
    undo, wide = [], w
    while bits.take(1):
        kind = bits.take(2)
        if kind < 2:
            deep = bits.take(3) + 2
            blocks = _read_image(bits, -(-wide >> deep), -(-h >> deep), False)
            undo.append((lambda p, b=blocks, d=deep: _unpredicted(p, b, d)) if kind == 0 else (lambda p, b=blocks, d=deep: _uncoloured(p, b, d)))
        elif kind == 2:
            undo.append(lambda p: np.stack([(p[..., 0] + p[..., 1]) & 255, p[..., 1], (p[..., 2] + p[..., 1]) & 255, p[..., 3]], axis=2))
        else:
            many = bits.take(8) + 1
            palette = np.cumsum(_read_image(bits, many, 1, False)[0], axis=0) & 255
            pack = 3 if many <= 2 else 2 if many <= 4 else 1 if many <= 16 else 0
            full, wide = wide, -(-wide >> pack)

            def looked_up(p: np.ndarray, palette=palette, pack=pack, full=full) -> np.ndarray:
                table = np.concatenate([palette, np.zeros((256 - len(palette), 4), np.int64)])
                step = 8 >> pack
                index = (p[..., 1][..., None] >> np.arange(0, 8, step)) & ((1 << step) - 1) if pack else p[..., 1][..., None]
                return table[index.reshape(p.shape[0], -1)[:, :full]]

            undo.append(looked_up)
    pixels = _read_image(bits, wide, h, True)
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels[..., : 4 if clear else 3] / 255.0, held.get(b"ICCP"), held.get(b"EXIF", b"").removeprefix(b"Exif\0\0") or None
