"""JPEG files to and from arrays, with numpy: sequential Huffman files of 8 bits, any subsampling, restarts.

Writing: colours to luminance and two differences, none of them thinned out, cosine transform of 8 by 8 blocks, the usual
quantisation scaled by quality, and Huffman codes made for the picture. Reading: the symbol and step at every bit
position of a stretch of the scan are looked up at once, so that decoding follows steps from symbol to symbol and
takes all values out together. Progressive, lossless and arithmetic files are refused by name.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np

# The quantisation of luminance and of colour at quality 50, row by row.
LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
COLOUR = np.array([
    [17, 18, 24, 47, 99, 99, 99, 99], [18, 21, 26, 66, 99, 99, 99, 99], [24, 26, 56, 99, 99, 99, 99, 99], [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99],
])
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
FROM_YCC = np.linalg.inv(TO_YCC)
_AT = [(k // 8, k % 8) for k in range(64)]
#: Places of a block along its diagonals, up and down in turn.
ZIGZAG = np.array([8 * y + x for y, x in sorted(_AT, key=lambda p: (sum(p), p[0] if sum(p) % 2 else -p[0]))])
_K = np.arange(8)
DCT = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
#: How many bytes of a scan are looked at together, and the most that a group of blocks can take.
STRETCH, GROUP = 1 << 18, 1 << 13


class BadJpeg(ValueError):
    """A file that is broken or ends early."""


class OtherJpeg(ValueError):
    """A kind of JPEG that is not read here."""


# -- writing --------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = 16) -> np.ndarray:
    """Lengths of an optimal prefix code of at most so many bits: the two rarest are joined again and again; if that is too deep, packages of the rarest."""
    used = np.flatnonzero(counts)
    weights = counts[used]
    order = np.argsort(weights, kind="stable").tolist()
    weights, n = weights.tolist(), len(order)
    single, joints = [weights[k] for k in order] + [math.inf], []
    above_single, above_joint = [0] * n, [0] * n
    leaf = inner = 0  # joints are made from the rarest on, so both rows are in order; a symbol goes before a joint as rare
    for joint in range(n - 1):
        if inner == joint or single[leaf] <= joints[inner]:
            both, above_single[leaf] = single[leaf], joint
            leaf += 1
        else:
            both, above_joint[inner] = joints[inner], joint
            inner += 1
        if inner == joint or single[leaf] <= joints[inner]:
            both += single[leaf]
            above_single[leaf] = joint
            leaf += 1
        else:
            both += joints[inner]
            above_joint[inner] = joint
            inner += 1
        joints.append(both)
    deep = [0] * n
    for k in range(n - 3, -1, -1):
        deep[k] = deep[above_joint[k]] + 1
    out = np.zeros(len(counts), int)
    depth = [deep[k] + 1 for k in above_single] if n > 1 else [0] * n
    if max(depth, default=0) <= most:
        out[used[order]] = depth
        return out
    used = used.tolist()
    level = single = sorted((int(counts[s]), [s]) for s in used)
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = sorted(single + pairs, key=lambda x: x[0])
    for _, members in level[: 2 * len(used) - 2]:
        for s in members:
            out[s] += 1
    return out


def in_order(lengths: np.ndarray) -> np.ndarray:
    """The symbols with a code, shorter codes first, then by symbol."""
    used = np.flatnonzero(lengths)
    return used[np.argsort(lengths[used], kind="stable")]


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, then by symbol."""
    out, order = np.zeros(len(lengths), np.int64), in_order(lengths)
    if len(order):
        spare = lengths[order[-1]] - lengths[order]
        room = np.int64(1) << spare
        out[order] = (np.cumsum(room) - room) >> spare
    return out


def _huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Lengths and codes for 256 symbols that come so often, and the table as a file holds it; no code is all ones."""
    lengths = code_lengths(np.append(counts * 2, 1))  # the last takes the code that may not be used
    values = codes(lengths)
    order = in_order(lengths[:256])
    table = bytes(np.bincount(lengths[order], minlength=17)[1:].tolist()) + bytes(order.tolist())
    return lengths[:256], values[:256], table


def _sizes(values: np.ndarray) -> np.ndarray:
    """How many bits each value's magnitude takes."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of so many bits each, end to end, filled up with ones; FF is followed by 00."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    owner = np.repeat(np.arange(len(sizes)), sizes)
    down = ends[owner] - 1 - np.arange(total)
    bits = (values[owner] >> down & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-total % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\0")


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of zigzag blocks (n, 64), differences in place 0: symbols, extra values and (block, place) order keys."""
    n = len(blocks)
    block, place = np.nonzero(blocks[:, 1:])
    place += 1
    first = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    run = place - np.where(first, 0, np.concatenate([[0], place[:-1]])) - 1
    value = blocks[block, place]
    key = block * 1000 + place * 8
    long = run // 16  # each 16 zeros are a symbol of their own, before the value's
    zeros = np.repeat(np.arange(len(block)), long)
    nth = np.arange(len(zeros)) - np.repeat(np.cumsum(long) - long, long)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, place)
    ends = np.flatnonzero(last < 63)
    dc = blocks[:, 0]
    symbol = np.concatenate([_sizes(dc), np.full(len(zeros), 0xF0), (run % 16) * 16 + _sizes(value), np.zeros(len(ends), np.int64)])
    extra = np.concatenate([dc, np.zeros(len(zeros), np.int64), value, np.zeros(len(ends), np.int64)])
    keys = np.concatenate([np.arange(n) * 1000, key[zeros] - 4 + nth, key, ends * 1000 + 999])
    return symbol, extra, keys


def encode(pixels: np.ndarray, quality: int = 92, profile: bytes | None = None) -> bytes:
    """uint8 (h, w, 3 or 1) to a JPEG."""
    return all_encoded(pixels[None], quality, profile)[0]


def all_encoded(pixels: np.ndarray, quality: int = 92, profile: bytes | None = None) -> list[bytes]:
    """`encode` for pictures of one size, (n, h, w, 3 or 1)."""
    n, h, w, channels = pixels.shape
    colour = pixels.astype(float) @ TO_YCC.T if channels == 3 else pixels.astype(float)
    colour[..., 0] -= 128
    if h % 8 or w % 8:
        colour = np.pad(colour, ((0, 0), (0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    down, across = colour.shape[1] // 8, colour.shape[2] // 8
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((t * scale + 50) // 100, 1, 255).astype(int) for t in (LUMINANCE, COLOUR)][: min(channels, 2)]
    parts = []
    for c in range(channels):
        blocks = colour[..., c].reshape(n, down, 8, across, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 8, 8)
        flat = np.rint(DCT @ blocks @ DCT.T / tables[min(c, 1)]).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]
        flat[:, 0] = np.diff(flat[:, 0].reshape(n, -1), prepend=0, axis=1).reshape(-1)
        symbol, extra, key = _symbols(flat)
        parts.append((symbol, extra, (key // 1000 * channels + c) * 1000 + key % 1000, 2 * min(c, 1) + (key % 1000 != 0)))
    symbol, extra, key, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    symbol, extra, kind, owner = symbol[order], extra[order], kind[order], key[order] // (1000 * channels * down * across)
    many = 2 * len(tables)  # codes of a picture: for the first value of blocks and the others, of luminance and of colour
    place = (owner * many + kind) * 256 + symbol
    counts = np.bincount(place, minlength=n * many * 256).reshape(-1, 256)
    made = [_huffman(row) for row in counts]
    value, size = np.empty((len(symbol), 2), np.int64), np.empty((len(symbol), 2), np.int64)
    size[:, 0], value[:, 0] = (np.concatenate([m[k] for m in made])[place] for k in (0, 1))
    size[:, 1] = _sizes(extra)
    value[:, 1] = np.where(extra < 0, extra + (1 << size[:, 1]) - 1, extra)
    segment = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    before = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    pieces = [profile[k : k + 65000] for k in range(0, len(profile), 65000)] if profile else []
    for k, piece in enumerate(pieces):
        before += segment(0xE2, b"ICC_PROFILE\0" + bytes([k + 1, len(pieces)]) + piece)
    before += segment(0xDB, b"".join(bytes([k]) + bytes(t.reshape(64)[ZIGZAG].tolist()) for k, t in enumerate(tables)))
    frame = b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(channels))
    before += segment(0xC0, struct.pack(">BHHB", 8, h, w, channels) + frame)
    scan = segment(0xDA, bytes([channels]) + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(channels)) + b"\0\x3f\0")
    ends = np.searchsorted(owner, np.arange(n + 1)).tolist()
    out = []
    for k in range(n):
        huffman = b"".join(bytes([16 * (j % 2) + j // 2]) + table for j, (_, _, table) in enumerate(made[k * many : (k + 1) * many]))
        own = slice(ends[k], ends[k + 1])
        out.append(before + segment(0xC4, huffman) + scan + _bits(value[own].reshape(-1), size[own].reshape(-1)) + b"\xff\xd9")
    return out


# -- reading --------------------------------------------------------------------------------------


@dataclass
class Head:
    """What stands before the scan."""

    width: int = 0
    height: int = 0
    #: Of each component: id, blocks across and down in a group, quantisation table.
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    restart: int = 0
    exif: bytes | None = None
    profile: bytes | None = None
    adobe: int | None = None
    scans: list[tuple[bytes, int, int]] = field(default_factory=list)


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits the symbol they begin with and its length (0: none)."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    sizes = np.repeat(np.arange(1, 17, dtype=np.uint8), np.frombuffer(counts, np.uint8, 16))
    many = 1 << 16 - sizes.astype(np.int64)
    room = int(many.sum())
    if room > 1 << 16 or len(symbols) < len(sizes):
        raise BadJpeg("a table of too many codes")
    symbol[:room], length[:room] = np.repeat(np.frombuffer(symbols, np.uint8, len(sizes)), many), np.repeat(sizes, many)
    return symbol, length


def head(data: bytes, scans: bool = False) -> Head:
    """Sizes, tables, orientation and profile; and where the scans are."""
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("not a JPEG")
    out, at, profile = Head(), 2, {}
    while data[at : at + 2] != b"\xff\xd9":
        if at + 4 > len(data):
            if scans or not out.width:
                raise BadJpeg("the file ends early")
            return out
        if data[at] != 0xFF:
            raise BadJpeg("no marker where one is due")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise BadJpeg("the file ends early")
        at += 2 + size
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if mark not in (0xC0, 0xC1) or body[0] != 8:
                raise OtherJpeg("progressive, lossless or arithmetic JPEG")
            out.height, out.width, many = struct.unpack_from(">HHB", body, 1)
            out.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(many)]
            if not scans:
                continue
        elif mark == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                out.quantisation[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(float)
                k += 65 + 64 * wide
        elif mark == 0xC4:
            k = 0
            while k < len(body):
                many = sum(body[k + 1 : k + 17])
                out.huffman[body[k]] = _lookup(body[k + 1 : k + 17], body[k + 17 : k + 17 + many])
                k += 17 + many
        elif mark == 0xDD:
            out.restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xE1 and body[:6] == b"Exif\0\0":
            out.exif = body[6:]
        elif mark == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            profile[body[12]] = body[14:]
            out.profile = b"".join(profile[k] for k in sorted(profile))
        elif mark == 0xEE and body[:5] == b"Adobe":
            out.adobe = body[11]
        elif mark == 0xDA:
            if not scans:
                return out
            end = at
            while True:  # to the next marker that is neither filling nor a restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise BadJpeg("the file ends early")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            out.scans.append((body, at, end))
            at = end
    return out


class _Scan:
    """Bits of one piece of a scan: symbols and steps at every position of a stretch, a table at a time."""

    def __init__(self, raw: bytes, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.raw, self.tables, self.size = raw, tables, 8 * len(raw)
        self.base, self.end = 0, -1

    def look(self, at: int) -> None:
        """Make the stretch that begins at a bit the current one."""
        first = at >> 3
        part = np.frombuffer(self.raw[first : first + STRETCH + GROUP + 4] + b"\0\0\0\0", np.uint8).astype(np.uint32)
        three = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        windows = np.stack([three >> (8 - s) & 0xFFFF for s in range(8)], axis=1).reshape(-1)
        self.base, self.end = 8 * first, 8 * (first + STRETCH)
        self.symbols, self.steps = [], []
        for symbol, length in self.tables:
            found, long = symbol[windows], length[windows]
            self.symbols.append(found.tobytes())  # what follows the last bit ends early
            self.steps.append(np.where(long > 0, long + (found & 15), 0).astype(np.uint8).tobytes())


def _coefficients(raw: bytes, groups: int, plan: list[tuple[int, int, int]], tables: list, out: list[np.ndarray], start: int) -> None:
    """Decode so many groups of blocks into out; plan: component, DC and AC table of each block of a group."""
    scan = _Scan(raw, tables)
    bits = np.frombuffer(raw + b"\0" * 8, np.uint8).astype(np.uint64)
    at, previous = 0, [0] * len(out)
    many = [sum(c == k for k, _, _ in plan) for c in range(len(out))]
    done = [start * n for n in many]
    held: list[list[int]] = [[] for _ in out]
    places: list[list[int]] = [[] for _ in out]
    ways = [(c, dc, ac, held[c].append, places[c].append) for c, dc, ac in plan]
    try:
        for _ in range(groups):
            if at >= scan.end:
                scan.look(at)
            base = scan.base
            for c, dc, ac, add, put in ways:
                symbols, steps, p = scan.symbols[ac], scan.steps[ac], at - base
                slot = 64 * done[c]
                add(at)
                put(slot)
                step = scan.steps[dc][p]
                if not step:
                    raise BadJpeg("a code that no table has")
                p += step
                k = 1
                while k < 64:
                    symbol = symbols[p]
                    if symbol & 15:
                        k += symbol >> 4
                        add(p + base)
                        put(slot + k)
                        k += 1
                        p += steps[p]
                        continue
                    step = steps[p]
                    if not step:
                        raise BadJpeg("a code that no table has")
                    p += step
                    if symbol != 0xF0:
                        break
                    k += 16
                at = p + base
                done[c] += 1
            if at > scan.size:
                raise BadJpeg("the scan ends early")
    except IndexError as error:
        raise BadJpeg("the scan ends early") from error

    def taken(p: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Signed values of so many bits behind a code."""
        p = p + skip
        byte = p >> 3
        word = bits[byte] << np.uint64(16) | bits[byte + 1] << np.uint64(8) | bits[byte + 2]
        value = (word >> (24 - (p & 7) - size).astype(np.uint64)).astype(np.int64) & ((1 << size) - 1)
        return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)

    for c, target in enumerate(out):
        if not held[c]:
            continue
        p, place = np.array(held[c]), np.array(places[c])
        if place.max() >= target.size:
            raise BadJpeg("more values than a block has")
        window = ((bits[p >> 3] << np.uint64(16) | bits[(p >> 3) + 1] << np.uint64(8) | bits[(p >> 3) + 2]) >> (8 - (p & 7)).astype(np.uint64)).astype(np.int64) & 0xFFFF
        first = place % 64 == 0
        dc, ac = next((d, a) for k, d, a in plan if k == c)
        symbol = np.where(first, tables[dc][0][window], tables[ac][0][window])
        skip = np.where(first, tables[dc][1][window], tables[ac][1][window]).astype(np.int64)
        value = taken(p, skip, (symbol & 15).astype(np.int64))
        value[first] = np.cumsum(value[first]) + previous[c]
        target[place] = value


def _piece_ends(data: bytes, at: int, end: int) -> list[bytes]:
    """A scan cut at its restart marks, without filling."""
    out, begin = [], at
    while True:
        hit = data.find(b"\xff", at, end)
        if hit < 0:
            return [*out, data[begin:end].replace(b"\xff\0", b"\xff")]
        if 0xD0 <= data[hit + 1] <= 0xD7:
            out.append(data[begin:hit].replace(b"\xff\0", b"\xff"))
            begin = hit + 2
        at = hit + 2


def decode(data: bytes) -> tuple[np.ndarray, Head]:
    """Values (h, w, 1, 3 or 4) in 0..1, and the head with orientation and profile. CMYK comes as ink, 1 being full."""
    found = head(data, True)
    if not found.width or not found.height or not found.scans or not found.components:
        raise BadJpeg("no picture in the file")
    across, down = max(c[1] for c in found.components), max(c[2] for c in found.components)
    wide, high = -(-found.width // (8 * across)), -(-found.height // (8 * down))
    store = [np.zeros(wide * high * h * v * 64) for _, h, v, _ in found.components]
    shapes: list[tuple[int, int] | None] = [None] * len(store)
    for body, at, end in found.scans:
        used = [(next(k for k, c in enumerate(found.components) if c[0] == body[1 + 2 * j]), body[2 + 2 * j]) for j in range(body[0])]
        keys = sorted({t >> 4 for _, t in used}) + sorted({16 + (t & 15) for _, t in used})
        try:
            tables = [found.huffman[k] for k in keys]
        except KeyError as error:
            raise BadJpeg("a table is missing") from error
        if len(used) == 1 and len(store) > 1:  # a component by itself has only its own blocks
            c, t = used[0]
            _, h, v, _ = found.components[c]
            shapes[c] = -(-(-(-found.height * v // down)) // 8), -(-(-(-found.width * h // across)) // 8)
            groups, plan = shapes[c][0] * shapes[c][1], [(c, keys.index(t >> 4), keys.index(16 + (t & 15)))]
        else:
            groups = wide * high
            per = [(1, 1) if len(store) == 1 else found.components[c][1:3] for c, _ in used]
            if len(store) == 1:
                shapes[0] = -(-found.height // 8), -(-found.width // 8)
                groups = shapes[0][0] * shapes[0][1]
                store[0] = np.zeros(groups * 64)
            plan = [(c, keys.index(t >> 4), keys.index(16 + (t & 15))) for (c, t), (h, v) in zip(used, per, strict=True) for _ in range(h * v)]
        begun = 0
        for piece in _piece_ends(data, at, end):
            size = min(found.restart or groups, groups - begun)
            if size > 0:
                _coefficients(piece, size, plan, tables, store, begun)
            begun += size
        if begun < groups:
            raise BadJpeg("the scan ends early")
    planes = []
    for k, (flat, (_, h, v, table)) in enumerate(zip(store, found.components, strict=True)):
        if table not in found.quantisation:
            raise BadJpeg("a table is missing")
        blocks = np.zeros((flat.size // 64, 64))
        blocks[:, ZIGZAG] = flat.reshape(-1, 64) * found.quantisation[table]
        blocks = DCT.T @ blocks.reshape(-1, 8, 8) @ DCT + 128
        if shapes[k]:
            rows, columns = shapes[k]
            plane = blocks[: rows * columns].reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
        else:
            plane = blocks.reshape(high, wide, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(high * v * 8, wide * h * 8)
        plane = plane.repeat(down // v if len(store) > 1 else 1, axis=0).repeat(across // h if len(store) > 1 else 1, axis=1)
        planes.append(plane[: found.height, : found.width])
    values = np.stack(planes, axis=2)
    if len(planes) >= 3 and not (found.adobe == 0 or (len(planes) == 4 and found.adobe is None)):
        values[..., 1:3] -= 128
        values[..., :3] = values[..., :3] @ FROM_YCC.T
    values = np.floor(np.clip(values, 0, 255) + 0.5) / 255
    return 1 - values if len(planes) == 4 and found.adobe is not None else values, found
