"""TIFF files: directories of either byte order, and pictures in strips or tiles of 8 or 16 bits.

Also what other formats borrow from TIFF: the orientation in a photograph's Exif block, and the directories by which camera
files are told apart. Packed strips may be raw, zlib, LZW or run lengths, with or without differences of neighbours.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Tags, and the size of a value by its type.
WIDTH, HEIGHT, BITS, PACKING, INK, STRIPS, TURN, SAMPLES, ROWS, COUNTS, PLANAR, DIFFERENCES = 256, 257, 258, 259, 262, 273, 274, 277, 278, 279, 284, 317
COLOURS, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, SUBFILES, EXTRA, FORMAT, PROFILE = 320, 322, 323, 324, 325, 330, 338, 339, 34675
MAKER, MODEL, DNG_VERSION, CR2_SLICES = 271, 272, 50706, 50752
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 13: "I"}
_MOST_DIRECTORIES = 64


class BadTiff(ValueError):
    """A file that is broken or ends early."""


class OtherTiff(ValueError):
    """A kind of TIFF that is not read here."""


Directory = dict[int, tuple]


def order_of(data: bytes) -> str:
    mark = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if mark is None:
        raise BadTiff("not a TIFF")
    return mark


def directory(data: bytes, at: int) -> tuple[Directory, int]:
    """The tags of the directory at a place, each as a tuple of numbers or bytes, and the place of the next."""
    mark = order_of(data)
    if at < 8 or at + 2 > len(data):
        raise BadTiff("a directory beyond the end")
    count = struct.unpack_from(mark + "H", data, at)[0]
    if at + 6 + 12 * count > len(data):
        raise BadTiff("a directory beyond the end")
    out: Directory = {}
    for k in range(count):
        tag, kind, many = struct.unpack_from(mark + "HHI", data, at + 2 + 12 * k)
        if kind not in _KINDS:
            continue
        form = f"{mark}{many}{_KINDS[kind]}"
        size = struct.calcsize(f"{mark}{_KINDS[kind]}") * many
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(mark + "I", data, at + 10 + 12 * k)[0]
        if place + size > len(data):
            continue  # a value beyond the end is as good as none
        out[tag] = struct.unpack_from(form, data, place)
    return out, struct.unpack_from(mark + "I", data, at + 2 + 12 * count)[0]


def directories(data: bytes) -> list[Directory]:
    """All directories in a row, and those that they point to."""
    out, todo, seen = [], [struct.unpack_from(order_of(data) + "I", data, 4)[0]] if len(data) >= 8 else [], set()
    while todo and len(out) < _MOST_DIRECTORIES:
        at = todo.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        try:
            tags, following = directory(data, at)
        except BadTiff:
            if not out:
                raise
            continue
        out.append(tags)
        todo += [following, *(x for x in tags.get(SUBFILES, ()) if isinstance(x, int))]
    return out


def orientation(exif: bytes | None) -> int:
    """1 to 8 from an Exif block; 1 if it says nothing that can be read."""
    try:
        turn = directories(exif or b"")[0].get(TURN, (1,))[0]
    except (BadTiff, struct.error, IndexError):
        return 1
    return turn if turn in range(1, 9) else 1


def turned(values: np.ndarray, turn: int) -> np.ndarray:
    """Rows and columns as a viewer sees them."""
    if turn >= 5:
        values = values.swapaxes(0, 1)
    if turn in (3, 4, 7, 8):
        values = values[::-1]
    if turn in (2, 3, 6, 7):
        values = values[:, ::-1]
    return values


def run_lengths(raw: bytes) -> bytes:
    """Unpacks byte runs: a count and what it counts, copied or repeated."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw(raw: bytes) -> bytes:
    """Unpacks LZW with the highest bits first, code width growing one code early."""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, bits, last, out = list(start), 9, 0, 0, b"", []
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, b""
            continue
        if not last:
            word = table[code]
        else:
            if code > len(table):
                raise BadTiff("a code before its time")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        last = word
        out.append(word)
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


_UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: run_lengths}


def _one(tags: Directory, tag: int, default: int | None = None) -> int:
    value = tags.get(tag, (default,))[0]
    if value is None:
        raise BadTiff(f"tag {tag} is missing")
    return value


def size(data: bytes) -> tuple[int, int]:
    tags = directories(data)[0]
    return _one(tags, WIDTH), _one(tags, HEIGHT)


def decode(data: bytes) -> tuple[np.ndarray, Directory]:
    """The first picture's values (h, w, channels) in 0..1 and its tags; palettes are looked up, ink (CMYK) is left as ink."""
    mark, tags = order_of(data), directories(data)[0]
    w, h, samples, ink, packing = _one(tags, WIDTH), _one(tags, HEIGHT), _one(tags, SAMPLES, 1), _one(tags, INK), _one(tags, PACKING, 1)
    bits = set(tags.get(BITS, (1,)))
    if bits not in ({8}, {16}) or packing not in _UNPACK or set(tags.get(FORMAT, (1,))) != {1} or ink not in (0, 1, 2, 3, 5):
        raise OtherTiff(f"TIFF of {min(bits)} bits, packing {packing}, ink {ink}")
    deep, apart = bits == {16}, _one(tags, PLANAR, 1) == 2 and samples > 1
    inner, planes = (1, samples) if apart else (samples, 1)
    tiled = TILES in tags
    tw, th = (_one(tags, TILE_WIDTH), _one(tags, TILE_HEIGHT)) if tiled else (w, min(h, _one(tags, ROWS, h)))
    starts, counts = (tags.get(t, ()) for t in ((TILES, TILE_COUNTS) if tiled else (STRIPS, COUNTS)))
    across, down = -(-w // max(tw, 1)), -(-h // max(th, 1))
    if len(starts) < across * down * planes or len(counts) < len(starts) or not w or not h:
        raise BadTiff("fewer strips than the picture has")
    values = np.zeros((h, w, samples), np.uint16 if deep else np.uint8)
    for k in range(across * down * planes):
        plane, row, column = k // (across * down), k // across % down, k % across
        rows = th if tiled else min(th, h - row * th)
        need = rows * tw * inner * (2 if deep else 1)
        if starts[k] + counts[k] > len(data):
            raise BadTiff("a strip beyond the end")
        raw = _UNPACK[packing](data[starts[k] : starts[k] + counts[k]])
        if len(raw) < need:
            raise BadTiff("a strip that ends early")
        part = np.frombuffer(raw, f"{mark}u2" if deep else "u1", rows * tw * inner).reshape(rows, tw, inner)
        if _one(tags, DIFFERENCES, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=values.dtype)
        y, x = row * th, column * tw
        target = values[y : y + rows, x : x + tw, plane : plane + inner]
        target[:] = part[: target.shape[0], : target.shape[1]]
    top = 65535.0 if deep else 255.0
    if ink == 3:
        palette = np.array(tags.get(COLOURS, ())).reshape(3, -1).T / 65535.0
        return palette[values[..., 0]], tags
    out = values / top
    return (1 - out if ink == 0 else out), tags
