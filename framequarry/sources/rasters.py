"""Image files to and from arrays, with numpy and the standard library only.

Reads PNG (8 and 16 bits, grey, colour, palette, alpha), BMP (24 and 32 bits), TIFF, sequential JPEG, lossless WebP and a PSD's
merged picture, with orientation and embedded profile; writes those, EPS and layered PSD. Other formats give a typed refusal instead of wrong pixels.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from . import jpeg, profiles, tiff, webp

_TIFF = (b"II*\0", b"MM\0*")


class Unsupported(ValueError):
    """A format or variant that is not read here; `code` is for result rows."""

    code = "unsupported_format"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


@lru_cache(maxsize=16)
def _packed_profile(profile: bytes) -> bytes:
    return b"profile\0\0" + zlib.compress(profile)


def encode_png(pixels: np.ndarray, profile: bytes | None = None, effort: int = 6) -> bytes:
    """uint8 or uint16 (h, w, 1..4) to PNG, with a profile if there is one."""
    h, w, channels = pixels.shape
    deep = pixels.dtype == np.uint16
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    size = channels * pixels.itemsize
    lines = np.zeros((h, 1 + w * size), np.uint8)  # each behind its kind, which is 0
    lines[:, 1:] = (np.ascontiguousarray(pixels, ">u2") if deep else np.ascontiguousarray(pixels)).reshape(h, -1).view(np.uint8)
    body = zlib.compress(lines, effort)
    held = _chunk(b"iCCP", _packed_profile(profile)) if profile else b""
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16 if deep else 8, kind, 0, 0, 0)) + held + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def png_chunk(data: bytes, wanted: bytes) -> bytes | None:
    """The body of a PNG's first chunk of a kind."""
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == wanted:
            return data[at + 8 : at + 8 + size]
        at += size + 12
    return None


def dimensions(data: bytes) -> tuple[int, int]:
    """Width and height from the header alone."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] in _TIFF:
        return tiff.size(data)
    if data[:2] == b"\xff\xd8":
        found = _named(jpeg.head, data)
        return found.width, found.height
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _named(webp.size, data)
    if data[:4] == b"8BPS" and len(data) >= 26:
        return struct.unpack(">II", data[14:22])[::-1]
    raise Unsupported("no dimensions in the first bytes")


def _named(read, data: bytes):
    """Kinds that a reader does not know are refused alike, whatever the format."""
    try:
        return read(data)
    except (jpeg.OtherJpeg, tiff.OtherTiff, webp.OtherWebp) as error:
        raise Unsupported(str(error)) from error


def _unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    lines = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    if not lines[:, 0].any():
        return lines[:, 1:]
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        if kind == 0:
            row = line.copy()
        elif kind == 2:
            row = line + above
        elif kind == 1:
            row = np.zeros(stride, np.uint8)
            for k in range(step):
                row[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        else:
            row, up = bytearray(line.tobytes()), above.tobytes()
            for k in range(stride):
                left, corner = (row[k - step], up[k - step]) if k >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[k]) // 2
                else:
                    p = left + up[k] - corner
                    guess = min((left, up[k], corner), key=lambda v, p=p: abs(p - v))
                row[k] = (row[k] + guess) & 255
            row = np.frombuffer(bytes(row), np.uint8)
        out[y] = above = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """PNG to float (h, w, 1..4) in 0..1, encoded values."""
    return _scaled(png_levels(data))


def _scaled(shown: np.ndarray) -> np.ndarray:
    return shown / (255.0 if shown.dtype == np.uint8 else 65535.0)


def png_levels(data: bytes) -> np.ndarray:
    """PNG to levels of 8 or 16 bits (h, w, 1..4)."""
    at, body, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    if head is None or head[6]:
        raise Unsupported("interlaced or broken PNG")
    w, h, depth, kind = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if depth not in (8, 16):
        raise Unsupported(f"{depth}-bit PNG")
    step = channels * depth // 8
    rows = _unfilter(zlib.decompress(b"".join(body)), h, w * step, step)
    values = rows.reshape(h, w, step) if depth == 8 else rows.reshape(h, w, channels, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if kind == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        values = np.concatenate([palette, alpha[:, None]], axis=1)[values[..., 0]]
    return values


def encode_bmp(pixels: np.ndarray) -> bytes:
    """uint8 (h, w, 3) to 24-bit BMP; BMP carries no alpha."""
    h, w, channels = pixels.shape
    if channels != 3:
        raise Unsupported("BMP carries no alpha")
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    offset, (w, h), (bits, packed) = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), (struct.unpack("<H", data[28:30])[0], struct.unpack("<I", data[30:34])[0])
    if bits not in (24, 32) or packed:
        raise Unsupported(f"{bits}-bit BMP")
    step, rows = bits // 8, abs(h)
    stride = (step * w + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)[:, : step * w].reshape(rows, w, step)[:, :, 2::-1]
    return (body[::-1] if h > 0 else body) / 255.0


def _s15(value: float) -> bytes:
    return struct.pack(">i", round(value * 65536))


def icc_profile(name: str, primaries: tuple[tuple[float, float, float], ...], curve: float | np.ndarray, white: tuple[float, float, float] = (0.9642, 1.0, 0.8249)) -> bytes:
    """A matrix-shaper ICC v2 display profile; its curve is a gamma or samples in 0..1. The same input gives the same bytes."""
    if isinstance(curve, np.ndarray):
        shape = struct.pack(">I", len(curve)) + np.rint(curve * 65535).astype(">u2").tobytes()
    else:
        shape = struct.pack(">IH", 1, round(curve * 256)) + b"\0\0"
    text = name.encode("ascii")
    tags = {
        b"desc": b"desc\0\0\0\0" + struct.pack(">I", len(text) + 1) + text + b"\0" * (1 + 4 + 4 + 2 + 1 + 67),
        b"cprt": b"text\0\0\0\0No copyright\0",
        b"wtpt": b"XYZ \0\0\0\0" + b"".join(map(_s15, white)),
    }
    tags |= {k: b"XYZ \0\0\0\0" + b"".join(map(_s15, xyz)) for k, xyz in zip((b"rXYZ", b"gXYZ", b"bXYZ"), primaries)}
    tags |= dict.fromkeys((b"rTRC", b"gTRC", b"bTRC"), b"curv\0\0\0\0" + shape)
    at, table, body = 128 + 4 + 12 * len(tags), struct.pack(">I", len(tags)), b""
    for key, value in tags.items():
        value += b"\0" * (-len(value) % 4)
        table += key + struct.pack(">II", at + len(body), len(value))
        body += value
    head = struct.pack(">I4sI4s4s4s6H4s4sIIIQI", 128 + len(table) + len(body), b"\0\0\0\0", 0x02100000, b"mntr", b"RGB ", b"XYZ ", 2024, 1, 1, 0, 0, 0, b"acsp", b"\0\0\0\0", 0, 0, 0, 0, 0)
    return (head + b"".join(map(_s15, (0.9642, 1.0, 0.8249)))).ljust(128, b"\0")[:128] + table + body


def encode_tiff16(pixels: np.ndarray, profile: bytes | None = None) -> bytes:
    """uint16 (h, w, 3 or 4) to a zlib-compressed 16-bit TIFF, alpha not multiplied in, with a profile if there is one."""
    h, w, channels = pixels.shape
    strip = zlib.compress(pixels.astype("<u2").tobytes(), 6)
    bits = struct.pack(f"<{channels}H", *[16] * channels)
    begin = 8 + len(bits)
    at = begin + len(strip) + len(strip) % 2
    T = tiff
    tags = [(T.WIDTH, 4, 1, w), (T.HEIGHT, 4, 1, h), (T.BITS, 3, channels, 8), (T.PACKING, 3, 1, 8), (T.INK, 3, 1, 2), (T.STRIPS, 4, 1, begin), (T.SAMPLES, 3, 1, channels), (T.ROWS, 4, 1, h), (T.COUNTS, 4, 1, len(strip)), (T.PLANAR, 3, 1, 1)]
    if channels == 4:
        tags.append((T.EXTRA, 3, 1, 2))
    if profile:
        tags.append((T.PROFILE, 7, len(profile), at))
    body = strip + b"\0" * (len(strip) % 2) + (profile or b"")
    body += b"\0" * (len(body) % 2)
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, begin + len(body)) + bits + body + directory


def pascal(name: str, pad: int) -> bytes:
    """A string behind its length in one byte, filled up to a multiple of pad."""
    body = name.encode("ascii", "replace")[:255]
    out = bytes([len(body)]) + body
    return out + b"\0" * (-len(out) % pad)


def _resource(number: int, name: str, data: bytes) -> bytes:
    return b"8BIM" + struct.pack(">H", number) + pascal(name, 2) + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)


def encode_psd(layers: list[tuple[str, np.ndarray]], merged: np.ndarray, resources: list[tuple[int, str, bytes]] | tuple = ()) -> bytes:
    """uint8 RGBA layers, bottom first, all of the canvas's size, over a merged RGB picture, to a raw PSD.

    resources: number, name and bytes each; they are written in order of number.
    """
    h, w = merged.shape[:2]
    records, planes = [], []
    for name, pixels in layers:
        extra = struct.pack(">I", 0) + struct.pack(">I", 0) + pascal(name, 4)
        channels = b"".join(struct.pack(">hI", k, 2 + h * w) for k in (-1, 0, 1, 2))
        records.append(struct.pack(">4iH", 0, 0, h, w, 4) + channels + b"8BIMnorm" + bytes([255, 0, 0, 0]) + struct.pack(">I", len(extra)) + extra)
        planes += [struct.pack(">H", 0) + np.ascontiguousarray(pixels[..., k]).tobytes() for k in (3, 0, 1, 2)]
    info = struct.pack(">h", len(layers)) + b"".join(records) + b"".join(planes)
    info += b"\0" * (len(info) % 2)
    section = struct.pack(">I", len(info)) + info + struct.pack(">I", 0)
    head = struct.pack(">4sH6xHIIHH", b"8BPS", 1, 3, h, w, 8, 3)
    held = b"".join(_resource(*r) for r in sorted(resources))
    return head + struct.pack(">II", 0, len(held)) + held + struct.pack(">I", len(section)) + section + struct.pack(">H", 0) + np.ascontiguousarray(merged.transpose(2, 0, 1)).tobytes()


class _Reader:
    """Big-endian values one after the other; reading past the end is an error."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise Unsupported("the file ends early")
        self.at += size
        return self.data[self.at - size : self.at]

    def read(self, form: str) -> tuple:
        return struct.unpack(">" + form, self.take(struct.calcsize(">" + form)))

    def name(self, pad: int) -> str:
        size = self.take(1)[0]
        text = self.take(size).decode("ascii", "replace")
        self.take(-(size + 1) % pad)
        return text


def psd_parts(data: bytes, pixels: bool = True) -> dict:
    """A PSD's size (width, height), depth, mode, resources (number to name and bytes), layers (name, RGBA) and merged picture.

    Layer pixels and the merged picture are given where they are 8-bit raw RGB and wanted, else None.
    """
    r = _Reader(data)
    sign, version, channels, h, w, depth, mode = r.read("4sH6xHIIHH")
    if sign != b"8BPS" or version != 1:
        raise Unsupported("not a PSD")
    r.take(r.read("I")[0])
    held, resources = _Reader(r.take(r.read("I")[0])), {}
    while held.at < len(held.data):
        sign, number = held.read("4sH")
        if sign != b"8BIM":
            raise Unsupported("a resource without its signature")
        name, size = held.name(2), held.read("I")[0]
        resources[number] = name, held.take(size)
        held.take(min(size % 2, len(held.data) - held.at))
    section = _Reader(r.take(r.read("I")[0]))
    layers, shapes = [], []
    if section.data and section.read("I")[0]:
        for _ in range(abs(section.read("h")[0])):
            top, left, bottom, right, count = section.read("4iH")
            planes = [section.read("hI") for _ in range(count)]
            section.take(12)
            extra = _Reader(section.take(section.read("I")[0]))
            extra.take(extra.read("I")[0])
            extra.take(extra.read("I")[0])
            shapes.append((extra.name(4), (bottom - top, right - left), planes))
    for name, shape, planes in shapes:
        held = {}
        for number, size in planes:
            body = _Reader(section.take(size))
            if body.read("H")[0] == 0 and depth == 8:
                raw = body.take(shape[0] * shape[1])
                if pixels:
                    held[number] = np.frombuffer(raw, np.uint8).reshape(shape)
        layers.append((name, np.stack([held[k] for k in (0, 1, 2, -1)], axis=2) if held.keys() >= {0, 1, 2, -1} else None))
    raw = r.read("H")[0] == 0 and depth == 8 and channels == 3
    merged = np.frombuffer(r.take(3 * h * w), np.uint8).reshape(3, h, w).transpose(1, 2, 0) if raw else None
    return {"size": (w, h), "depth": depth, "mode": mode, "resources": resources, "layers": layers, "merged": merged}


def psd_merged(data: bytes) -> tuple[np.ndarray, bytes | None, bool]:
    """The merged picture of a PSD or PSB (h, w, channels) in 0..1, raw or in run lengths, of 8 or 16 bits; its profile; whether it is ink."""
    r = _Reader(data)
    sign, version, channels, h, w, depth, mode = r.read("4sH6xHIIHH")
    if sign != b"8BPS" or version not in (1, 2) or mode not in (1, 3, 4) or depth not in (8, 16):
        raise Unsupported(f"PSD of {depth} bits in mode {mode}")
    many = {1: 1, 3: 3, 4: 4}[mode]
    r.take(r.read("I")[0])
    held, profile = _Reader(r.take(r.read("I")[0])), None
    while held.at < len(held.data):
        number = held.read("4sH")[1]
        held.name(2)
        size = held.read("I")[0]
        body = held.take(size)
        profile = body if number == 1039 else profile
        held.take(min(size % 2, len(held.data) - held.at))
    r.take(r.read("I" if version == 1 else "Q")[0])
    packing, row = r.read("H")[0], w * depth // 8
    if packing == 0:
        raw = r.take(channels * h * row)
    elif packing == 1:
        sizes = r.read(f"{channels * h}{'H' if version == 1 else 'I'}")
        raw = b"".join(tiff.run_lengths(r.take(n))[:row].ljust(row, b"\0") for n in sizes)
    else:
        raise Unsupported("a PSD packed another way")
    values = np.frombuffer(raw, ">u2" if depth == 16 else "u1").reshape(channels, h, w).transpose(1, 2, 0) / (65535.0 if depth == 16 else 255.0)
    ink = mode == 4
    keep = many if ink else many + (channels > many and _first_is_alpha(data))
    return (1 - values if ink else values)[..., :keep], profile, ink


def _first_is_alpha(data: bytes) -> bool:
    """Whether the first extra channel is the merged picture's alpha: the number of layers is negative then."""
    at = 26
    for _ in range(2):
        at += 4 + struct.unpack_from(">I", data, at)[0]
    return len(data) >= at + 10 and struct.unpack_from(">II", data, at)[1] > 0 and struct.unpack_from(">h", data, at + 8)[0] < 0


def psd_layers(data: bytes) -> tuple[tuple[int, int], list[str]]:
    """Width and height, and the layer names, of a PSD."""
    parts = psd_parts(data, False)
    return parts["size"], [name for name, _ in parts["layers"]]


@dataclass(frozen=True)
class Picture:
    """A file's encoded values (h, w, 1 to 4) in 0..1 as a viewer turns them, and its profile if it has one.

    `ink` says that four channels are CMYK and not colours with alpha.
    """

    values: np.ndarray
    profile: bytes | None = None
    ink: bool = False
    levels: np.ndarray | None = None  # the same as levels of 8 or 16 bits, where that is known


@lru_cache(maxsize=16)
def _unpacked_profile(held: bytes) -> bytes | None:
    try:
        return zlib.decompress(held.split(b"\0", 1)[1][1:])
    except (zlib.error, IndexError):
        return None


def _png(data: bytes) -> Picture:
    held = png_chunk(data, b"iCCP")
    profile = _unpacked_profile(held) if held else None
    held = png_chunk(data, b"eXIf")
    shown = png_levels(data)
    if held:
        shown = tiff.turned(shown, tiff.orientation(held))
    return Picture(_scaled(shown), profile, levels=shown)


def _tiff(data: bytes) -> Picture:
    values, tags = tiff.decode(data)
    profile, turn = tags.get(tiff.PROFILE, (None,))[0], tags.get(tiff.TURN, (1,))[0]
    ink = tags[tiff.INK][0] == 5
    if values.shape[2] > 4 or (values.shape[2] == 4 and not ink and not tags.get(tiff.EXTRA)):
        values = values[..., : 4 if ink else 3]  # further samples are not alpha
    return Picture(tiff.turned(values, turn), profile, ink)


def _jpeg(data: bytes) -> Picture:
    values, found = jpeg.decode(data)
    return Picture(tiff.turned(values, tiff.orientation(found.exif)), found.profile, values.shape[2] == 4)


def _webp(data: bytes) -> Picture:
    values, profile, exif = webp.decode(data)
    return Picture(tiff.turned(values, tiff.orientation(exif)), profile)


def read(data: bytes) -> Picture:
    """By first bytes; refuses what is not read here."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] == b"BM":
        return Picture(decode_bmp(data))
    if data[:4] in _TIFF:
        return _named(_tiff, data)
    if data[:2] == b"\xff\xd8":
        return _named(_jpeg, data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _named(_webp, data)
    if data[:4] == b"8BPS":
        return Picture(*psd_merged(data))
    raise Unsupported("not a format read here")


def _linear(colour: np.ndarray) -> np.ndarray:
    return np.where(colour <= 0.04045, colour / 12.92, ((np.maximum(colour, 0) + 0.055) / 1.055) ** 2.4)


@lru_cache
def _linear_levels(steps: int) -> np.ndarray:
    return _linear(np.arange(steps + 1) / steps)


def light_of(shown: np.ndarray) -> np.ndarray:
    """The linear light of sRGB levels of 8 or 16 bits."""
    return _linear_levels(255 if shown.dtype == np.uint8 else 65535)[shown]


def light(picture: Picture) -> tuple[np.ndarray, np.ndarray | None]:
    """Linear sRGB (h, w, 3) and alpha or None. A profile that cannot be used is no failure: values are sRGB then."""
    values = picture.values
    many = 4 if picture.ink else 3 if values.shape[2] >= 3 else 1
    alpha = values[..., -1] if not picture.ink and values.shape[2] in (2, 4) else None
    colour = values[..., :many]
    if picture.profile:
        shown = None if picture.levels is None else picture.levels[..., :many]
        if shown is None and many == 3:
            level = np.rint(colour * 255).clip(0, 255).astype(np.uint8)
            shown = level if np.array_equal(level / 255, colour) else None
        try:
            return profiles.to_linear_srgb(picture.profile, colour, shown), alpha
        except profiles.BadProfile:
            pass
    if picture.ink:
        colour = (1 - colour[..., :3]) * (1 - colour[..., 3:])
    elif many == 1:
        colour = np.repeat(colour, 3, axis=2)
    if picture.levels is not None and many == 3:
        return light_of(picture.levels[..., :3]), alpha
    for steps in (255, 65535):  # values of 8 or 16 bits are looked up
        level = np.rint(colour * steps).clip(0, steps).astype(np.uint16)
        if np.array_equal(level / steps, colour):
            return _linear_levels(steps)[level], alpha
    return _linear(colour), alpha


def decode(data: bytes) -> np.ndarray:
    """Encoded values alone."""
    return read(data).values
