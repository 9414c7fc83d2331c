"""Embedded ICC profiles: from a file's device values to linear sRGB, with numpy only.

Read are matrix-and-curve profiles (sampled, gamma and parametric curves), grey profiles, and lookup tables
(8 and 16 bit, and tables between curves) over RGB or CMYK, with connection space XYZ or Lab. Tables of three
inputs are interpolated in tetrahedra, others linearly in every direction. White is adapted from the profile's D50
to D65 by cone responses; what lies outside sRGB is cut off. The rendering is relative: white stays white.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

# White points, cone responses, and sRGB's primaries as linear light to XYZ under D65.
D50, D65 = np.array([0.9642, 1.0, 0.8249]), np.array([0.95047, 1.0, 1.08883])
CONES = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
SRGB_TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
#: XYZ under D50 to linear sRGB.
XYZ_TO_SRGB = np.linalg.inv(SRGB_TO_XYZ) @ np.linalg.inv(CONES) @ np.diag((CONES @ D65) / (CONES @ D50)) @ CONES

Curve = Callable[[np.ndarray], np.ndarray]


class BadProfile(ValueError):
    """A profile that is broken or of a kind that is not read; its picture is taken for sRGB."""


def tags(profile: bytes) -> dict[bytes, bytes]:
    """The profile's table: signature to bytes."""
    if len(profile) < 132 or profile[36:40] != b"acsp":
        raise BadProfile("no profile")
    count = struct.unpack(">I", profile[128:132])[0]
    if count > 200 or len(profile) < 132 + 12 * count:
        raise BadProfile("a tag table that does not fit")
    out = {}
    for k in range(count):
        key, at, size = struct.unpack_from(">4sII", profile, 132 + 12 * k)
        if at + size > len(profile):
            raise BadProfile("a tag beyond the end")
        out[key] = profile[at : at + size]
    return out


def description(profile: bytes) -> str:
    """The profile's own name, by its description tag of either version; empty if there is none."""
    body = tags(profile).get(b"desc", b"")
    if body[:4] == b"desc" and len(body) >= 12:
        return body[12 : 12 + struct.unpack(">I", body[8:12])[0]].split(b"\0")[0].decode("ascii", "replace")
    if body[:4] == b"mluc" and len(body) >= 28:
        size, at = struct.unpack(">II", body[20:28])
        return body[at : at + size].decode("utf-16-be", "replace")
    return ""


def _fixed(raw: bytes, at: int, many: int) -> np.ndarray:
    return np.array(struct.unpack_from(f">{many}i", raw, at)) / 65536.0


def _sampled(values: np.ndarray) -> Curve:
    grid = np.linspace(0, 1, len(values))
    return lambda x: np.interp(x, grid, values)


def _curve(raw: bytes) -> tuple[Curve, int]:
    """A curve and how many bytes it takes."""
    kind = raw[:4]
    if kind == b"curv":
        many = struct.unpack_from(">I", raw, 8)[0]
        if many == 0:
            return lambda x: x, 12
        if many == 1:
            gamma = struct.unpack_from(">H", raw, 12)[0] / 256
            return lambda x: np.clip(x, 0, 1) ** gamma, 14
        return _sampled(np.frombuffer(raw, ">u2", many, 12) / 65535.0), 12 + 2 * many
    if kind == b"para":
        form = struct.unpack_from(">H", raw, 8)[0]
        many = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}.get(form)
        if many is None:
            raise BadProfile("an unknown kind of curve")
        g, a, b, c, d, e, f = (*_fixed(raw, 12, many), *[0.0] * (7 - many))
        if form == 0:
            return lambda x: np.clip(x, 0, 1) ** g, 16
        # below d the curve is a line (form 3 and 4) or flat (1 and 2), whose break is where the base is zero
        cut, line, low, high = (-b / a, 0.0, c if form == 2 else 0.0, c if form == 2 else 0.0) if form < 3 else (d, c, f, e)
        return lambda x: np.where(x >= cut, np.maximum(a * x + b, 0) ** g + high, line * x + low), 12 + 4 * many
    raise BadProfile("no curve")


def _curves(raw: bytes, at: int, many: int) -> list[Curve]:
    """Curves one after the other, each filled up to four bytes."""
    out = []
    for _ in range(many):
        curve, size = _curve(raw[at:])
        out.append(curve)
        at += size + -size % 4
    return out


def tetrahedral(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of a table (n, n, n, outputs) at points (k, 3) in 0..1, each from the four corners of its tetrahedron."""
    edge = np.array(table.shape[:3]) - 1
    place = np.clip(x, 0, 1) * edge
    low = np.minimum(place.astype(int), np.maximum(edge - 1, 0))
    part = place - low
    order = np.argsort(-part, axis=1, kind="stable")
    sizes = np.take_along_axis(part, order, axis=1)
    corner = low.copy()
    rows = np.arange(len(x))
    out = table[tuple(corner.T)] * (1 - sizes[:, :1])
    for k in range(3):
        corner[rows, order[:, k]] = np.minimum(corner[rows, order[:, k]] + 1, edge[order[:, k]])
        weight = sizes[:, k] - (sizes[:, k + 1] if k < 2 else 0)
        out = out + table[tuple(corner.T)] * weight[:, None]
    return out


def multilinear(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of a table of any number of inputs, linear in every direction."""
    inputs = x.shape[1]
    edge = np.array(table.shape[:inputs]) - 1
    place = np.clip(x, 0, 1) * edge
    low = np.minimum(place.astype(int), np.maximum(edge - 1, 0))
    part, out = place - low, 0.0
    for corner in range(1 << inputs):
        step = np.array([corner >> k & 1 for k in range(inputs)])
        weight = np.where(step, part, 1 - part).prod(axis=1)
        out = out + table[tuple(np.minimum(low + step, edge).T)] * weight[:, None]
    return out


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tetrahedral(table, x) if x.shape[1] == 3 else multilinear(table, x)


def _apply(curves: list[Curve], x: np.ndarray) -> np.ndarray:
    return np.stack([curve(x[:, k]) for k, curve in enumerate(curves)], axis=1)


def _old_table(raw: bytes, lab: bool) -> Callable[[np.ndarray], np.ndarray]:
    """mft1 and mft2: curves, table, curves; to connection values."""
    deep = raw[:4] == b"mft2"
    inputs, outputs, grid = raw[8], raw[9], raw[10]
    at, ins, outs = (52, *struct.unpack_from(">HH", raw, 48)) if deep else (48, 256, 256)
    kind, top = (">u2", 65535.0) if deep else ("u1", 255.0)

    def block(many: int, start: int) -> np.ndarray:
        return np.frombuffer(raw, kind, many, start) / top

    width = 2 if deep else 1
    first = [_sampled(v) for v in block(inputs * ins, at).reshape(inputs, ins)]
    at += inputs * ins * width
    table = block(grid**inputs * outputs, at).reshape(*[grid] * inputs, outputs)
    at += grid**inputs * outputs * width
    last = [_sampled(v) for v in block(outputs * outs, at).reshape(outputs, outs)]
    # 16-bit tables of this kind count L to FF00, and XYZ to 1 + 32767 / 32768
    scale = (65535 / 65280 if deep else 1.0) if lab else 65535 / 32768
    return lambda x: _apply(last, _through(table, _apply(first, x))) * scale


def _new_table(raw: bytes, lab: bool) -> Callable[[np.ndarray], np.ndarray]:
    """mAB: curves, table, curves, matrix, curves; all but the last may be missing."""
    inputs, outputs = raw[8], raw[9]
    b, matrix, m, clut, a = struct.unpack_from(">5I", raw, 12)
    steps: list[Callable[[np.ndarray], np.ndarray]] = []
    if a and clut:
        first, grid, width = _curves(raw, a, inputs), list(raw[clut : clut + inputs]), raw[clut + 16]
        many = int(np.prod(grid)) * outputs
        table = (np.frombuffer(raw, ">u2" if width == 2 else "u1", many, clut + 20) / (65535.0 if width == 2 else 255.0)).reshape(*grid, outputs)
        steps += [lambda x: _apply(first, x), lambda x: _through(table, x)]
    if m and matrix:
        middle, rows, shift = _curves(raw, m, outputs), _fixed(raw, matrix, 9).reshape(3, 3), _fixed(raw, matrix + 36, 3)
        steps += [lambda x: _apply(middle, x), lambda x: np.clip(x @ rows.T + shift, 0, 1)]
    last = _curves(raw, b, outputs)
    scale = 1.0 if lab else 65535 / 32768

    def run(x: np.ndarray) -> np.ndarray:
        for step in steps:
            x = step(x)
        return _apply(last, x) * scale

    return run


def _lab_to_xyz(values: np.ndarray) -> np.ndarray:
    """Connection values of Lab, each 0..1, to XYZ under D50."""
    light, a, b = values[:, 0] * 100, values[:, 1] * 255 - 128, values[:, 2] * 255 - 128
    y = (light + 16) / 116
    f = np.stack([y + a / 500, y, y - b / 200], axis=1)
    return np.where(f > 6 / 29, f**3, (f - 4 / 29) * 3 * (6 / 29) ** 2) * D50


@lru_cache(maxsize=16)
def _shaper(profile: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """The light of each of 256 levels, (channel, 256), and the way to linear sRGB, of a profile of curves and a matrix; None for others."""
    held = tags(profile)
    if profile[16:20] != b"RGB " or any((held.get(k) or b"")[:4] in (b"mft1", b"mft2", b"mAB ") for k in (b"A2B1", b"A2B0")):
        return None
    shown = np.arange(256) / 255.0
    light = np.stack([_curve(held[k])[0](shown) for k in (b"rTRC", b"gTRC", b"bTRC")])
    return light, XYZ_TO_SRGB @ np.array([_fixed(held[k], 8, 3) for k in (b"rXYZ", b"gXYZ", b"bXYZ")]).T


def to_linear_srgb(profile: bytes, values: np.ndarray, levels: np.ndarray | None = None) -> np.ndarray:
    """Device values (h, w, channels) in 0..1 to linear sRGB (h, w, 3) in 0..1; raises BadProfile. levels: the same in 8 bits, if they are, to look them up."""
    try:
        known = _shaper(profile) if levels is not None and levels.dtype == np.uint8 and levels.shape[2] == 3 else None
        if known is not None:
            made = known[1] @ np.stack([light[levels[..., c].reshape(-1)] for c, light in enumerate(known[0])])
            if not np.isfinite(made).all():
                raise BadProfile("values without bounds")
            return np.clip(made, 0, 1).T.reshape(*values.shape[:2], 3)
        held, space, lab = tags(profile), profile[16:20], profile[20:24] == b"Lab "
        flat = values.reshape(-1, values.shape[2])
        many = {b"RGB ": 3, b"GRAY": 1, b"CMYK": 4}.get(space)
        if many != flat.shape[1]:
            raise BadProfile("the profile is for another kind of picture")
        table = held.get(b"A2B1") or held.get(b"A2B0")
        if table is not None and table[:4] in (b"mft1", b"mft2", b"mAB "):
            made = (_new_table if table[:4] == b"mAB " else _old_table)(table, lab)(flat)
            xyz = _lab_to_xyz(made) if lab else made
        elif space == b"RGB ":
            light = _apply([_curve(held[k])[0] for k in (b"rTRC", b"gTRC", b"bTRC")], flat)
            xyz = light @ np.array([_fixed(held[k], 8, 3) for k in (b"rXYZ", b"gXYZ", b"bXYZ")])
        elif space == b"GRAY":
            xyz = _curve(held[b"kTRC"])[0](flat[:, :1]) * D50
        else:
            raise BadProfile("no table for this kind of picture")
    except BadProfile:
        raise
    except (KeyError, IndexError, ValueError, struct.error) as error:
        raise BadProfile(str(error)) from error
    if not np.isfinite(xyz).all():
        raise BadProfile("values without bounds")
    return np.clip(xyz @ XYZ_TO_SRGB.T, 0, 1).reshape(*values.shape[:2], 3)
