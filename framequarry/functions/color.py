"""Colour arithmetic as Column expressions: transfer curves, matrices, hex, quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB transfer curve, the Adobe RGB (1998) gamma, both primaries to XYZ (D65), Rec. 709 weights.
SRGB_CUT, SRGB_LINEAR_CUT, SRGB_SLOPE = 0.04045, 0.0031308, 12.92
ADOBE_GAMMA = 563.0 / 256.0
ADOBE_TO_XYZ = ((0.5767309, 0.1855540, 0.1881852), (0.2973769, 0.6273491, 0.0752741), (0.0270343, 0.0706872, 0.9911085))
XYZ_TO_SRGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
REC709 = (0.2126, 0.7152, 0.0722)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def srgb_decode(x: Column) -> Column:
    """Encoded to linear; the input is not clipped."""
    return F.when(x <= SRGB_CUT, x / SRGB_SLOPE).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode(x: Column) -> Column:
    """Linear to encoded, clipped to 0..1 first."""
    c = clip01(x)
    return F.when(c <= SRGB_LINEAR_CUT, c * SRGB_SLOPE).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def adobe_decode(x: Column) -> Column:
    return F.pow(clip01(x), F.lit(ADOBE_GAMMA))


def adobe_encode(x: Column) -> Column:
    return F.pow(clip01(x), F.lit(1 / ADOBE_GAMMA))


def inverse(m: tuple[tuple[float, ...], ...]) -> tuple[tuple[float, ...], ...]:
    """Inverse of a 3x3 matrix, by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(v / det for v in row) for row in rows)


def product(m: tuple[tuple[float, ...], ...], n: tuple[tuple[float, ...], ...]) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(sum(m[r][k] * n[k][c] for k in range(3)) for c in range(3)) for r in range(3))


ADOBE_TO_SRGB = product(XYZ_TO_SRGB, ADOBE_TO_XYZ)
SRGB_TO_ADOBE = inverse(ADOBE_TO_SRGB)


def apply_matrix(rgb: tuple[Column, Column, Column], m: tuple[tuple[float, ...], ...]) -> tuple[Column, ...]:
    r, g, b = rgb
    return tuple(r * row[0] + g * row[1] + b * row[2] for row in m)


def convert_linear(rgb: tuple[Column, Column, Column], source: str, target: str) -> tuple[Column, ...]:
    """Linear colour of one profile ('srgb', 'adobe') as that of another."""
    if source == target:
        return rgb
    return apply_matrix(rgb, ADOBE_TO_SRGB if source == "adobe" else SRGB_TO_ADOBE)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * REC709[0] + g * REC709[1] + b * REC709[2]


def to_uint(x: Column, top: int = 255) -> Column:
    """Clip, scale and round half up (8 bits: 255, 16 bits: 65535)."""
    return F.floor(clip01(x) * top + 0.5).cast("int")


def from_uint8(x: Column) -> Column:
    return x / 255.0


def normalise_hex(text: Column) -> Column:
    """'#RRGGBB' in upper case from 3 or 6 hex digits with or without '#'; null if it is anything else."""
    bare = F.upper(F.regexp_replace(F.trim(text), "^#", ""))
    long = F.when(F.length(bare) == 3, F.regexp_replace(bare, "([0-9A-F])", "$1$1")).otherwise(bare)
    return F.when(long.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), long))


def hex_channel(colour: Column, k: int) -> Column:
    """Channel k (0..2) of '#RRGGBB' as 0..255."""
    return F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int")


def chromaticity(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    total = F.greatest(r + g + b, F.lit(1e-6))
    return r / total, g / total


def over(fg: Column, alpha: Column, bg: Column) -> Column:
    """Porter-Duff over in linear light."""
    return fg * alpha + bg * (1.0 - alpha)
