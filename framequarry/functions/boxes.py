"""Box and placement arithmetic as Column expressions. Boxes are half-open: x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of box handling.
NORM, SMALLEST_SHARE, LARGEST_SHARE = 1000, 0.005, 0.92


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def is_empty(b: Column) -> Column:
    return (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"])


def union(a: Column, b: Column) -> Column:
    """The smallest box around both; an empty box adds nothing."""
    both = box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def scale_to_fit(w: Column, h: Column, to_w: Column, to_h: Column, margin_pct: Column, cover: Column, allow_upscale: Column) -> Column:
    """A struct of the scale and whether growing was refused. Cover ignores the margin."""
    inset = 1.0 - 2.0 * margin_pct / 100.0
    raw = F.when(cover, F.greatest(to_w / w, to_h / h)).otherwise(F.least(to_w * inset / w, to_h * inset / h))
    refused = (raw > 1.0) & ~allow_upscale
    return F.struct(F.when(refused, F.lit(1.0)).otherwise(raw).alias("scale"), refused.alias("upscale_skipped"))


def overlap(src_w: Column, src_h: Column, dst_w: Column, dst_h: Column, dx: Column, dy: Column) -> Column:
    """Where a source shifted by (dx, dy) meets a target: target window, null if nowhere."""
    x0, y0 = F.greatest(F.lit(0), dx), F.greatest(F.lit(0), dy)
    x1, y1 = F.least(dst_w, dx + src_w), F.least(dst_h, dy + src_h)
    return F.when((x0 < x1) & (y0 < y1), box(x0, y0, x1, y1))


def pad_and_clamp(b: Column, w: Column, h: Column, pct: Column) -> Column:
    """Grow a box by a share of its own size (rounded half to even), within the frame."""
    px = F.bround((b["x1"] - b["x0"]) * pct / 100.0, 0).cast("int")
    py = F.bround((b["y1"] - b["y0"]) * pct / 100.0, 0).cast("int")
    return box(F.greatest(F.lit(0), b["x0"] - px), F.greatest(F.lit(0), b["y0"] - py), F.least(w, b["x1"] + px), F.least(h, b["y1"] + py))


def norm_to_pixels(y0: Column, x0: Column, y1: Column, x1: Column, w: Column, h: Column) -> Column:
    """A y-first box in thousandths as an x-first box in pixels, truncated."""
    return box(*((v * side / NORM).cast("int") for v, side in ((x0, w), (y0, h), (x1, w), (y1, h))))


def share(b: Column, w: Column, h: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) / (w * h)


def plausible_subject(b: Column, w: Column, h: Column) -> Column:
    s = share(b, w, h)
    return ~is_empty(b) & (s >= SMALLEST_SHARE) & (s <= LARGEST_SHARE)


def clamp_size(side: Column, most: int = 20000) -> Column:
    return F.least(F.greatest(side, F.lit(1)), F.lit(most))


def fixed_8_24(fraction: Column) -> Column:
    """8.24 fixed point modulo 2^32."""
    return F.bround(fraction * 16777216.0, 0).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def signed32(raw: Column) -> Column:
    return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw)


def frame_on_canvas(w: Column, h: Column, to_w: int, to_h: int, margin_pct: Column, allow_upscale: Column) -> Column:
    """A whole frame on a canvas: scale, new size and corner; its layers move with it."""
    raw = F.least(to_w / w, to_h / h) * F.greatest(1.0 - margin_pct / 100.0 * 2.0, F.lit(0.05))
    scale = F.when((raw > 1.0) & ~allow_upscale, F.lit(1.0)).otherwise(raw)
    width, height = (F.greatest(F.lit(1), F.bround(side * scale, 0).cast("int")) for side in (w, h))
    return F.struct(scale.alias("scale"), width.alias("width"), height.alias("height"), F.floor((to_w - width) / 2).cast("int").alias("x0"), F.floor((to_h - height) / 2).cast("int").alias("y0"))
