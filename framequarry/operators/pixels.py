"""Pixel algebra: compositing, edge colour, backdrops, shadows. Images are groups of rows keyed by img, or one row an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from .kernels import ellipse

# Fixed values of edge decontamination and of the shadow rules.
BAND, PARTIAL_LOW, PARTIAL_HIGH, ALPHA_FLOOR, RAMP_END = 7, 0.001, 0.999, 0.08, 0.25
DEAD_BAND, MOST_SHADOW, CLEAR, TOP_SHARE = 0.02, 0.35, 0.02, 0.7


def shaded(background: Column, ratio: Column) -> Column:
    return color.clip01(background * ratio)


def flatten(df: DataFrame, background: Column, ratio: Column) -> DataFrame:
    """Over a shadowed background; where the background is null the picture passes through."""
    out = {c: F.when(background.isNull(), F.col(c)).otherwise(color.over(F.col(c), F.col("a"), shaded(background, ratio))) for c in "rgb"}
    return df.withColumns({**out, "a": F.when(background.isNull(), F.col("a")).otherwise(F.lit(1.0))})


def edge_band(df: DataFrame) -> DataFrame:
    """Pixels (img, y, x) within an elliptic distance of a partly clear one: an equi-join to a constant set of offsets."""
    r = BAND // 2
    offsets = [(y - r, x - r) for y in range(BAND) for x in range(BAND) if ellipse(BAND)[y, x]]
    near = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    partial = df.where((F.col("a") > PARTIAL_LOW) & (F.col("a") < PARTIAL_HIGH)).select("img", "y", "x", F.explode(near).alias("o"))
    return partial.select("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()


def decontaminate(df: DataFrame, plate: Column, side: int) -> DataFrame:
    """Solve each edge pixel for the product's own colour, easing in with alpha, inside the band only."""
    band = edge_band(df).where(F.col("x").between(0, side - 1) & F.col("y").between(0, side - 1)).withColumn("near", F.lit(True))
    marked = df.join(band, ["img", "y", "x"], "left")
    a = F.col("a")
    inside = F.col("near").isNotNull() & (a > PARTIAL_LOW)
    ease = color.clip01((a - ALPHA_FLOOR) / (RAMP_END - ALPHA_FLOOR))
    out = {}
    for c in "rgb":
        own = color.clip01((F.col(c) - (1 - a) * plate) / F.greatest(a, F.lit(ALPHA_FLOOR)))
        out[c] = F.when(inside, F.col(c) + (own - F.col(c)) * ease).otherwise(F.col(c))
    return marked.withColumns(out)


def backdrop(pictures: DataFrame, side: int) -> DataFrame:
    """img, br, bg, bb: medians over the border ring, its corners twice. In the array layout: sorted in place, no shuffle."""
    ring = [*range(side), *range(side * (side - 1), side * side), *range(0, side * side, side), *range(side - 1, side * side, side)]
    places = F.lit(ring)
    half = len(ring) // 2

    def median(c: str) -> Column:
        ordered = F.sort_array(F.transform(places, lambda i: F.get("rgb", i)[c]))
        return (F.get(ordered, F.lit(half - 1)) + F.get(ordered, F.lit(half))) / 2

    return pictures.select("img", *(median(c).alias(f"b{c}") for c in "rgb"))


def mixture(df: DataFrame, pictures: DataFrame, side: int) -> DataFrame:
    """mix: least-squares share of the product's median colour in each pixel; loss: how much of the backdrop is missing."""
    product = df.where("a > 0.5").groupBy("img").agg(*(F.expr(f"percentile({c}, 0.5)").alias(f"f{c}") for c in "rgb"))
    known = df.join(product, "img").join(backdrop(pictures, side), "img")

    def dot(p: str, q: str) -> Column:
        return F.col(f"{p}r") * F.col(f"{q}r") + F.col(f"{p}g") * F.col(f"{q}g") + F.col(f"{p}b") * F.col(f"{q}b")

    ff, bb, fb, fo, bo = dot("f", "f"), dot("b", "b"), dot("f", "b"), dot("f", ""), dot("b", "")
    det = ff * bb - fb * fb
    return known.withColumns({"mix": F.when((det < 1e-6) | (ff < 1e-6), F.lit(0.0)).otherwise(color.clip01((bb * fo - fb * bo) / det)), "loss": color.clip01(1 - bo / bb)})


def plate_sums(df: DataFrame, side: int) -> DataFrame:
    """Sums of the quadratic fit over the brightest 30 % of each image's backdrop."""
    ground = df.where(F.col("a") <= CLEAR).select("img", color.luminance(F.col("r"), F.col("g"), F.col("b")).alias("lum"), (F.col("x") / (side - 1) - 0.5).alias("u"), (F.col("y") / (side - 1) - 0.5).alias("v"))
    cut = ground.groupBy("img").agg(F.expr(f"percentile(lum, {TOP_SHARE})").alias("cut"))
    u, v, lum = F.col("u"), F.col("v"), F.col("lum")
    sums = {"su": u, "sv": v, "suu": u * u, "suv": u * v, "svv": v * v, "s4": u * u * u * u, "sl": lum, "slu": lum * u, "slvv": lum * v * v}
    return ground.join(cut, "img").where("lum >= cut").groupBy("img").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.sum(e), 4).alias(n) for n, e in sums.items()))


def flat_shadow(df: DataFrame) -> DataFrame:
    """Darkest ratio, share of shaded pixels and whether the shadow is kept, against each image's brightest luminance."""
    lum = color.luminance(F.col("r"), F.col("g"), F.col("b"))
    plate = df.groupBy("img").agg(F.max(lum).alias("plate"))
    raw = F.least(F.lit(3.0), F.greatest(F.lit(0.0), lum / F.greatest(F.col("plate"), F.lit(1e-4))))
    ratio = F.when((F.col("a") > CLEAR) | (F.abs(raw - 1) < DEAD_BAND), F.lit(1.0)).otherwise(raw)
    covered = F.avg(F.when(F.abs(F.col("ratio") - 1) > DEAD_BAND, 1.0).otherwise(0.0))
    return df.join(plate, "img").withColumn("ratio", ratio).groupBy("img").agg(F.round(F.min("ratio"), 6).alias("darkest"), F.round(covered, 6).alias("coverage"), covered.between(1e-9, MOST_SHADOW).alias("kept"))
