"""Measures of masks in the array layout: one row a mask, no shuffle.

A mask is a row-major array of alpha in 0..1 with its width. Everything here but the connected
components is SQL higher-order functions, so it runs inside the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the measures, the reject rules and the score.
CORE, SOFT_LOW, SOFT_HIGH = 0.5, 0.05, 0.95
MIN_COVERAGE, MAX_COVERAGE, MIN_SOLIDITY = 0.001, 0.995, 0.60
EDGE_WIDTH, EDGE_TOLERANCE, REFERENCE_EDGE, BINARY_SHARE, MIN_PERIMETER = 1.5, 1.8, 1024.0, 1e-5, 8
W_EDGE, W_SOLIDITY, W_COVERAGE = 0.55, 0.30, 0.15
TIE, SUSPECT = 0.04, 0.45


def positions(alpha: Column) -> Column:
    return F.sequence(F.lit(0), F.size(alpha) - 1)


def where_above(alpha: Column, threshold: float) -> Column:
    """Indices of the cells above a threshold, ascending."""
    return F.filter(positions(alpha), lambda i: F.get(alpha, i) > threshold)


def bbox(alpha: Column, width: int, threshold: float = 0.05) -> Column:
    """Half-open bounds of the cells above a threshold; zeros if there are none."""
    at = where_above(alpha, threshold)
    xs, ys = F.transform(at, lambda i: i % width), F.transform(at, lambda i: F.floor(i / width).cast("int"))
    zero = F.lit(0)
    return F.struct(F.coalesce(F.array_min(xs), zero).alias("x0"), F.coalesce(F.array_min(ys), zero).alias("y0"), F.coalesce(F.array_max(xs) + 1, zero).alias("x1"), F.coalesce(F.array_max(ys) + 1, zero).alias("y1"))


def centroid(alpha: Column, width: int) -> Column:
    """Alpha-weighted mean of cell centres; null if nothing weighs."""
    start = F.struct(*(F.lit(0.0).alias(n) for n in ("s", "x", "y")))

    def add(acc: Column, i: Column) -> Column:
        a = F.get(alpha, i)
        return F.struct((acc["s"] + a).alias("s"), (acc["x"] + a * (i % width)).alias("x"), (acc["y"] + a * F.floor(i / width)).alias("y"))

    return F.aggregate(positions(alpha), start, add, lambda acc: F.when(acc["s"] > 0, F.struct((acc["x"] / acc["s"] + 0.5).alias("cx"), (acc["y"] / acc["s"] + 0.5).alias("cy"))))


def count(alpha: Column, test) -> Column:
    return F.size(F.filter(alpha, test))


def coverage(alpha: Column) -> Column:
    return count(alpha, lambda a: a > CORE) / F.size(alpha)


def soft_count(alpha: Column) -> Column:
    return count(alpha, lambda a: (a > SOFT_LOW) & (a < SOFT_HIGH))


def touches_all_edges(alpha: Column, width: int) -> Column:
    core = where_above(alpha, CORE)
    height = F.floor(F.size(alpha) / width)
    return F.exists(core, lambda i: i < width) & F.exists(core, lambda i: i >= (height - 1) * width) & F.exists(core, lambda i: i % width == 0) & F.exists(core, lambda i: i % width == width - 1)


def border_count(alpha: Column, width: int) -> Column:
    """Core cells with a side that is not core: close to the length of the contour for simple shapes, not the same."""

    def outside(i: Column) -> Column:
        def lacks(j: Column) -> Column:
            return ~(F.coalesce(F.get(alpha, j), F.lit(0.0)) > CORE)

        x = i % width
        return (x == 0) | (x == width - 1) | (i < width) | (i >= F.size(alpha) - width) | lacks(i - 1) | lacks(i + 1) | lacks(i - width) | lacks(i + width)

    return F.size(F.filter(where_above(alpha, CORE), outside))


def reject_reason(coverage_: Column, all_edges: Column, solidity: Column) -> Column:
    """The first rule a mask breaks; null if none."""
    return F.when(coverage_ < MIN_COVERAGE, "empty").when(coverage_ > MAX_COVERAGE, "full_frame").when(all_edges, "inverted").when(solidity < MIN_SOLIDITY, "fragmented")


def edge_quality(soft: Column, perimeter: Column, cells: Column, long_edge: Column) -> Column:
    """How close the mean width of the soft edge is to what a good matte has at this resolution."""
    scale = F.greatest(F.lit(1.0), long_edge / REFERENCE_EDGE)
    off = (soft / perimeter - EDGE_WIDTH * scale) / (EDGE_TOLERANCE * scale)
    return F.when((perimeter < MIN_PERIMETER) | (soft / cells < BINARY_SHARE), F.lit(0.0)).otherwise(F.exp(-(off * off)))


def coverage_plausibility(c: Column) -> Column:
    return F.when(c.between(0.05, 0.70), F.lit(1.0)).when(c < 0.05, c / 0.05).otherwise(F.greatest(F.lit(0.0), 1.0 - (c - 0.70) / 0.30))


def score(edge: Column, solidity: Column, plausible: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), W_EDGE * edge + W_SOLIDITY * solidity + W_COVERAGE * plausible))
