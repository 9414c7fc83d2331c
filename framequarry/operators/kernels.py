"""Neighbourhood kernels in numpy, applied to arrays of whole images by Arrow batches.

What SQL has no operator for: connected components, morphology, resampling, smoothing, contour
tracing, polygon filling. Each takes and returns plain arrays; nothing looks beyond one image.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np


class Runs:
    """A mask as runs of its rows, in raster order, with the number (1, 2, ..., in raster order of the first cell) of what each hangs together with."""

    def __init__(self, mask: np.ndarray, diagonal: bool = True):
        height, width = self.shape = mask.shape
        bordered = np.zeros((height, width + 2), bool)
        bordered[:, 1:-1] = mask
        edge = np.flatnonzero(bordered[:, 1:] != bordered[:, :-1])
        row, start = np.divmod(edge[::2], width + 1)
        end = edge[1::2] - row * (width + 1)
        self.lengths, self.first, self.last = end - start, row * width + start, row * width + end
        above, reach = (row - 1) * (width + 2), 0 if diagonal else 1  # keys of the row above, where runs are sorted by start and by end
        low = np.searchsorted(row * (width + 2) + end, above + start + reach)
        high = np.searchsorted(row * (width + 2) + start, above + end - reach, side="right")
        roots = np.where(high > low, low, np.arange(len(row)))  # the first run above, or the run itself
        while not np.array_equal(up := roots[roots], roots):
            roots = up
        several = np.flatnonzero(high - low > 1)
        if len(several):
            roots = self._united(roots, several.tolist(), low[several].tolist(), high[several].tolist())[roots]
        own = roots == np.arange(len(roots))
        self.count = int(own.sum())
        self.labels = np.cumsum(own)[roots]

    @staticmethod
    def _united(roots: np.ndarray, runs: list[int], low: list[int], high: list[int]) -> np.ndarray:
        """What each root belongs to once the runs that hang on several above them tie those together: the first."""
        known, up = roots.tolist(), list(range(len(roots)))
        for k, a, b in zip(runs, low, high, strict=True):
            mine = known[k]
            while up[mine] != mine:
                mine = up[mine] = up[up[mine]]
            for other in range(a + 1, b):
                other = known[other]
                while up[other] != other:
                    other = up[other] = up[up[other]]
                mine, other = min(mine, other), max(mine, other)
                up[other] = mine
        for k, first in enumerate(up):  # what comes first is there already
            up[k] = up[first]
        return np.array(up)

    def sizes(self) -> np.ndarray:
        """Cells of each number, from 1 on."""
        return np.bincount(self.labels, weights=self.lengths, minlength=self.count + 1)[1:].astype(np.int64)

    def painted(self, values: np.ndarray) -> np.ndarray:
        """A field with a value a run, 0 outside."""
        steps = np.zeros(self.shape[0] * self.shape[1] + 1, np.int64)
        steps[self.last] -= values
        steps[self.first] += values
        return np.cumsum(steps[:-1]).reshape(self.shape)


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels 1, 2, ... of what hangs together (by corners too, if diagonal), in raster order of the first cell; 0 outside. Runs of rows are united."""
    runs = Runs(mask, diagonal)
    return runs.painted(runs.labels)


def largest_share(core: np.ndarray) -> float:
    """The largest component's share of all core cells; 0 if there are none."""
    sizes = Runs(core).sizes()
    return float(sizes.max() / sizes.sum()) if len(sizes) else 0.0


def isolate_largest(alpha: np.ndarray) -> np.ndarray | None:
    """Only the object with the most core cells (ties: the later one); None if there is at most one object."""
    labels = components(alpha > 0.05)
    if labels.max(initial=0) <= 1:
        return None
    core = np.bincount(labels[alpha > 0.5], minlength=int(labels.max()) + 1)[1:]
    pick = len(core) - int(np.argmax(core[::-1]))
    return np.where(labels == pick, alpha, 0.0)


_TURNS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _walk(cells: bytes, stride: int, start: int) -> list[int]:
    """The places of an outer border in a mask with a margin, clockwise from the first raster cell of its object, by Moore's walk."""
    turns = [dy * stride + dx for dy, dx in _TURNS] * 2
    d = next((k for k in range(8) if cells[start + turns[k]]), None)
    if d is None:
        return [start]
    path, at = [start], start + turns[d]
    second = at
    while True:
        here = at
        d = (d + 5 + (d + 1) % 2) % 8
        while not cells[here + turns[d]]:
            d += 1
        at, d = here + turns[d], d % 8
        if here == start and at == second:
            return path
        path.append(here)
        if len(path) > 4 * len(cells) + 8:
            raise RuntimeError("the border does not close")


def _bordered(mask: np.ndarray) -> bytes:
    out = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), np.uint8)
    out[1:-1, 1:-1] = mask
    return out.tobytes()


def trace(mask: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """The outer border of the object whose first raster cell is `start`, clockwise, by Moore's walk."""
    stride = mask.shape[1] + 2
    return [(at // stride - 1, at % stride - 1) for at in _walk(_bordered(mask), stride, (start[0] + 1) * stride + start[1] + 1)]


def _borders(core: np.ndarray, runs: Runs) -> list[list[int]]:
    cells, width = _bordered(core), core.shape[1]
    _, first = np.unique(runs.labels, return_index=True)
    y, x = np.divmod(runs.first[first], width)
    return [_walk(cells, width + 2, at) for at in ((y + 1) * (width + 2) + x + 1).tolist()]  # objects do not touch, not even by corners


def contours(core: np.ndarray) -> list[list[tuple[int, int]]]:
    """Outer borders of all objects, in raster order."""
    stride = core.shape[1] + 2
    return [[(at // stride - 1, at % stride - 1) for at in border] for border in _borders(core, Runs(core))]


def pieces(masks: np.ndarray) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Masks (n, h, w) as one tall mask's runs, and of each object the mask it is in and its first cell in that mask with a margin."""
    n, h, w = masks.shape
    cells = np.zeros((n, h + 1, w + 2), bool)
    cells[:, :h, 1:-1] = masks
    runs = Runs(cells.reshape(-1, w + 2))
    _, first = np.unique(runs.labels, return_index=True)
    own, at = np.divmod(runs.first[first], (h + 1) * (w + 2))
    return runs, own, at + w + 2


def objects(masks: np.ndarray) -> dict[int, list[tuple[list[int], int]]]:
    """Of each mask (n, h, w) that has any: its objects in raster order, as outer border (places in the mask with a margin) and cells."""
    runs, own, at = pieces(masks)
    cells: dict[int, bytes] = {}
    out: dict[int, list[tuple[list[int], int]]] = {}
    for k, start, size in zip(own.tolist(), at.tolist(), runs.sizes().tolist(), strict=True):
        if k not in cells:
            cells[k] = _bordered(masks[k])
        out.setdefault(k, []).append((_walk(cells[k], masks.shape[2] + 2, start), size))
    return out


def outlines(masks: np.ndarray, starts: list[list[int]]) -> list[int]:
    """How long the outer borders of all objects of each mask (n, h, w) are together, from their first cells."""
    return [sum(len(_walk(cells, mask.shape[1] + 2, at)) for at in first) for mask, first in zip(masks, starts, strict=True) for cells in [_bordered(mask)]]


def places(border: list[int], stride: int) -> np.ndarray:
    """A border's places in a mask with a margin as points (x, y) of the mask."""
    y, x = np.divmod(np.array(border), stride)
    return np.stack([x - 1.0, y - 1.0], axis=1)


def outline(core: np.ndarray, runs: Runs) -> int:
    """How long the outer borders of all objects are together, from the runs of their cells."""
    return sum(map(len, _borders(core, runs)))


#: Shorter stretches are gone through point by point.
FEW_POINTS = 200


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed polygon, from its two farthest ends."""
    if len(points) < 4:
        return points
    far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
    ring = np.concatenate([points, points[:1]])
    places, kept = ring.tolist(), []

    def reduce(first: int, last: int) -> None:
        """Keeps what lies between two places and is needed there."""
        if last - first < 2:
            return
        (ax, ay), (bx, by) = places[first], places[last]
        dx, dy = bx - ax, by - ay
        length = float(np.hypot(dx, dy))
        if length and last - first < FEW_POINTS:
            d = [abs(dx * (y - ay) - dy * (x - ax)) / length for x, y in places[first : last + 1]]
            worst = max(d)
            at = first + d.index(worst)
        else:
            part = ring[first : last + 1] - ring[first]
            d = np.abs(dx * part[:, 1] - dy * part[:, 0]) / length if length else np.hypot(*part.T)
            at = first + int(np.argmax(d))
            worst = d[at - first]
        if worst > tolerance:
            reduce(first, at)
            kept.append(at)
            reduce(at, last)

    kept.append(0)
    reduce(0, far)
    kept.append(far)
    reduce(far, len(points))
    return points[kept]


@lru_cache
def ellipse(size: int) -> np.ndarray:
    """An elliptic structuring element of odd size."""
    r = size // 2
    out = np.zeros((size, size), bool)
    for y in range(-r, r + 1):
        half = int(round(np.sqrt(max(0.0, r * r - y * y)))) if r else 0
        out[y + r, r - half : r + half + 1] = True
    out.flags.writeable = False
    return out


@lru_cache
def _lines(shape: tuple[int, int], cells: bytes) -> dict[int, list[int]] | None:
    """The rows of a structuring element by half their width, if each is one run about the middle."""
    element, out = np.frombuffer(cells, bool).reshape(shape), {}
    for y, line in enumerate(element):
        many = int(line.sum())
        if many % 2 != 1 or not line[shape[1] // 2 - many // 2 : shape[1] // 2 + many // 2 + 1].all():
            return None
        out.setdefault(many // 2, []).append(y)
    return out


def _joined(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    """A mask united with itself at every place of an element, as one number whose bits are the cells: a shift moves all at once."""
    r = element.shape[0] // 2
    if mask.ndim == 3:  # many pictures are one tall one with clear rows between them
        n, h, w = mask.shape
        tall = np.zeros((n, h + r, w), bool)
        tall[:, :h] = mask
        return _joined(tall.reshape(-1, w), element).reshape(n, h + r, w)[:, :h]
    h, w = mask.shape
    stride = w + r  # what leaves a row falls into the margin behind it
    padded = np.zeros((h, stride), bool)
    padded[:, :w] = mask
    bits = int.from_bytes(np.packbits(padded, bitorder="little").tobytes(), "little")
    moved = lambda field, by: field >> by if by >= 0 else field << -by
    out, lines = 0, _lines(element.shape, element.tobytes())
    if lines is None:
        for y, x in np.argwhere(element).tolist():
            out |= moved(bits, (y - r) * stride + x - r)
    else:
        along, half = bits, 0
        for wanted in sorted(lines):
            while half < wanted:
                half += 1
                along |= bits >> half | bits << half
            for y in lines[wanted]:
                out |= moved(along, (y - r) * stride)
    cells = (out & ((1 << h * stride) - 1)).to_bytes(-(-h * stride // 8), "little")
    return np.unpackbits(np.frombuffer(cells, np.uint8), count=h * stride, bitorder="little").reshape(h, stride)[:, :w].astype(bool)


def dilate(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    return _joined(mask, element)


def erode(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    """What lies beyond the border is taken for mask."""
    return ~_joined(~mask, element)


def gaussian(field: np.ndarray, sigma: float, axes: tuple[int, int] = (0, 1)) -> np.ndarray:
    """Separable smoothing along two axes; the border mirrors without repeating its last cell."""
    r = max(1, int(round(4 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in axes:
        n = field.shape[axis]
        at = np.arange(-r, n + r)
        at = n - 1 - np.abs(n - 1 - np.abs(at)) if n > r else np.clip(at, 0, n - 1)
        padded, out = field.take(at, axis=axis), 0
        for k, w in enumerate(weights.tolist()):
            out = out + w * padded[(slice(None),) * axis + (slice(k, k + n),)]
        field = out
    return field


def area_halve(field: np.ndarray) -> np.ndarray:
    """Means of 2x2 cells; an odd last row or column is dropped."""
    h, w = field.shape[0] // 2 * 2, field.shape[1] // 2 * 2
    f = field[:h, :w]
    return (f[0::2, 0::2] + f[0::2, 1::2] + f[1::2, 0::2] + f[1::2, 1::2]) / 4


#: Matrices of up to so many values are kept for the next picture.
KEPT = 1 << 15


def _kept(make: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
    """Keep small matrices by their sizes; they are not to be written to."""

    @lru_cache(maxsize=256)
    def held(*key) -> np.ndarray:
        matrix = make(*key)
        matrix.flags.writeable = False
        return matrix

    return lambda size, out, *more: held(size, out, *more) if size * out <= KEPT else make(size, out, *more)


@_kept
def weights(size: int, out: int, kind: str) -> np.ndarray:
    """Resampling matrix (out, size) of a separable filter with clamped borders."""
    centre = (np.arange(out) + 0.5) * size / out - 0.5
    matrix = np.zeros((out, size))
    base = np.floor(centre).astype(int)
    for tap in range(-3, 5) if kind == "lanczos" else range(-1, 3):
        at = base + tap
        t = np.abs(centre - at)
        if kind == "lanczos":
            w = np.where(t < 4, np.sinc(t) * np.sinc(t / 4), 0)
        else:
            a = -0.75
            w = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0))
        np.add.at(matrix, (np.arange(out), np.clip(at, 0, size - 1)), w)
    return matrix / matrix.sum(axis=1, keepdims=True)


def resize(field: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Halve while less than half is wanted (judged by the width), then Lanczos to shrink or cubic to grow."""
    while out_w < field.shape[1] * 0.5 and min(field.shape[:2]) >= 2:
        field = area_halve(field)
    kind = "lanczos" if out_w < field.shape[1] else "cubic"
    if field.shape[:2] == (out_h, out_w):
        return field
    rows, cols = weights(field.shape[0], out_h, kind), weights(field.shape[1], out_w, kind)
    tall = np.tensordot(rows, field, axes=(1, 0))
    return np.moveaxis(np.tensordot(tall, cols, axes=(1, 1)), -1, 1)


@lru_cache(maxsize=1024)
def _reached(size: int, out: int, kind: str, first: int, last: int) -> tuple[int, np.ndarray]:
    """The part of a resampling matrix for cells first to last, without the output that they do not reach: its first row, and the rest."""
    part = weights(size, out, kind)[:, first : last + 1]
    rows = np.flatnonzero(part.any(axis=1))
    held = part[rows[0] : rows[-1] + 1].copy()
    held.flags.writeable = False
    return int(rows[0]), held


def reached(size: int, out: int, kind: str, first: int, last: int) -> tuple[int, np.ndarray]:
    return (_reached if size * out <= KEPT else _reached.__wrapped__)(size, out, kind, first, last)


def resample(rgb: np.ndarray, alpha: np.ndarray, out_h: int, out_w: int) -> tuple[np.ndarray, np.ndarray]:
    """Premultiplied resampling of colour and alpha, with a light unsharp mask after clear shrinking."""
    scale = out_w / alpha.shape[1]
    both = np.concatenate([rgb * alpha[..., None], alpha[..., None]], axis=2)
    both = resize(both, out_h, out_w)
    a = np.clip(both[..., 3], 0, 1)
    colour = np.where(a[..., None] > 1e-6, np.clip(both[..., :3], 0, None) / np.maximum(a, 1e-6)[..., None], 0)
    colour = np.clip(colour, 0, 1)
    if scale < 0.9:
        sharp = colour + 0.35 * (colour - gaussian(colour, 1.0))
        colour = np.clip(colour + (sharp - colour) * (a * a)[..., None], 0, 1)
    return colour, a


def resampled(rgb: np.ndarray, alpha: np.ndarray, out_h: int, out_w: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """What `resample` makes, without rows and columns that no alpha reaches, which are zero: colour, alpha, and the first row and column."""
    h, w = alpha.shape
    ys, xs = np.flatnonzero(alpha.any(axis=1)), np.flatnonzero(alpha.any(axis=0))
    if out_w / w < 0.9 or (out_h, out_w) == (h, w) or not len(ys):
        return *resample(rgb, alpha, out_h, out_w), 0, 0
    own, kind = (slice(ys[0], ys[-1] + 1), slice(xs[0], xs[-1] + 1)), "lanczos" if out_w < w else "cubic"
    (top, rows), (left, cols) = reached(h, out_h, kind, int(ys[0]), int(ys[-1])), reached(w, out_w, kind, int(xs[0]), int(xs[-1]))
    part = alpha[own]
    both = np.empty((4, *part.shape))
    both[:3], both[3] = np.moveaxis(rgb[own], 2, 0) * part, part
    both = rows @ both @ cols.T
    a = np.clip(both[3], 0, 1)
    colour = np.where(a > 1e-6, np.clip(np.clip(both[:3], 0, None) / np.maximum(a, 1e-6), 0, 1), 0)
    return np.moveaxis(colour, 0, 2), a, top, left


def fill_polygon(points: list[tuple[int, int]], height: int, width: int) -> np.ndarray:
    """Cells whose centre is inside a polygon of (y, x) vertices, by crossing parity; borders included."""
    yy, xx = np.mgrid[0:height, 0:width]
    inside, border = np.zeros((height, width), bool), np.zeros((height, width), bool)
    for (y0, x0), (y1, x1) in zip(points, points[1:] + points[:1], strict=True):
        crosses = (y0 > yy) != (y1 > yy)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = x0 + (yy - y0) * (x1 - x0) / (y1 - y0 if y1 != y0 else 1)
        inside ^= crosses & (xx < at)
        steps = max(abs(y1 - y0), abs(x1 - x0), 1)
        for k in range(steps + 1):
            y, x = round(y0 + (y1 - y0) * k / steps), round(x0 + (x1 - x0) * k / steps)
            if 0 <= y < height and 0 <= x < width:
                border[y, x] = True
    return inside | border


def median(values: np.ndarray) -> np.ndarray:
    """The median of each column, or of a list of values."""
    k = len(values) // 2
    if len(values) % 2:
        return np.partition(values, k, axis=0)[k]
    part = np.partition(values, (k - 1, k), axis=0)
    return (part[k - 1] + part[k]) / 2


def ragged(values: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (n, h, w, channels) in masks (n, h, w), sorted: (n, channels, most), each filled up with infinity, and how many each has."""
    n, counts = len(masks), masks.sum(axis=(1, 2))
    out = np.full((n, int(counts.max(initial=1)) or 1, values.shape[3]), np.inf)
    out[np.arange(out.shape[1]) < counts[:, None]] = values[masks]
    return np.sort(np.moveaxis(out, 1, 2), axis=2), counts


def middle(row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The medians of `ragged` values; 0 of none."""
    high, low = (np.take_along_axis(row, np.maximum(at, 0)[:, None, None], axis=2)[..., 0] for at in (counts // 2, (counts - 1) // 2))
    return np.where(counts[:, None] > 0, np.where(counts[:, None] % 2 == 1, high, (low + high) / 2), 0)


def medians(values: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The median of each channel in each mask, (n, channels); 0 where a mask is empty."""
    if len(masks) == 1:
        return median(values[masks])[None] if masks.any() else np.zeros((1, values.shape[3]))
    return middle(*ragged(values, masks))


# Fixed values of the backdrop fit and the shadow ratio.
LUMA = np.array([0.2126, 0.7152, 0.0722])
CLEAR, MIN_GROUND, TOP_PERCENT, FEW, TOLERANCE, GATE = 0.02, 0.05, 70.0, 32, 0.05, 0.5
DEAD_BAND, MOST_RATIO, MOST_SHADOW, SMOOTH = 0.02, 3.0, 0.35, 1.0


@_kept
def _terms(height: int, width: int) -> np.ndarray:
    """The quadratic terms of every cell, as in `pixels.plate_sums`."""
    v, u = (np.linspace(-0.5, 0.5, n) if n > 1 else np.array([-0.5]) for n in (height, width))
    return np.stack(np.broadcast_arrays(1.0, u, v[:, None], u * u, u * v[:, None], (v * v)[:, None]), axis=-1)


def plate(rgb: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A quadratic fit of the backdrop, how uniform it is (0..1) and the backdrop's share of the frame.

    Fitted are the brightest of the backdrop's cells, or all of them where those are few. Too little
    backdrop gives a plate of middle grey and no uniformity.
    """
    h, w = alpha.shape
    ground = erode(alpha <= CLEAR, ellipse(5))
    share = float(ground.mean())
    if share < MIN_GROUND:
        return np.full_like(rgb, 0.5), 0.0, share
    lum = rgb @ LUMA
    bright = ground & (lum >= np.percentile(lum[ground], TOP_PERCENT))
    bright = ground if bright.sum() < FEW else bright
    terms = _terms(h, w)
    some, seen = terms[bright], rgb[bright]
    fit = np.linalg.pinv(some.T @ some, hermitian=True) @ (some.T @ seen)  # sums over the cells, then six unknowns a channel
    whole = np.clip(terms @ fit, 1e-4, 1)
    missed = median(np.abs(seen - some @ fit).ravel())  # over all channels
    level = median(whole[bright] @ LUMA) + 1e-6
    return whole, float(np.clip(1 - missed / level / TOLERANCE, 0, 1)), share


def shadow_ratio(rgb: np.ndarray, alpha: np.ndarray, whole: np.ndarray) -> np.ndarray | None:
    """Picture over backdrop in luminance: smoothed over visible backdrop alone, 1 where it is close to 1 and under the product.

    None if nothing is shaded, or more of the visible backdrop than a shadow covers.
    """
    ratio = np.clip((rgb @ LUMA) / np.maximum(whole @ LUMA, 1e-4), 0, MOST_RATIO)
    visible = alpha <= CLEAR
    weight = gaussian(visible.astype(float), SMOOTH)
    ratio = np.where(weight > 1e-3, gaussian(ratio * visible, SMOOTH) / np.maximum(weight, 1e-6), 1.0)
    ratio = np.where((np.abs(ratio - 1) <= DEAD_BAND) | ~visible, 1.0, ratio)
    shaded = ratio != 1
    if not shaded.any() or shaded[visible].mean() > MOST_SHADOW:
        return None
    return ratio


#: Pictures of more cells are fitted one by one: their values in order would take more room than is near the processor.
FEW_CELLS = 2048


def plates(rgb: np.ndarray, alpha: np.ndarray, whole: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """`plate` for pictures (n, h, w, 3) with alpha (n, h, w): fits (None for large pictures if they are not wanted), uniformities and shares."""
    return _plates_together(rgb, alpha) if alpha[0].size <= FEW_CELLS else _plates_singly(rgb, alpha, whole)


def _plates_together(rgb: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, h, w = alpha.shape
    whole, uniformity = np.full(rgb.shape, 0.5), np.zeros(n)
    ground = erode(alpha <= CLEAR, ellipse(5))
    share = ground.mean(axis=(1, 2))
    enough = share >= MIN_GROUND
    if not enough.any():
        return whole, uniformity, share
    rgb, ground = (rgb, ground) if enough.all() else (rgb[enough], ground[enough])
    n = len(rgb)
    lum = (rgb.reshape(-1, 3) @ LUMA).reshape(n, h, w)
    row, counts = ragged(lum[..., None], ground)
    at, part = np.divmod((counts - 1) * (TOP_PERCENT / 100), 1)  # between two values, as numpy's percentile
    low, high = (np.take_along_axis(row[:, 0], np.minimum(k, counts - 1)[:, None], axis=1)[:, 0] for k in (at.astype(int), at.astype(int) + 1))
    cut = np.where(part < 0.5, low + (high - low) * part, high - (high - low) * (1 - part))
    bright = ground & (lum >= cut[:, None, None])
    bright = np.where(bright.sum(axis=(1, 2))[:, None, None] < FEW, ground, bright)
    terms, flat = _terms(h, w).reshape(h * w, -1), rgb.reshape(n, h * w, 3)
    seen = terms.T * bright.reshape(n, 1, -1)
    fit = np.linalg.pinv(seen @ terms, hermitian=True) @ (seen @ flat)
    plane = (terms @ fit).reshape(rgb.shape)
    filled = np.clip(plane, 1e-4, 1)
    off = np.abs(rgb - plane)
    missed, level = (middle(*ragged(v, m))[:, 0] for v, m in ((off.reshape(n, h, w * 3, 1), bright.repeat(3, axis=2)), ((filled.reshape(-1, 3) @ LUMA).reshape(n, h, w, 1), bright)))
    whole[enough], uniformity[enough] = filled, np.clip(1 - missed / (level + 1e-6) / TOLERANCE, 0, 1)
    return whole, uniformity, share


def _percentile(values: np.ndarray, percent: float) -> float:
    """As numpy's, between two values."""
    at, part = divmod((len(values) - 1) * (percent / 100), 1)
    low, high = np.partition(values, (int(at), min(int(at) + 1, len(values) - 1)))[[int(at), min(int(at) + 1, len(values) - 1)]].tolist()
    return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


def _plates_singly(rgb: np.ndarray, alpha: np.ndarray, whole: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    n, h, w = alpha.shape
    uniformity = np.zeros(n)
    ground = erode(alpha <= CLEAR, ellipse(5))
    share = ground.mean(axis=(1, 2))
    enough = np.flatnonzero(share >= MIN_GROUND).tolist()
    terms, flat, ground = _terms(h, w).reshape(h * w, -1), rgb.reshape(n, h * w, 3), ground.reshape(n, -1)
    lum, seen = flat @ LUMA, []
    sums, right = np.empty((len(enough), terms.shape[1], terms.shape[1])), np.empty((len(enough), terms.shape[1], 3))
    for j, k in enumerate(enough):
        own = np.flatnonzero(ground[k])
        light = lum[k, own]
        bright = own[light >= _percentile(light, TOP_PERCENT)]
        bright = own if len(bright) < FEW else bright
        some, colours = terms[bright], flat[k, bright]
        sums[j], right[j] = some.T @ some, some.T @ colours
        seen.append((some, colours))
    fits = np.linalg.pinv(sums, hermitian=True) @ right
    for k, fit, (some, colours) in zip(enough, fits, seen, strict=True):
        plane = some @ fit
        missed, level = median(np.abs(colours - plane).ravel()), median(np.clip(plane, 1e-4, 1) @ LUMA) + 1e-6
        uniformity[k] = min(1.0, max(0.0, 1 - missed / level / TOLERANCE))
    if not whole:
        return None, uniformity, share
    out = np.full(rgb.shape, 0.5)
    if enough:
        out[enough] = np.clip(terms @ fits, 1e-4, 1).reshape(-1, h, w, 3)
    return out, uniformity, share


def shadow_ratios(rgb: np.ndarray, alpha: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`shadow_ratio` for pictures (n, h, w, 3), and which of them have one."""
    n, h, w = alpha.shape
    light, back = ((v.reshape(-1, 3) @ LUMA).reshape(n, h, w) for v in (rgb, whole))
    ratio = np.clip(light / np.maximum(back, 1e-4), 0, MOST_RATIO)
    visible = alpha <= CLEAR
    weight = gaussian(visible.astype(float), SMOOTH, (1, 2))
    ratio = np.where(weight > 1e-3, gaussian(ratio * visible, SMOOTH, (1, 2)) / np.maximum(weight, 1e-6), 1.0)
    ratio = np.where((np.abs(ratio - 1) <= DEAD_BAND) | ~visible, 1.0, ratio)
    shaded = ratio != 1  # lies in what is visible
    many, seen = shaded.sum(axis=(1, 2)), visible.sum(axis=(1, 2))
    return ratio, (many > 0) & (many / np.maximum(seen, 1) <= MOST_SHADOW)


def box_above(field: np.ndarray, threshold: float) -> tuple[int, int, int, int]:
    """Half-open bounds (x0, y0, x1, y1) of the cells above a threshold; zeros if there are none."""
    above = field > threshold
    ys, xs = np.flatnonzero(above.any(axis=1)), np.flatnonzero(above.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else (0, 0, 0, 0)


def boxes_above(fields: np.ndarray, threshold: float) -> list[tuple[int, int, int, int]]:
    """`box_above` of each field (n, h, w)."""
    above = fields > threshold
    _, h, w = above.shape
    ys, xs = above.any(axis=2), above.any(axis=1)
    some = ys.any(axis=1)
    ends = (xs.argmax(axis=1), ys.argmax(axis=1), w - xs[:, ::-1].argmax(axis=1), h - ys[:, ::-1].argmax(axis=1))
    return list(zip(*(np.where(some, end, 0).tolist() for end in ends), strict=True))


@_kept
def _area_weights(size: int, out: int) -> np.ndarray:
    """Each output cell's mean over the input it covers."""
    edges = np.arange(out + 1) * size / out
    cell = np.arange(size)
    return np.clip(np.minimum(edges[1:, None], cell + 1) - np.maximum(edges[:-1, None], cell), 0, None) * out / size


@_kept
def _linear_weights(size: int, out: int) -> np.ndarray:
    centre = np.clip((np.arange(out) + 0.5) * size / out - 0.5, 0, size - 1)
    low = np.minimum(np.floor(centre).astype(int), max(size - 2, 0))
    matrix = np.zeros((out, size))
    np.add.at(matrix, (np.arange(out), low), 1 - (centre - low))
    np.add.at(matrix, (np.arange(out), np.minimum(low + 1, size - 1)), centre - low)
    return matrix


def fit(field: np.ndarray, height: int, width: int) -> np.ndarray:
    """A field at another size: means of what a cell covers where either side shrinks, else linear between cells."""
    if field.shape[:2] == (height, width):
        return field
    kind = _area_weights if width < field.shape[1] or height < field.shape[0] else _linear_weights
    tall = np.tensordot(kind(field.shape[0], height), field, axes=(1, 0))
    return np.moveaxis(np.tensordot(tall, kind(field.shape[1], width), axes=(1, 1)), -1, 1)
