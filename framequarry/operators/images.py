"""Images as rows: decoding, cutting out, shading, placing, flattening, encoding - as functions of one picture and as narrow maps over rows.

A decoded image is a row with width, height, rgb (linear light, float32, row-major, channels last) and alpha
(float32, or null where the file has none), and with `error` (code, message, retryable), null if all is
well. A failure is a row like any other: later steps pass it through, so one bad file stops nothing. Rows
with an error, and null payloads, keep their other columns. A step holds one image at a time; Arrow
batches are bounded in bytes. Nothing here shuffles. Empty tables give empty ones.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions import color, formats, web
from ..functions.session import python_ready
from ..sources import eps, jpeg, rasters, webp
from . import autopick, kernels, masks, rules

ERROR = "struct<code: string, message: string, retryable: boolean>"
PIXELS = "width int, height int, rgb binary, alpha binary"
# Edges are cleaned from this uniformity on; a vendor's upload and the least it is shrunk to; a thumbnail's long edge.
CLEAN_FROM, UPLOAD_BYTES, UPLOAD_EDGE, THUMBNAIL = 0.25, 20 << 20, 1024, 768
BAND, FLOOR, RAMP_END = 7, 0.08, 0.25
#: What a task makes is passed on whenever it holds so many bytes.
MADE = 4 << 20


_SIMPLE = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(kind: DataType) -> pa.DataType:
    """The Arrow type of the types that steps return."""
    if isinstance(kind, ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return _SIMPLE[kind.simpleString()]


class Failed(ValueError):
    """What a step raises to fail its row: a code of `rules.ERRORS`, a message that may be shown, and what is known all the same."""

    def __init__(self, code: str, message: str, known: dict[str, Any] | None = None):
        super().__init__(message)
        self.info = {"code": code, "message": message, "retryable": rules.ERRORS[code]}
        self.known = known or {}


def _bytes_in(value: Any) -> int:
    """How many bytes a step's values hold, about."""
    if isinstance(value, bytes):
        return len(value)
    return sum(map(_bytes_in, value.values() if isinstance(value, dict) else value)) if isinstance(value, dict | list) else 8


Row = dict[str, Any]
#: What became of a row: a step's values and the error, if there is one.
Outcome = tuple[Row, Row | None]


def _told(out: Row | Failed) -> Outcome:
    return (out.known, out.info) if isinstance(out, Failed) else (out, None)


def _taken(step: Callable[[Row], Row | Failed], row: Row) -> Outcome:
    try:
        return _told(step(row))
    except Failed as failure:
        return failure.known, failure.info
    except Exception:  # noqa: BLE001  (a row's failure is that row's)
        return {}, Failed("internal_error", "This picture met a fault of the library.").info


def each_image(images: DataFrame, step: Callable[[Row], Row], returns: str, given: tuple[str, ...] | None = None) -> DataFrame:
    """Adds (or replaces) the columns `returns` (DDL) of step(row), and `error`; rows that have an error are passed by.

    step gets the columns `given` (all, if None). Small results are passed on together. `Failed` fails the row with its code, anything else as an
    internal error without detail.
    """
    return _mapped(images, lambda rows: (_taken(step, row) for row in rows), returns, given)


def each_stack(images: DataFrame, step: Callable[[list[Row]], list[Row | Failed]], returns: str, given: tuple[str, ...] | None = None, size: Callable[[Row], int] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """As `each_image`, for a step of several rows at once, which gives a row's values, or its failure, for each. Together are rows that follow
    one another and whose given values (or size(row)) hold at most MADE bytes, or one row. Where a step fails, its rows are taken one by one.
    Columns `without` are not passed on.
    """

    def outcomes(rows: Iterator[Row]) -> Iterator[Outcome]:
        held, many = [], 0
        for row in rows:
            own = _bytes_in(row) if size is None else size(row)
            if held and many + own > MADE:
                yield from stack(held)
                held, many = [], 0
            held.append(row)
            many += own
        if held:
            yield from stack(held)

    def stack(rows: list[Row]) -> list[Outcome]:
        try:
            return [_told(out) for _, out in zip(rows, step(rows), strict=True)]
        except Exception:  # noqa: BLE001  (whose fault it is shows one by one)
            return [_taken(lambda r: step([r])[0], row) for row in rows]

    return _mapped(images, outcomes, returns, given, without)


def _mapped(images: DataFrame, outcomes: Callable[[Iterator[Row]], Iterator[Outcome]], returns: str, given: tuple[str, ...] | None, without: tuple[str, ...] = ()) -> DataFrame:
    """Rows with what becomes of them; outcomes gets those without an error, in order, a batch at a time."""
    python_ready(images.sparkSession, 64)
    names = StructType.fromDDL(returns).names
    kept = [c for c in images.columns if c not in names and c != "error" and c not in without]
    ddl = ", ".join([*(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in kept), returns, f"error {ERROR}"])
    had = "error" in images.columns
    shape = StructType.fromDDL(ddl)
    wanted = tuple(c for c in (given or images.columns) if c != "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [batch.schema.field(c) for c in kept] + [pa.field(f.name, _arrow(f.dataType)) for f in shape.fields[len(kept) :]]
            schema = pa.schema(fields)
            errors = batch.column("error").to_pylist() if had else [None] * batch.num_rows
            given_columns = [(c, batch.column(c)) for c in wanted]

            def made(begin: int, rows: list[dict[str, Any]]) -> pa.RecordBatch:
                part = batch.slice(begin, len(rows))  # noqa: B023  (used before the next batch)
                return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array([r.get(f.name) for r in rows], f.type) for f in fields[len(kept) :])], schema=schema)  # noqa: B023

            begin, rows, size = 0, [], 0
            found = outcomes({c: column[k].as_py() for c, column in given_columns} for k in range(batch.num_rows) if errors[k] is None)  # noqa: B023
            for k in range(batch.num_rows):
                out, error = ({}, errors[k]) if errors[k] is not None else next(found)
                rows.append({n: out.get(n) for n in names} | {"error": error})
                size += _bytes_in(out)
                if size >= MADE:
                    yield made(begin, rows)
                    begin, rows, size = k + 1, [], 0
            if rows:
                yield made(begin, rows)

    return images.mapInArrow(run, ddl)


def packed(field: np.ndarray | None) -> bytes | None:
    return None if field is None else np.ascontiguousarray(field, "<f4").tobytes()


def pixels_of(row: dict[str, Any]) -> tuple[np.ndarray, np.ndarray | None]:
    """rgb (h, w, 3) and alpha (h, w) or None of a decoded row."""
    h, w = row["height"], row["width"]
    alpha = row.get("alpha")
    return np.frombuffer(row["rgb"], "<f4").reshape(h, w, 3).astype(float), None if alpha is None else np.frombuffer(alpha, "<f4").reshape(h, w).astype(float)


def linear(encoded: np.ndarray) -> np.ndarray:
    return np.where(encoded <= 0.04045, encoded / 12.92, ((np.maximum(encoded, 0) + 0.055) / 1.055) ** 2.4)


def encoded(light: np.ndarray) -> np.ndarray:
    c = np.clip(light, 0, 1)
    return np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055)


def levels(values: np.ndarray, top: int = 255) -> np.ndarray:
    return np.floor(np.clip(values, 0, 1) * top + 0.5).astype(np.uint8 if top == 255 else np.uint16)


#: So many equal bins of linear light are looked up first.
BINS = 1 << 14


def _curve(light: np.ndarray, profile: str | None) -> np.ndarray:
    """Light of a profile's own primaries, 0 to 1, to its encoded values."""
    return light ** (1 / color.ADOBE_GAMMA) if profile == "adobe" else encoded(light)


@lru_cache
def _thresholds(profile: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """The least light of each level from 1 on; of each bin of light the level it begins with and the least light of the next one; the most levels
    that begin in one bin, and the last bin with more than one."""
    low, high = np.zeros(255, np.int64), np.full(255, np.float64(1).view(np.int64))  # positive numbers are in the order of their bits
    while (high - low > 1).any():
        middle = (low + high) >> 1
        enough = levels(_curve(middle.view(np.float64), profile)) > np.arange(255)
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    least = np.append(high.view(np.float64), np.inf)
    begins = np.searchsorted(least, np.arange(BINS + 1) / BINS * (1 - 1e-12), side="right")
    many = np.diff(begins, append=255)
    return least, begins.astype(np.uint8), least[begins], int(many.max()), int(np.flatnonzero(many > 1)[-1]) if many.max() > 1 else -1


def light_levels(light: np.ndarray, profile: str | None = None) -> np.ndarray:
    """`levels` of light as a profile's curve encodes it, by looking up where levels begin."""
    least, begins, following, most, crowded = _thresholds("adobe" if profile == "adobe" else None)
    light = np.clip(light, 0, 1)
    place = (light * BINS).astype(np.intp)
    level = begins[place]
    level += light >= following[place]
    if most > 1:
        dark = place <= crowded
        some, few = light[dark], level[dark]
        for _ in range(most - 1):
            few += some >= least[few]
        level[dark] = few
    return level


# -- reading ------------------------------------------------------------------------------------


def opened(data: bytes | None, most_bytes: int = 0, most_pixels: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """A file's linear light (h, w, 3) and alpha, turned and converted from its profile. Caps: 0 is none.

    Too large, not readable and not an image are three different errors.
    """
    if data is None:
        raise Failed("image_decode_failed", "No bytes came with this row.")
    if most_bytes and len(data) > most_bytes:
        raise Failed("file_too_large", f"{len(data)} bytes, and {most_bytes} are allowed.")
    try:
        w, h = rasters.dimensions(data)
        if most_pixels and w * h > most_pixels:
            raise Failed("file_too_large", f"{w} by {h} pixels, and {most_pixels} are allowed.")
        return rasters.light(rasters.read(data))
    except rasters.Unsupported as error:
        raise Failed("unsupported_file", str(error)) from error
    except Failed:
        raise
    except Exception as error:
        raise Failed("image_decode_failed", "These bytes hold no picture that can be read.") from error


def decode(files: DataFrame, most_bytes: int = 0, most_pixels: int = 0, payload: str = "payload") -> DataFrame:
    """Files (column `payload`) to pixels, as `opened` reads them."""

    def step(row: dict[str, Any]) -> dict[str, Any]:
        rgb, alpha = opened(row[payload], most_bytes, most_pixels)
        return {"width": rgb.shape[1], "height": rgb.shape[0], "rgb": packed(rgb), "alpha": packed(alpha)}

    return each_image(files, step, PIXELS, (payload,))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that the JVM's image source reads (JPEG among them), as decoded rows: name, width, height, rgb, alpha, error.

    The source skips nothing: a file it cannot read has a null image and gets an error here.
    """
    read = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")

    def step(row: dict[str, Any]) -> dict[str, Any]:
        if row["height"] < 0 or row["data"] is None:
            raise Failed("image_decode_failed", "These bytes hold no picture that can be read.")
        values = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"]) / 255.0
        colour = values[..., 2::-1] if row["nChannels"] >= 3 else np.repeat(values[..., :1], 3, axis=2)
        return {"width": row["width"], "rgb": packed(linear(colour)), "alpha": packed(values[..., 3]) if row["nChannels"] == 4 else None, "height": row["height"]}

    made = each_image(read, step, PIXELS)
    return made.select(F.col("origin").alias("name"), "width", "height", "rgb", "alpha", "error")


def dimensions(payload: Column) -> Column:
    """Width and height of a PNG or BMP from its first bytes, in SQL; null for anything else."""

    def number(at: int, little: bool) -> Column:
        bytes_ = [F.conv(F.hex(F.substring(payload, at + (3 - k if little else k), 1)), 16, 10).cast("long") for k in range(4)]
        return bytes_[0] * (1 << 24) + bytes_[1] * (1 << 16) + bytes_[2] * 256 + bytes_[3]

    head = F.hex(F.substring(payload, 1, 8))
    height = number(23, True)  # counted from the top where negative
    rows = F.when(height >= 1 << 31, (1 << 32) - height).otherwise(height)
    return F.when(head == "89504E470D0A1A0A", F.struct(number(17, False).alias("width"), number(21, False).alias("height"))).when(head.startswith("424D"), F.struct(number(19, True).alias("width"), rows.alias("height")))


def sizes(files: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds width and height of every format from its header or directory, without decoding; null where there is none."""

    def step(row: dict[str, Any]) -> dict[str, Any]:
        try:
            return dict(zip(("width", "height"), rasters.dimensions(row[payload] or b""), strict=True))
        except Exception:  # noqa: BLE001  (whatever stands in the file)
            return {}

    return each_image(files, step, "width int, height int", (payload,))


# -- cutting out --------------------------------------------------------------------------------

#: A segmenter: the picture as a PNG and its size to an alpha of any size in 0..1 (or a PNG whose fourth channel is it). One that runs in
#: the task may have a function `together`: what those PNGs hold, levels (n, h, w, 3) of pictures of one size, to an alpha or a `Failed` for each.
Engine = Callable[[bytes, int, int], "np.ndarray | bytes"]


def alpha_of_cutout(data: bytes, width: int, height: int) -> np.ndarray:
    """The alpha of a cut-out PNG at the source's size; a picture without one is opaque."""
    values = rasters.decode_png(data)
    alpha = values[..., -1] if values.shape[2] in (2, 4) else np.ones(values.shape[:2])
    return np.clip(kernels.fit(alpha, height, width), 0, 1)


def under_budget(rgb: np.ndarray, most_bytes: int = UPLOAD_BYTES, least_edge: int = UPLOAD_EDGE) -> tuple[bytes, bool]:
    """A picture as a PNG that fits an upload: as it is, else its long edge halved until it fits or is as short as it may be."""
    h, w = rgb.shape[:2]
    data, edge = rasters.encode_png(light_levels(rgb)), max(h, w)
    small = False
    while len(data) > most_bytes and edge > least_edge:
        edge = max(least_edge, edge // 2)
        scale = edge / max(h, w)
        data, small = rasters.encode_png(levels(encoded(kernels.fit(rgb, max(1, round(h * scale)), max(1, round(w * scale)))))), True
    return data, small


CANDIDATE = "struct<engine: string, pool_pos: int, mask: binary, cost: double, score: double, soft: double, reason: string, recovered: boolean, code: string>"


def candidates_of(images: DataFrame, pool: list[tuple[str, Engine, float]]) -> DataFrame:
    """Every picture with every engine of a pool (name, engine, price): adds `candidates`, one entry an engine, and `own_mask`.

    The plug-in surface: an engine gives alpha only, never colour, and raises `Failed` for its own errors,
    which become the entry's code and cost nothing. A picture that comes with a mask is sent to no engine. If
    no mask is usable, fragmented ones are measured again as their largest object alone.
    """

    def step(row: dict[str, Any]) -> dict[str, Any]:
        rgb, alpha = pixels_of(row)
        if alpha is not None and alpha.min() < 0.999:
            return {"candidates": [], "own_mask": row["alpha"]}
        return {"candidates": [e | {"mask": packed(e["mask"])} for e in asked(rgb, pool)], "own_mask": None}

    return each_image(images, step, f"candidates array<{CANDIDATE}>, own_mask binary", ("width", "height", "rgb", "alpha"))


Box = tuple[int, int, int, int]


def called(name: str, remove: Engine, price: float, pos: int, upload: bytes, w: int, h: int) -> dict[str, Any]:
    """One engine's entry: its mask with measures, or the code of its failure."""
    try:
        got = remove(upload, w, h)
        mask = alpha_of_cutout(got, w, h) if isinstance(got, bytes) else _fitted(got, w, h)
    except Failed as failure:
        return _entry(name, price, pos, failure)
    return _entry(name, price, pos, levels(mask, 65535) / 65535)  # as it is kept, so that a later run finds the same


def _fitted(alpha: Any, w: int, h: int) -> np.ndarray:
    return np.clip(kernels.fit(np.asarray(alpha, float), h, w), 0, 1)


def _entry(name: str, price: float, pos: int, got: np.ndarray | Failed) -> dict[str, Any]:
    entry = dict.fromkeys(("mask", "score", "soft", "reason", "code")) | {"engine": name, "pool_pos": pos, "cost": 0.0, "recovered": False}
    return entry | ({"code": got.info["code"]} if isinstance(got, Failed) else {"mask": got, "cost": price})


def asked(rgb: np.ndarray, pool: list[tuple[str, Engine, float]], box: Box | None = None, known: dict[str, np.ndarray] | None = None) -> list[dict[str, Any]]:
    """`all_asked` for one picture; a fault of an engine is raised."""
    entries = all_asked(rgb[None], pool, [box], [known or {}])[0]
    if isinstance(entries, Exception):
        raise entries
    return entries


def all_asked(rgb: np.ndarray, pool: list[tuple[str, Engine, float]], boxes: list[Box | None], known: list[dict[str, np.ndarray]], owners: Sequence[int] | None = None) -> list[list[dict[str, Any]] | Exception]:
    """The entries of a pool for each picture (n, h, w, 3), or for a box of it: masks of the whole frame, empty outside the box. Boxes of
    `owners`, pictures by place, need not be one a picture.

    Engines in a picture's `known` are not called: their masks (of the box) are taken at no cost. If no mask is usable, fragmented
    ones are measured again as their largest object alone. Where an engine raises what is no `Failed`, that picture gets the exception
    in place of entries, so that the others' calls are not made again.
    """
    _, h, w, _ = rgb.shape
    n, owners = len(boxes), range(len(rgb)) if owners is None else owners
    spots = [box or (0, 0, w, h) for box in boxes]
    uploads: dict[int, bytes] = {}
    out: list[list[dict[str, Any]]] = [[] for _ in range(n)]
    faults: dict[int, Exception] = {}
    for pos, (name, remove, price) in enumerate(pool):
        at_once = _called_together(rgb, owners, name, remove, price, pos, {k: spot for k, spot in enumerate(spots) if name not in known[k] and k not in faults})
        for k, (x0, y0, x1, y1) in enumerate(spots):
            if k in faults:
                continue
            try:
                if name in known[k]:
                    entry = _entry(name, 0.0, pos, _fitted(known[k][name], x1 - x0, y1 - y0)) | {"hit": True}
                elif k in at_once:
                    entry = at_once[k]
                else:
                    if k not in uploads:
                        uploads[k] = under_budget(rgb[owners[k], y0:y1, x0:x1])[0]
                    entry = called(name, remove, price, pos, uploads[k], x1 - x0, y1 - y0)
            except Exception as fault:  # noqa: BLE001  (that picture's alone)
                faults[k] = fault
                continue
            if entry["mask"] is not None:
                entry["answer"] = entry["mask"]
                if boxes[k]:
                    entry["mask"] = np.zeros((h, w))
                    entry["mask"][y0:y1, x0:x1] = entry["answer"]
            out[k].append(entry)
    answered = [e for entries in out for e in entries if e["mask"] is not None]
    if answered:
        for e, m in zip(answered, measured(np.stack([e["mask"] for e in answered])), strict=True):
            e.update(score=m["score"], soft=m["soft"], reason=m["reason"])
    for entries in out:
        if not any(e["score"] is not None for e in entries):
            for e in entries:
                alone = kernels.isolate_largest(e["mask"]) if e["reason"] == "fragmented" else None
                if alone is not None and (m := measures(alone))["score"] is not None:
                    e.update(mask=alone, score=m["score"], soft=m["soft"], reason=None, recovered=True)
    return [faults.get(k, entries) for k, entries in enumerate(out)]


def _called_together(rgb: np.ndarray, owners: Sequence[int], name: str, remove: Engine, price: float, pos: int, spots: dict[int, Box]) -> dict[int, dict[str, Any]]:
    """Entries of an engine that takes several pictures, by picture: boxes of one size are one call. Empty if it takes one PNG a call, or a PNG might have to be shrunk."""
    together = getattr(remove, "together", None)
    sizes: dict[tuple[int, int], list[int]] = {}
    for k, (x0, y0, x1, y1) in spots.items():
        if together is not None and (y1 - y0) * (3 * (x1 - x0) + 1) * 1.01 + 4096 < UPLOAD_BYTES:
            sizes.setdefault((y1 - y0, x1 - x0), []).append(k)
    out = {}
    for (h, w), places in sizes.items():
        parts = np.stack([rgb[owners[k], spots[k][1] : spots[k][3], spots[k][0] : spots[k][2]] for k in places])
        try:
            answers = list(together(light_levels(parts)))
        except Exception:  # noqa: BLE001  (whose fault it is shows one by one)
            continue
        for k, got in zip(places, answers, strict=True):
            out[k] = _entry(name, price, pos, got if isinstance(got, Failed) else levels(_fitted(got, w, h), 65535) / 65535)
    return out


ATTEMPTS = 3


def patient(remove: Engine, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Engine:
    """An engine that is called again after failures that may pass, waiting as long as it asks for (`Failed.known["retry_after"]`) or ever longer."""

    def called_again(data: bytes, width: int, height: int) -> np.ndarray | bytes:
        for attempt in range(attempts):
            try:
                return remove(data, width, height)
            except Failed as failure:
                if not failure.info["retryable"] or attempt == attempts - 1:
                    raise
                asked_for = failure.known.get("retry_after")
                sleep(web.FIRST_WAIT * 2**attempt if asked_for is None else min(asked_for, web.LONGEST_WAIT))  # as `web.retry_delay`
        raise Failed("vendor_error", "An engine has to be called at least once.")

    return called_again


#: Asked which of two cut-outs (PNG) is better, the first or the second; anything else is no answer. With its price. One that runs in the
#: task may have a function `pixels` that takes what those PNGs hold: levels (h, w, 4).
Judge = tuple[Callable[[bytes, bytes], "str | None"], float]


def verdict(entries: list[dict[str, Any]], judge: Judge | None = None, rgb: np.ndarray | None = None) -> dict[str, Any]:
    """What `chosen` makes of a row's candidates: mask, chosen_engine, score, gap, cost and cutout_notes; raises if no mask is usable.

    Where the first two of exactly two usable masks tie, a judge is asked twice, with sides swapped, and overrules the
    order if it names the same mask both times. A judge that fails changes nothing but the cost.
    """
    usable = sorted((e for e in entries if e["score"] is not None), key=lambda e: (-e["score"], e["pool_pos"]))
    cost = sum(e["cost"] for e in entries)
    answered = [e["pool_pos"] for e in entries if e["code"] is None]
    if not usable:
        if answered:
            refused = "; ".join(f"{e['engine']}: {e['reason']}" for e in entries if e["reason"] is not None)
            raise Failed("no_foreground_found", f"No mask of this picture can be used{f' ({refused})' if refused else ''}.", {"cost": cost})
        order = {code: k for k, code in enumerate(autopick.FAILURE_ORDER)}
        told = min((e for e in entries if e["code"] is not None), key=lambda e: (order.get(e["code"], len(order)), e["pool_pos"]), default={"code": "vendor_error"})
        raise Failed(told["code"], "None of the engines answered.", {"cost": cost})
    best, gap = usable[0], usable[0]["score"] - usable[1]["score"] if len(usable) > 1 else None
    tied, judged = gap is not None and gap < masks.TIE, False
    if tied and judge is not None and len(usable) == 2:
        cost += judge[1]
        try:
            colour, sees = light_levels(rgb), getattr(judge[0], "pixels", None)
            first, second = (np.concatenate([colour, levels(e["mask"])[..., None]], axis=2) for e in usable)
            if sees is None:
                sees, first, second = judge[0], rasters.encode_png(first), rasters.encode_png(second)
            there, back = sees(first, second), sees(second, first)
            judged = (there, back) in (("first", "second"), ("second", "first"))
            best = usable[1] if judged and there == "second" else best
        except Exception:  # noqa: BLE001  (a judgement is a help, never a failure)
            judged = False
    tests = {
        "single_engine_only": len(entries) == 1, "scene_largest_object": best["recovered"], "tiebreak_deterministic": tied and not judged, "tiebreak_vision": judged,
        "engine_fallback_used": best["pool_pos"] != min(answered), "alpha_suspect": best["score"] < masks.SUSPECT,
    }
    return {"mask": best["mask"], "chosen_engine": best["engine"], "score": round(best["score"], 4), "gap": None if gap is None else round(gap, 4), "cost": cost, "cutout_notes": [n for n, test in tests.items() if test]}


def chosen(images: DataFrame) -> DataFrame:
    """Picks among `candidates`, in the row: adds mask, chosen_engine, score, gap, cost and notes, and the error of a picture without a mask.

    Scores rank, the pool's order breaks ties. Cost counts all that answered, winners or not.
    """
    usable = F.array_sort(F.transform(F.filter("candidates", lambda c: c["score"].isNotNull()), lambda c: F.struct((-c["score"]).alias("low"), c["pool_pos"].alias("pool_pos"), c["engine"].alias("engine"), c["recovered"].alias("recovered"), c["mask"].alias("mask"))))
    failed = F.filter("candidates", lambda c: c["code"].isNotNull())
    rank = F.lit(len(autopick.FAILURE_ORDER))
    df = images.withColumn("usable", usable)
    best, second = F.get("usable", F.lit(0)), F.get("usable", F.lit(1))

    def told(c: Column) -> Column:
        k = rank
        for n, code in reversed(list(enumerate(autopick.FAILURE_ORDER))):
            k = F.when(c["code"] == code, F.lit(n)).otherwise(k)
        return F.struct(k.alias("k"), c["pool_pos"].alias("pool_pos"), c["code"].alias("code"))

    worst = F.array_min(F.transform(failed, told))["code"]
    answered = F.size(F.filter("candidates", lambda c: c["code"].isNull())) > 0
    refused = rules.rejection_text(F.col("candidates"))
    message = F.concat(F.lit("No mask of this picture can be used"), F.when(refused != "", F.concat(F.lit(" ("), refused, F.lit(")"))).otherwise(F.lit("")), F.lit("."))
    code = F.when(F.col("own_mask").isNotNull() | (F.size("usable") > 0), F.lit(None).cast("string")).when(answered, F.lit("no_foreground_found")).otherwise(F.coalesce(worst, F.lit("vendor_error")))
    note = {
        "single_engine_only": F.size("candidates") == 1, "scene_largest_object": best["recovered"], "tiebreak_deterministic": second["low"] - best["low"] < masks.TIE,
        "engine_fallback_used": best["pool_pos"] != F.array_min(F.transform(F.filter("candidates", lambda c: c["code"].isNull()), lambda c: c["pool_pos"])), "alpha_suspect": -best["low"] < masks.SUSPECT,
    }
    notes = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in note.items())))
    out = df.withColumns({
        "error": F.coalesce("error", rules.error_info(code, F.when(answered, message).otherwise(F.lit("None of the engines answered.")))),
        "mask": F.coalesce("own_mask", best["mask"]),
        "chosen_engine": best["engine"],
        "score": F.round(-best["low"], 4),
        "gap": F.round(second["low"] - best["low"], 4),
        "cost": F.aggregate(F.transform("candidates", lambda c: c["cost"]), F.lit(0.0), lambda a, x: a + x),
        "cutout_notes": notes,
    })
    return out.drop("usable", "candidates", "own_mask")


# Fixed values of keying: the ring's share of the shorter side, and what stands out from the backdrop in hue, darker and brighter.
RING, HUE, DARKER, BRIGHTER, UNSOLVABLE = 0.04, 0.03, 0.25, 1.12, 1e-6


def _tall(masks: np.ndarray) -> np.ndarray:
    """Masks (n, h, w) as one with a clear row below each."""
    n, h, w = masks.shape
    tall = np.zeros((n, h + 1, w), bool)
    tall[:, :h] = masks
    return tall.reshape(-1, w)


def _parted(tall: np.ndarray, n: int) -> np.ndarray:
    return tall.reshape(n, -1, tall.shape[1])[:, :-1].astype(bool)


def largest_pieces(masks: np.ndarray) -> np.ndarray:
    """Of each mask (n, h, w) the largest of the pieces it is in, the first of those as large."""
    n, h, w = masks.shape
    runs = kernels.Runs(_tall(masks))
    if runs.count <= 1:
        return masks
    owner = np.zeros(runs.count, np.int64)
    owner[runs.labels - 1] = runs.first // (w * (h + 1))
    order = np.lexsort((-runs.sizes(), owner))
    best = np.zeros(runs.count + 1, bool)
    best[order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])] + 1] = True
    return _parted(runs.painted(best[runs.labels]), n)


def holes(masks: np.ndarray) -> np.ndarray:
    """Cells outside each mask (n, h, w), or one (h, w), that no way of side steps leads out of the picture from."""
    if masks.ndim == 2:
        return holes(masks[None])[0]
    (n, h, w), runs = masks.shape, kernels.Runs(_tall(~masks), diagonal=False)
    row = runs.first // w % (h + 1)
    border = (row == 0) | (row == h - 1) | (runs.first % w == 0) | (runs.last % w == 0)
    open_ends = np.zeros(runs.count + 1, bool)
    open_ends[runs.labels[border]] = True
    return _parted(runs.painted(~open_ends[runs.labels]), n)


def key_on_backdrop(rgb: np.ndarray) -> np.ndarray:
    """`keyed` for one picture (h, w, 3)."""
    return keyed(rgb[None])[0]


def keyed(rgb: np.ndarray) -> np.ndarray:
    """The offline segmenter for pictures (n, h, w, 3): coverage by a product in front of an even backdrop, shadows being backdrop; all zeros if nothing stands out.

    The backdrop is the median of a ring. Inside what differs from it in hue, or is far darker or brighter, lies the product's
    own median colour; a pixel's coverage is the mixture of both colours that comes nearest to it. Where that has no solution
    (a black product, or one that is only brighter), coverage is how far a pixel is on the way from one to the other. What is
    not part of the largest piece goes, and holes in that are filled.
    """
    n, h, w, _ = rgb.shape
    band = max(2, int(min(h, w) * RING))
    ring = np.ones((h, w), bool)
    ring[band : h - band, band : w - band] = False
    back = kernels.median(np.moveaxis(rgb[:, ring], 1, 0))
    each = lambda values: values[:, None, None]  # noqa: E731  (one value a picture)
    flat, total = rgb.reshape(n, h * w, 3), np.maximum(rgb[..., 0] + rgb[..., 1] + rgb[..., 2], 1e-6)
    lead = back[:, :2] / np.maximum(back.sum(axis=1), 1e-6)[:, None]
    hue = np.hypot(rgb[..., 0] / total - each(lead[:, 0]), rgb[..., 1] / total - each(lead[:, 1]))
    light = (flat @ kernels.LUMA).reshape(n, h, w) / each(np.maximum(back @ kernels.LUMA, 1e-6))
    small, wide = kernels.ellipse(5), kernels.ellipse(7)
    opened_up = lambda m: kernels.dilate(kernels.erode(m, small), small)
    rough = largest_pieces(opened_up((hue > HUE) | (light < DARKER) | (light > BRIGHTER)))
    inner_core = kernels.erode(rough, wide)
    core = np.where(each(inner_core.any(axis=(1, 2))), inner_core, rough)  # a product of a few pixels has no inside
    found = core.any(axis=(1, 2))
    product = kernels.medians(rgb, core)
    ff, bb, fb = (product * product).sum(axis=1), (back * back).sum(axis=1), (product * back).sum(axis=1)
    det = ff * bb - fb * fb
    solved = found & (np.minimum(np.abs(det), ff) >= UNSOLVABLE)
    to_product, to_back = np.moveaxis(flat @ np.stack([product, back], axis=2), 2, 0)
    alpha = np.clip((bb[:, None] * to_product - fb[:, None] * to_back) / np.where(solved, det, 1)[:, None], 0, 1).reshape(n, h, w) * each(solved)
    way = product - back
    length = (way * way).sum(axis=1)
    weak = found & ~(alpha > 0.5).any(axis=(1, 2)) & (length >= UNSOLVABLE)
    if weak.any():
        gone = ((flat[weak] - back[weak, None]) @ way[weak, :, None])[..., 0] / length[weak, None]
        alpha[weak] = np.clip(gone, 0, 1).reshape(-1, h, w) * kernels.dilate(core[weak], kernels.ellipse(15))
    covered = alpha > 0.5
    cleaned = opened_up(covered)
    piece = largest_pieces(np.where(each(cleaned.any(axis=(1, 2))), cleaned, covered))
    inside = holes(piece)
    return np.maximum(alpha * kernels.dilate(piece | inside, small), inside) * each(found & piece.any(axis=(1, 2)))


def local_engine(data: bytes, width: int, height: int) -> np.ndarray:
    return key_on_backdrop(rasters.light(rasters.read(data))[0])


local_engine.together = lambda shown: keyed(rasters.light_of(shown))


def measures(mask: np.ndarray) -> dict[str, Any]:
    """`measured` for one mask."""
    return measured(mask[None])[0]


def measured(fields: np.ndarray) -> list[dict[str, Any]]:
    """Of each mask (n, h, w) its measures, its first reason for refusal or its score."""
    n, h, w = fields.shape
    core = fields > masks.CORE
    coverages, softs = core.mean(axis=(1, 2)).tolist(), ((fields > masks.SOFT_LOW) & (fields < masks.SOFT_HIGH)).sum(axis=(1, 2)).tolist()
    edges = (core[:, 0].any(axis=1) & core[:, -1].any(axis=1) & core[:, :, 0].any(axis=1) & core[:, :, -1].any(axis=1)).tolist()
    runs, own, at = kernels.pieces(core)
    sizes, starts = [[] for _ in range(n)], [[] for _ in range(n)]
    for k, start, size in zip(own.tolist(), at.tolist(), runs.sizes().tolist(), strict=True):
        sizes[k].append(size)
        starts[k].append(start)
    out = []
    for coverage, soft, edge, mine in zip(coverages, softs, edges, sizes, strict=True):
        solidity = max(mine) / sum(mine) if mine else 0.0
        reason = "empty" if coverage < masks.MIN_COVERAGE else "full_frame" if coverage > masks.MAX_COVERAGE else "inverted" if edge else "fragmented" if solidity < masks.MIN_SOLIDITY else None
        out.append({"coverage": coverage, "soft": soft / (h * w), "solidity": solidity, "score": None, "reason": reason})
    scored = [k for k, m in enumerate(out) if m["reason"] is None]
    scale = max(1.0, max(h, w) / masks.REFERENCE_EDGE)
    for k, length in zip(scored, kernels.outlines(core[scored], [starts[k] for k in scored]), strict=True):
        coverage, solidity = out[k]["coverage"], out[k]["solidity"]
        off = (softs[k] / max(length, 1) - masks.EDGE_WIDTH * scale) / (masks.EDGE_TOLERANCE * scale)
        edge = 0.0 if length < masks.MIN_PERIMETER or softs[k] / (h * w) < masks.BINARY_SHARE else math.exp(-off * off)
        plausible = 1.0 if 0.05 <= coverage <= 0.70 else coverage / 0.05 if coverage < 0.05 else max(0.0, 1 - (coverage - 0.70) / 0.30)
        out[k]["score"] = min(1.0, max(0.0, masks.W_EDGE * edge + masks.W_SOLIDITY * solidity + masks.W_COVERAGE * plausible))
    return out


# -- shading and placing ------------------------------------------------------------------------


def decontaminated(rgb: np.ndarray, alpha: np.ndarray, plate: np.ndarray) -> np.ndarray:
    """Soft edge pixels solved for the product's own colour, easing in with alpha; the band is a dilation, not a join. One picture or many."""
    partial = (alpha > 0.001) & (alpha < 0.999)
    band = kernels.dilate(partial, kernels.ellipse(BAND)) & (alpha > FLOOR)  # up to there nothing is eased in
    a, seen, behind = alpha[band][:, None], rgb[band], plate[band]
    own = np.clip((seen - (1 - a) * behind) / a, 0, 1)
    out = rgb.copy()
    out[band] = seen + (own - seen) * np.minimum((a - FLOOR) / (RAMP_END - FLOOR), 1)
    return out


def shade(rgb: np.ndarray, mask: np.ndarray, preserve_shadow: bool = True, clean_edges: bool = True) -> tuple[np.ndarray, float, np.ndarray | None]:
    """Colours with clean edges, the backdrop's uniformity, and the shadow as a ratio (None: there is none to keep)."""
    plate, uniformity, share = kernels.plate(rgb, mask)
    gate = uniformity >= kernels.GATE and share >= kernels.MIN_GROUND
    ratio = kernels.shadow_ratio(rgb, mask, plate) if preserve_shadow and gate else None
    return decontaminated(rgb, mask, plate) if clean_edges and uniformity >= CLEAN_FROM else rgb, round(uniformity, 4), ratio


def shaded(rgb: np.ndarray, alpha: np.ndarray, preserve_shadow: bool = True, clean_edges: bool = True) -> tuple[np.ndarray, list[float], np.ndarray | None, np.ndarray]:
    """`shade` for pictures (n, h, w, 3): colours, uniformities, shadows (None: nobody has one) and who has one."""
    plate, uniformity, share = kernels.plates(rgb, alpha, preserve_shadow or clean_edges)
    ratio, has = None, (uniformity >= kernels.GATE) & (share >= kernels.MIN_GROUND) & preserve_shadow
    if has.any():
        ratio = np.ones(alpha.shape)
        ratio[has], shadow = kernels.shadow_ratios(rgb[has], alpha[has], plate[has])
        has[has] = shadow
    clean = (uniformity >= CLEAN_FROM) & clean_edges
    if clean.all():
        rgb = decontaminated(rgb, alpha, plate)
    elif clean.any():
        rgb = rgb.copy()
        rgb[clean] = decontaminated(rgb[clean], alpha[clean], plate[clean])
    return rgb, [round(u, 4) for u in uniformity.tolist()], ratio if has.any() else None, has


@dataclass(frozen=True)
class Placed:
    """A product on its canvas: how it got there, and what is left of the centring."""

    rgb: np.ndarray
    alpha: np.ndarray
    ratio: np.ndarray | None
    scale: float
    off_x: float
    off_y: float
    notes: list[str]


def place(rgb: np.ndarray, alpha: np.ndarray, ratio: np.ndarray | None, width: int, height: int, margin_pct: float = 0.0, cover: bool = False, upscale: bool = True, centroid: bool = False) -> Placed:
    """A product on a canvas of exactly this size, centred by its bounds or its centroid."""
    x0, y0, x1, y1 = kernels.box_above(alpha, 0.05)
    if x1 <= x0:
        raise Failed("no_foreground_found", "Nothing is left of the product's mask.")
    notes, inset = [], 1 - 2 * margin_pct / 100
    scale = max(width / (x1 - x0), height / (y1 - y0)) if cover else min(width * inset / (x1 - x0), height * inset / (y1 - y0))
    if scale > 1 and not upscale:
        scale, notes = 1.0, ["upscale_skipped"]
    h, w = max(1, round(alpha.shape[0] * scale)), max(1, round(alpha.shape[1] * scale))
    rgb, alpha, top, left = (rgb, alpha, 0, 0) if (h, w) == alpha.shape else kernels.resampled(rgb, alpha, h, w)
    ratio = ratio if ratio is None or ratio.shape == (h, w) else kernels.resize(ratio, h, w)

    def centre(field: np.ndarray) -> tuple[float, float]:
        if centroid and field.sum() > 0:
            ys, xs = np.mgrid[0 : field.shape[0], 0 : field.shape[1]]
            return float((xs * field).sum() / field.sum()) + 0.5, float((ys * field).sum() / field.sum()) + 0.5
        a, b, c, d = kernels.box_above(field, 0.05)
        return (a + c) / 2, (b + d) / 2

    cx, cy = centre(alpha)
    dx, dy = round(width / 2 - cx - left), round(height / 2 - cy - top)
    canvas_rgb, canvas_alpha, canvas_ratio = np.zeros((height, width, 3)), np.zeros((height, width)), np.ones((height, width))

    def paste(canvas: np.ndarray, field: np.ndarray, y: int, x: int) -> None:
        across, down = slice(max(0, x), min(width, x + field.shape[1])), slice(max(0, y), min(height, y + field.shape[0]))
        if across.start < across.stop and down.start < down.stop:
            canvas[down, across] = field[down.start - y : down.stop - y, across.start - x : across.stop - x]

    paste(canvas_rgb, rgb, top + dy, left + dx)
    paste(canvas_alpha, alpha, top + dy, left + dx)
    if ratio is not None:
        paste(canvas_ratio, ratio, dy, dx)
    if int((canvas_alpha > 0.05).sum()) < int((alpha > 0.05).sum()):
        notes.append("cover_cropped")
    ex, ey = centre(canvas_alpha)
    return Placed(canvas_rgb, canvas_alpha, None if ratio is None else canvas_ratio, float(scale), ex - width / 2, ey - height / 2, notes)


@dataclass(frozen=True)
class Canvases:
    """Products on canvases of one size, colours before rows: `Placed` of many. Where there is no shadow, `ratio` is 1."""

    rgb: np.ndarray
    alpha: np.ndarray
    ratio: np.ndarray | None
    shadow: np.ndarray
    scale: list[float]
    off: list[tuple[float, float]]
    notes: list[list[str]]

    def __getitem__(self, k: int) -> Placed:
        return Placed(np.moveaxis(self.rgb[k], 0, 2), self.alpha[k], self.ratio[k] if self.shadow[k] else None, self.scale[k], *self.off[k], self.notes[k])


def all_placed(rgb: np.ndarray, alpha: np.ndarray, ratio: np.ndarray | None, shadow: np.ndarray, width: int, height: int, margin_pct: float = 0.0, cover: bool = False, upscale: bool = True, centroid: bool = False) -> tuple[Canvases, list[Failed | None]]:
    """`place` for pictures (n, h, w, 3), those with a shadow among them, and who failed. What grows by bounds goes from its frame to the canvas at once, without what neither alpha nor the canvas reaches."""
    n, h, w = alpha.shape
    both, around = np.zeros((n, 4, height, width)), None if ratio is None else np.ones((n, height, width))
    out = Canvases(both[:, :3], both[:, 3], around, shadow, [1.0] * n, [(0.0, 0.0)] * n, [[] for _ in range(n)])
    failed: list[Failed | None] = [None] * n
    over = np.empty((n, 4, h, w))
    np.multiply(np.moveaxis(rgb, 3, 1), alpha[:, None], out=over[:, :3])
    over[:, 3] = alpha
    boxes, reach, inset = kernels.boxes_above(alpha, 0.05), kernels.boxes_above(alpha, 0), 1 - 2 * margin_pct / 100
    grown = []
    for k, ((x0, y0, x1, y1), (left, top, right, bottom)) in enumerate(zip(boxes, reach, strict=True)):
        scale = 0.0
        if x1 > x0:
            scale = max(width / (x1 - x0), height / (y1 - y0)) if cover else min(width * inset / (x1 - x0), height * inset / (y1 - y0))
        tall, wide = max(1, round(h * scale)), max(1, round(w * scale))
        if centroid or wide / w < 0.9 or (tall, wide) == (h, w) or scale > 1 and not upscale:
            try:
                one = place(rgb[k], alpha[k], ratio[k] if shadow[k] else None, width, height, margin_pct, cover, upscale, centroid)
            except Failed as failure:
                failed[k] = failure
                continue
            both[k, :3], both[k, 3] = np.moveaxis(one.rgb, 2, 0), one.alpha
            if shadow[k]:
                around[k] = one.ratio
            out.scale[k], out.off[k] = one.scale, (one.off_x, one.off_y)
            out.notes[k].extend(one.notes)
            continue
        kind = "lanczos" if wide < w else "cubic"
        (top_, rows), (left_, cols) = kernels.reached(h, tall, kind, top, bottom - 1), kernels.reached(w, wide, kind, left, right - 1)
        field = rows @ over[k, :, top:bottom, left:right] @ cols.T
        a, b, c, d = kernels.box_above(field[3], 0.05)
        dx, dy = round(width / 2 - (a + c) / 2 - left_), round(height / 2 - (b + d) / 2 - top_)
        y, x = top_ + dy, left_ + dx
        down, across = slice(max(0, y), min(height, y + field.shape[1])), slice(max(0, x), min(width, x + field.shape[2]))
        if down.start < down.stop and across.start < across.stop:
            both[k, :, down, across] = field[:, down.start - y : down.stop - y, across.start - x : across.stop - x]
        if shadow[k]:
            down, across = slice(max(0, dy), min(height, dy + tall)), slice(max(0, dx), min(width, dx + wide))
            if down.start < down.stop and across.start < across.stop:
                rows, cols = kernels.weights(h, tall, kind)[down.start - dy : down.stop - dy], kernels.weights(w, wide, kind)[across.start - dx : across.stop - dx]
                around[k, down, across] = rows @ ratio[k] @ cols.T
        box = (a + x, b + y, c + x, d + y)
        if c <= a or min(box[:2]) < 0 or box[2] > width or box[3] > height:
            if int((both[k, 3] > 0.05).sum()) < int((field[3] > 0.05).sum()):
                out.notes[k].append("cover_cropped")
            box = kernels.box_above(both[k, 3], 0.05)
        out.scale[k], out.off[k] = float(scale), ((box[0] + box[2]) / 2 - width / 2, (box[1] + box[3]) / 2 - height / 2)
        grown.append(k)
    if grown:
        every = slice(None) if len(grown) == n else grown
        clear = np.clip(both[every, 3], 0, 1)
        some = (clear > 1e-6)[:, None]
        both[every, :3] = np.where(some, np.clip(both[every, :3], 0, None) / np.maximum(clear, 1e-6)[:, None], 0).clip(0, 1)
        both[every, 3] = clear
    return out, failed


def all_flattened(canvases: Canvases, background: tuple[float, float, float] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """`flatten` for many: colours (n, 3, h, w) and alpha."""
    if background is None:
        return canvases.rgb, canvases.alpha
    alpha, fill = canvases.alpha[:, None], np.array(background)[:, None, None]
    behind = fill if canvases.ratio is None else np.clip(fill * canvases.ratio[:, None], 0, 1)
    return canvases.rgb * alpha + behind * (1 - alpha), None


def flatten(canvas: Placed, background: tuple[float, float, float] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """The canvas over a background (linear light) with its shadow; None leaves it transparent and drops the shadow."""
    if background is None:
        return canvas.rgb, canvas.alpha
    alpha = canvas.alpha[..., None]
    ratio = 1.0 if canvas.ratio is None else canvas.ratio[..., None]
    return canvas.rgb * alpha + np.clip(np.array(background) * ratio, 0, 1) * (1 - alpha), None


# -- writing ------------------------------------------------------------------------------------

WRITABLE = ("png", "jpeg", "webp", "bmp", "tiff", "eps")
QUALITY = 92
#: Profiles by name: what stands in the file's description, red, green and blue adapted to the file's white, and gamma (None: sRGB's own curve).
PROFILES = {
    "srgb": ("sRGB", ((0.43607, 0.22249, 0.01392), (0.38515, 0.71687, 0.09708), (0.14307, 0.06061, 0.71410)), None),
    "adobe": ("Adobe RGB (1998)", ((0.60974, 0.31111, 0.01947), (0.20528, 0.62567, 0.06087), (0.14919, 0.06322, 0.74457)), color.ADOBE_GAMMA),
}


def profiled(rgb: np.ndarray, profile: str | None) -> np.ndarray:
    """Linear sRGB to the profile's encoded values, 0 to 1."""
    if profile != "adobe":
        return encoded(rgb)
    return np.clip(rgb @ np.array(color.SRGB_TO_ADOBE).T, 0, 1) ** (1 / color.ADOBE_GAMMA)


@lru_cache
def profile_of(name: str) -> bytes:
    description, primaries, gamma = PROFILES[name]
    return rasters.icc_profile(description, primaries, linear(np.linspace(0, 1, 1024)) if gamma is None else gamma)


def encode(rgb: np.ndarray, alpha: np.ndarray | None, fmt: str, profile: str | None = None, quality: int = QUALITY) -> bytes:
    """Linear pixels to a file: PNG, lossless WebP and 16-bit TIFF with or without alpha, JPEG, BMP, EPS.

    Formats without alpha refuse a clear picture. A profile's values are converted to it and it is embedded, where the format holds one.
    """
    made = all_encoded(np.moveaxis(rgb, 2, 0)[None], None if alpha is None else alpha[None], [(fmt,)], profile, quality)[0]
    if isinstance(made, Failed):
        raise made
    return made[0]


def all_encoded(rgb: np.ndarray, alpha: np.ndarray | None, wanted: list[Sequence[str]], profile: str | None = None, quality: int = QUALITY, fill: tuple[float, float, float] | None = None) -> list[list[bytes] | Failed]:
    """`encode` for pictures (n, 3, h, w): each one's files in the formats wanted of it, or its failure. Values that are the fill's are converted once."""
    n, held = len(rgb), profile_of(profile) if profile else None
    own = _primaries(rgb, profile)
    solid = np.moveaxis(light_levels(own, profile), 1, 3)
    with_alpha = solid if alpha is None else np.concatenate([solid, levels(alpha)[..., None]], axis=3)
    clear = [False] * n if alpha is None else (alpha.min(axis=(1, 2), initial=1) < 0.999).tolist()
    at_once: dict[tuple[str, int], bytes] = {}
    for fmt, write in (("webp", lambda some: webp.all_encoded(with_alpha[some], held)), ("jpeg", lambda some: jpeg.all_encoded(solid[some], quality, held))):
        some = [k for k, asked_for in enumerate(wanted) if fmt in asked_for and not (clear[k] and fmt in formats.NO_ALPHA)]
        if some:
            at_once |= dict(zip([(fmt, k) for k in some], write(some), strict=True))
    out: list[list[bytes] | Failed] = []
    for k, asked_for in enumerate(wanted):
        bodies: list[bytes] = []
        for fmt in asked_for:
            if fmt not in WRITABLE:
                bodies = Failed("unsupported_file", f"Nothing here writes {fmt}.")
                break
            if clear[k] and fmt in formats.NO_ALPHA:
                bodies = Failed("internal_error", f"A clear picture cannot be a {fmt}.")
                break
            if fmt == "png":
                bodies.append(rasters.encode_png(with_alpha[k], held))
            elif fmt in ("webp", "jpeg"):
                bodies.append(at_once[fmt, k])
            elif fmt == "eps":
                bodies.append(eps.encode(solid[k]))
            elif fmt == "bmp":
                bodies.append(rasters.encode_bmp(solid[k]))
            else:
                deep = _deep(own[k], profile, None if fill is None else _primaries(np.array(fill)[None, :, None, None], profile)[0])
                values = deep if alpha is None else np.concatenate([deep, levels(alpha[k], 65535)[None]])
                bodies.append(rasters.encode_tiff16(np.moveaxis(values, 0, 2), held))
        out.append(bodies)
    return out


def _primaries(rgb: np.ndarray, profile: str | None) -> np.ndarray:
    """Linear sRGB (n, 3, h, w) as light of a profile's primaries, within its bounds."""
    if profile != "adobe":
        return np.clip(rgb, 0, 1)
    n, _, h, w = rgb.shape
    return np.clip((np.array(color.SRGB_TO_ADOBE) @ rgb.reshape(n, 3, -1)).reshape(rgb.shape), 0, 1)


def shown(rgb: np.ndarray, profile: str | None) -> np.ndarray:
    """A profile's levels (n, h, w, 3) of linear pixels (n, 3, h, w)."""
    return np.moveaxis(light_levels(_primaries(rgb, profile), profile), 1, 3)


def _deep(own: np.ndarray, profile: str | None, fill: np.ndarray | None) -> np.ndarray:
    """16-bit levels (3, h, w) of such light; the fill's own value is converted once."""
    if fill is None:
        return levels(_curve(own, profile), 65535)
    other = own != fill
    out = np.array(np.broadcast_to(levels(_curve(fill, profile), 65535), own.shape))
    out[other] = levels(_curve(own[other], profile), 65535)
    return out


def small(rgb: np.ndarray, alpha: np.ndarray | None, long_edge: int = THUMBNAIL) -> tuple[bytes, int, int]:
    """A small PNG of a picture, its alpha on white, with its size; never larger than the picture."""
    flat = rgb if alpha is None else rgb * alpha[..., None] + (1 - alpha[..., None])
    scale = min(1.0, long_edge / max(flat.shape[:2]))
    out = flat if scale == 1 else kernels.fit(flat, max(1, round(flat.shape[0] * scale)), max(1, round(flat.shape[1] * scale)))
    return rasters.encode_png(levels(encoded(out))), out.shape[1], out.shape[0]


def thumbnails(images: DataFrame, long_edge: int = THUMBNAIL) -> DataFrame:
    """Adds a small PNG of each decoded picture, its alpha on white; never larger than the picture."""

    def step(row: dict[str, Any]) -> dict[str, Any]:
        return dict(zip(("thumbnail", "thumbnail_width", "thumbnail_height"), small(*pixels_of(row), long_edge), strict=True))

    return each_image(images, step, "thumbnail binary, thumbnail_width int, thumbnail_height int", ("width", "height", "rgb", "alpha"))
