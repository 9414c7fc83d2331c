"""Queries over files of every format: profiles, lossy and lossless codecs, and what the flow delivers in them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import flow, images, rules
from ..sources import eps, jpeg, profiles, rasters, webp
from .adapters import PIXELS_SQL, SIDE, picture, spread
from .flow_queries import scene_files
from .registry import query, table


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(picture(spark, sf_dir)).select("img", *(F.col(f"rgb.{c}").alias(c) for c in "rgb"))


def _levels(row: dict) -> np.ndarray:
    """A picture's channels taken as encoded values, in 8 bits."""
    return images.levels(np.stack([np.array(row[c]) for c in "rgb"], axis=1).reshape(SIDE, SIDE, 3))


def _pinned(name: str) -> np.ndarray:
    """A profile's primaries as a file holds them, together with the way to linear sRGB."""
    return profiles.XYZ_TO_SRGB @ np.rint(np.array(images.PROFILES[name][1]).T * 65536) / 65536


#: A profile of a gamma near 1.8, as files hold it, over sRGB's primaries.
_POWER = 461 / 256
_GAMMA = rasters.icc_profile("gamma", images.PROFILES["srgb"][1], _POWER)
_D = "(floor({c} * 255 + 0.5) / 255)"


def _converted(name: str, gamma: float) -> list[str]:
    """SQL of each linear channel behind a profile."""
    light = [f"pow({_D.format(c=c)}, {gamma!r})" for c in "rgb"]
    return [f"least(1.0, greatest(0.0, {' + '.join(f'{float(v)!r} * {x}' for v, x in zip(row, light, strict=True))}))" for row in _pinned(name)]


_SRGB = ["(CASE WHEN {e} <= 0.04045 THEN {e} / 12.92 ELSE pow(({e} + 0.055) / 1.055, 2.4) END)".format(e=_D.format(c=c)) for c in "rgb"]
_CASES = [f"CASE img % 3 WHEN 0 THEN {a} WHEN 1 THEN {g} ELSE {s} END" for a, g, s in zip(_converted("adobe", color.ADOBE_GAMMA), _converted("srgb", _POWER), _SRGB, strict=True)]


@query(f"WITH {PIXELS_SQL} SELECT img, {', '.join(f'round(avg({case}), 3) AS {c}' for c, case in zip('rgb', _CASES, strict=True))} FROM px GROUP BY img")
def profiled_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with an Adobe RGB profile (PNG), a gamma-1.8 profile (TIFF) and a broken one (JPEG's place is taken by PNG), in linear sRGB."""

    def step(row: dict) -> dict:
        pixels = _levels(row)
        made = (lambda: rasters.encode_png(pixels, images.profile_of("adobe")), lambda: rasters.encode_tiff16(pixels.astype(np.uint16) * 257, _GAMMA), lambda: rasters.encode_png(pixels, b"no profile"))
        rgb, _ = images.opened(made[row["img"] % 3]())
        return dict(zip("rgb", (round(float(v), 3) for v in rgb.mean(axis=(0, 1))), strict=True))

    made = images.each_image(_pictures(spark, sf_dir).select("img", F.struct(*"rgb").alias("p")), lambda row: step(row["p"] | {"img": row["img"]}), "r double, g double, b double")
    return made.select("img", "r", "g", "b")


#: JPEG in SQL: the steps of quality 95 for luminance and colours, and the ways to them and back.
_STEPS = [[min(255, max(1, (int(t) * 10 + 50) // 100)) for t in steps.ravel()] for steps in (jpeg.LUMINANCE, jpeg.COLOUR)]
_YCC = [" + ".join(f"{float(v)!r} * {c}" for v, c in zip(row, "rgb", strict=True)) for row in jpeg.TO_YCC]
_BACK = [" + ".join(f"{float(v)!r} * {c}" for v, c in zip(row, ("y[k]", "u[k]", "v[k]"), strict=True)) for row in np.linalg.inv(jpeg.TO_YCC)]
_COS = "sqrt((CASE WHEN {u} = 0 THEN 1 ELSE 2 END) / 8.0) * cos((2 * ({x}) + 1) * ({u}) * pi() / 16)"
_TURN = f"{_COS.format(u='f // 8', x='i // 8')} * {_COS.format(u='f % 8', x='i % 8')}"
_KEPT = {name: f"list_transform(list_zip(list_transform(forth, lambda w: list_inner_product(w, {name})), {_STEPS[table]}), lambda z: round_even(z[1] / z[2], 0) * z[2])" for name, table in (("y", 0), ("u", 1), ("v", 1))}


@query(f"""WITH {PIXELS_SQL}, w AS (SELECT f, i, {_TURN} AS w FROM (SELECT unnest(range(0, 64)) AS f), (SELECT unnest(range(0, 64)) AS i)),
t AS (SELECT (SELECT list(l ORDER BY f) FROM (SELECT f, list(w ORDER BY i) AS l FROM w GROUP BY f)) AS forth, (SELECT list(l ORDER BY i) FROM (SELECT i, list(w ORDER BY f) AS l FROM w GROUP BY i)) AS back),
p AS (SELECT img, i, {', '.join(f'floor({c} * 255 + 0.5) AS {c}' for c in 'rgb')} FROM px),
b AS (SELECT img, {', '.join(f'list({c} ORDER BY i) AS {c}' for c in 'rgb')}, list({_YCC[0]} - 128 ORDER BY i) AS y, list({_YCC[1]} ORDER BY i) AS u, list({_YCC[2]} ORDER BY i) AS v FROM p GROUP BY img),
c AS (SELECT img, r, g, b, back, {', '.join(f'{kept} AS {name}' for name, kept in _KEPT.items())} FROM b, t),
d AS (SELECT img, r, g, b, list_transform(back, lambda w: list_inner_product(w, y) + 128) AS y, list_transform(back, lambda w: list_inner_product(w, u)) AS u, list_transform(back, lambda w: list_inner_product(w, v)) AS v FROM c),
o AS (SELECT img, r, g, b, {', '.join(f'list_transform(range(1, 65), lambda k: floor(least(255.0, greatest(0.0, {back})) + 0.5) - {c}[k]) AS off_{c}' for c, back in zip('rgb', _BACK, strict=True))} FROM d)
SELECT img, {', '.join(f'CAST(list_sum({c}) AS BIGINT) AS {c}' for c in 'rgb')}, {' AND '.join(f'abs(list_sum(off_{c}) / 64) <= 1 AND greatest(list_max(off_{c}), -list_min(off_{c})) <= 24' for c in 'rgb')} AS near FROM o""")
def jpeg_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of noise as JPEG and back: sums of the levels, and whether no channel's mean is off by more than a level and no pixel by more than 24."""

    def step(row: dict) -> dict:
        pixels = _levels(row["p"]).astype(int)
        back = np.rint(jpeg.decode(jpeg.encode(pixels.astype(np.uint8), 95))[0] * 255)
        off = back - pixels
        return dict(zip("rgb", (int(v) for v in pixels.sum(axis=(0, 1))), strict=True)) | {"near": bool((np.abs(off.mean(axis=(0, 1))) <= 1).all() and np.abs(off).max() <= 24)}

    made = images.each_image(_pictures(spark, sf_dir).select("img", F.struct(*"rgb").alias("p")), step, "r bigint, g bigint, b bigint, near boolean")
    return made.select("img", "r", "g", "b", "near")


_KINDS = ("png", "webp", "tiff", "eps", "bmp")


@query(f"""WITH {PIXELS_SQL}, k AS (SELECT unnest({list(_KINDS)}) AS format), s AS (SELECT img, {', '.join(f'CAST(sum((i + 1) * floor({c} * 255 + 0.5)) AS BIGINT) AS {c}' for c in 'rgb')}, CAST(sum((i + 1) * (i % 8) * 36) AS BIGINT) AS a FROM px GROUP BY img)
SELECT img, format, r, g, b, CASE WHEN format IN ('png', 'webp', 'tiff') THEN a END AS a FROM s, k""")
def lossless_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures through every lossless format, and back: sums of the levels by place, and of alpha in formats that carry it."""

    def step(row: dict) -> dict:
        pixels, fmt = _levels(row["p"]), row["format"]
        clear = (np.arange(SIDE * SIDE) % SIDE * 36).astype(np.uint8).reshape(SIDE, SIDE, 1)
        rgba = np.concatenate([pixels, clear], axis=2)
        body = {"png": rasters.encode_png, "webp": webp.encode, "tiff": lambda p: rasters.encode_tiff16(p.astype(np.uint16) * 257)}[fmt](rgba) if fmt in ("png", "webp", "tiff") else eps.encode(pixels) if fmt == "eps" else rasters.encode_bmp(pixels)
        back = np.rint((eps.decode(body) if fmt == "eps" else rasters.decode(body)) * 255).astype(int).reshape(SIDE * SIDE, -1)
        sums = [int(v) for v in (back * np.arange(1, SIDE * SIDE + 1)[:, None]).sum(axis=0)]
        return dict(zip("rgba", [*sums, None][:4], strict=True))

    rows = _pictures(spark, sf_dir).select("img", F.struct(*"rgb").alias("p"), F.explode(F.array(*map(F.lit, _KINDS))).alias("format"))
    return images.each_image(rows, step, "r bigint, g bigint, b bigint, a bigint").select("img", "format", "r", "g", "b", "a")


_ASKED = ("jpeg", "psd", "webp", "eps")
_ALL_FORMATS = flow.Config(width=40, height=36, formats=_ASKED, match_source=True, background="#E8E8E8", preserve_shadow=False, profile="adobe", thumbnail=16)


@query(f"""WITH k AS (SELECT p_partkey, unnest(list_concat({list(_ASKED)}, CASE p_partkey % 4 WHEN 0 THEN ['png'] WHEN 1 THEN ['bmp'] ELSE ['tiff'] END)) AS format FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 9 > 0)
SELECT 'jobs/' || p_partkey % 5 || '/out/p' || p_partkey || '.' || format AS key, format, 40 AS width, 36 AS height, true AS matches FROM k""")
def flow_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow delivering JPEG, layered PSD, WebP and EPS in Adobe RGB: every file, its size as its own reader tells it, and whether its corner is the fill."""

    def read(file: dict) -> dict:
        if file["format"] == "eps":  # holds no profile: its values are the profile's
            values = eps.decode(file["body"])
            fill = images.profiled(np.array(_ALL_FORMATS.fill), "adobe")
        else:
            values = rasters.light(rasters.read(file["body"]))[0]
            fill = np.array(_ALL_FORMATS.fill)
        h, w = values.shape[:2]
        tolerance = 0.08 if file["format"] in ("bmp", "jpeg") else 0.02  # a BMP's values lose their profile, a JPEG's are near
        return {"format": file["format"], "width": w, "height": h, "matches": bool(np.abs(values[0, 0] - fill).max() < tolerance)}

    made = "array<struct<format: string, width: int, height: int, matches: boolean>>"
    done = flow.process(scene_files(spark, sf_dir), _ALL_FORMATS, [("local", images.local_engine, 0.0)], use=(lambda done: {"read": [read(f) for f in done["files"]]}, f"read {made}"), passed=())
    rows = done.select("job", "source_name", F.explode("read").alias("file"))
    return rows.select(rules.output_key(F.col("job").cast("string"), F.col("source_name"), F.col("file.format")).alias("key"), "file.format", "file.width", "file.height", "file.matches")


# -- cutting out ---------------------------------------------------------------------------------

_EDGE = 40
_RADIUS = "(9 + p_size % 7)"
#: Product and backdrop of each kind, as linear light: black on light, light on dark, red with a hole, and nothing at all.
_KEYED = (((0.0, 0.0, 0.0), 0.9), ((0.6, 0.6, 0.6), 0.05), ((0.6, 0.05, 0.05), 0.8), ((0.8, 0.8, 0.8), 0.8))


@query(f"""WITH c AS (SELECT unnest(range(0, {_EDGE})) AS v), d AS (SELECT p_partkey, count(*) FILTER (sqrt((x.v - 20) * (x.v - 20) + (y.v - 20) * (y.v - 20)) <= {_RADIUS}) AS cells FROM part, c x, c y GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE cells END AS cells, true AS near FROM d""")
def backdrop_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discs that are black on light, light on dark, or red with a hole in them, cut out by the backdrop alone: cells found, and whether the mask is within 0.05 of the truth on average."""

    y, x = np.mgrid[0:_EDGE, 0:_EDGE]
    far = np.hypot(x - 20, y - 20)
    products, backs = np.array([p for p, _ in _KEYED]), np.array([b for _, b in _KEYED])

    def step(rows: list[dict]) -> list[dict]:
        kind, size = np.array([r["p_partkey"] % 4 for r in rows]), np.array([r["p_size"] for r in rows])
        inside = far <= (9 + size % 7)[:, None, None]
        shown = inside & ((far > 2) | (kind != 2)[:, None, None])
        rgb = np.where(shown[..., None], products[kind][:, None, None], backs[kind][:, None, None, None])
        masks = images.keyed(rgb)
        off = np.abs(masks - (inside & (kind < 3)[:, None, None])).mean(axis=(1, 2))
        return [{"cells": c, "near": o < 0.05} for c, o in zip((masks > 0.5).sum(axis=(1, 2)).tolist(), off.tolist(), strict=True)]

    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return images.each_stack(parts, step, "cells bigint, near boolean", size=lambda row: _EDGE * _EDGE * 12).select("p_partkey", "cells", "near")
