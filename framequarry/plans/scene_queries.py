"""Queries over scenes of several objects, named subjects, kept masks and judged ties: all through the flow."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cutouts, flow, images, kernels, layered, rules
from ..sources import rasters
from ..sources.zipimages import ZipImages
from ..streaming.vendors import shared_folder
from .adapters import spread
from .registry import query, table

SIDE = 72
#: Objects of a frame: name, centre (y, x), and how its radius follows from the size of a part.
_OBJECTS = (("red", 18, 18, "4 + 3 * (p_size % 3)"), ("green", 18, 54, "5 + 3 * (floor(p_size / 3) % 3)"), ("blue", 54, 36, "6 + 3 * (floor(p_size / 9) % 2)"))
_COLOURS = {"red": (0.5, 0.02, 0.02), "green": (0.02, 0.4, 0.02), "blue": (0.02, 0.02, 0.5)}
_REFUSED = (0.5, 0.45, 0.02)
_GROUND = 0.85


@lru_cache(maxsize=64)
def _far(cy: int, cx: int) -> np.ndarray:
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    return np.hypot(y - cy, x - cx)


def _frame(discs: list[tuple[int, int, int, tuple[float, float, float]]]) -> bytes:
    """A PNG of discs (centre, radius, colour in linear light), drawn as levels."""
    out = np.empty((SIDE, SIDE, 3), np.uint8)
    out[:] = images.light_levels(np.array(_GROUND))
    for cy, cx, r, colour in discs:
        out[_far(cy, cx) <= r] = images.light_levels(np.array(colour))
    return rasters.encode_png(out)


def _thousandths(cy: int, cx: int, r: int) -> list[int]:
    return [int(v * 1000 / SIDE) for v in (cy - r - 3, cx - r - 3, cy + r + 4, cx + r + 4)]


def particular(data: bytes, width: int, height: int) -> np.ndarray:
    """An engine that is at its limit whenever a yellow object is in the middle."""
    answer = _particular(rasters.light(rasters.read(data))[0][None])[0]
    if isinstance(answer, images.Failed):
        raise answer
    return answer


def _particular(rgb: np.ndarray) -> list[np.ndarray | images.Failed]:
    r, g, b = rgb[:, rgb.shape[1] // 2, rgb.shape[2] // 2].T
    refused = (r > 0.3) & (g > 0.3) & (b < 0.2)
    masks = iter(images.keyed(rgb[~refused])) if not refused.all() else iter(())
    return [images.Failed("vendor_rate_limited", "Too many calls.") if no else next(masks) for no in refused.tolist()]


particular.together = lambda shown: _particular(rasters.light_of(shown))


_LAYERED = flow.Config(width=90, height=80, margin_pct=0.0, allow_upscale=False, background="#102030", formats=("psd",), psd=layered.Spec(product="red", profile="srgb", clipping_path=False))
_RADII = " UNION ALL ".join(f"SELECT p_partkey, {k} AS k, '{name}' AS name, CAST({radius} AS BIGINT) AS r FROM part" for k, (name, _, _, radius) in enumerate(_OBJECTS))


@query(f"""WITH o AS ({_RADII}), g AS (SELECT * FROM o WHERE p_partkey % 8 > 0 AND k <> p_partkey % 4)
SELECT p.p_partkey, CASE WHEN count(name) = 0 THEN 'failed' ELSE 'done' END AS state, CASE WHEN count(name) = 0 THEN 'vendor_rate_limited' END AS code, string_agg(name, ',' ORDER BY r DESC) AS layers,
  'BG,' || string_agg(name, ',' ORDER BY r DESC) AS in_file, count(name) * 0.5::DOUBLE AS cost FROM part p LEFT JOIN g USING (p_partkey) GROUP BY p.p_partkey""")
def scene_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of three objects, one of which (or, in every eighth frame, each) no engine cuts out: layers from the largest on, as told and as the file has them, and what they cost."""
    radii = F.array(*(F.expr(f"cast({radius} as int)") for *_, radius in _OBJECTS))
    boxes = "label string, box array<int>"

    def drawn(row: dict) -> dict:
        key, objects, discs = row["p_partkey"], [], []
        for k, ((name, cy, cx, _), r) in enumerate(zip(_OBJECTS, row["radii"], strict=True)):
            discs.append((cy, cx, r, _REFUSED if key % 8 == 0 or k == key % 4 else _COLOURS[name]))
            objects.append({"label": name, "box": _thousandths(cy, cx, r)})
        return {"payload": _frame(discs), "objects": objects}

    parts = spread(table(spark, sf_dir, "part").select("p_partkey", radii.alias("radii")))
    files = images.each_image(parts, drawn, f"payload binary, objects array<struct<{', '.join(f'{n}: {t}' for n, t in (c.split(' ', 1) for c in boxes.split(', ')))}>>")
    files = files.select("p_partkey", F.lit(1).alias("job"), F.concat(F.lit("s"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("source_name"), "payload", "objects")

    def read(done: dict) -> dict:
        body = next((f["body"] for f in done["files"] if f["format"] == "psd"), None)
        return {"in_file": None if body is None else ",".join(rasters.psd_layers(body)[1])}

    done = flow.process_scenes(files, _LAYERED, [("particular", particular, 0.5)], (read, "in_file string"), ("layers", "cost"))
    return done.select("p_partkey", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"), F.col("error.code").alias("code"), F.array_join("layers", ",").alias("layers"), "in_file", "cost")


_CUT = flow.Config(width=60, height=60, background=None, preserve_shadow=False, clean_edges=False)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'blue' ELSE 'red' END AS subject, CASE p_partkey % 4 WHEN 0 THEN 'subject_located' WHEN 1 THEN 'subject_not_found' END AS note FROM part WHERE p_partkey % 4 < 3
UNION ALL SELECT p_partkey, 'blue', 'subject_auto_detected' FROM part WHERE p_partkey % 4 = 3""")
def subject_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large red and a small blue product: cut out is the largest, unless a box tells of the other, by name or found by itself; a box of the whole frame tells nothing."""

    def drawn(row: dict) -> dict:
        small = 7 + row["p_size"] % 3
        kind = row["p_partkey"] % 4
        box = [_thousandths(52, 54, small), None, [0, 0, 1000, 1000], _thousandths(52, 54, small)][kind]
        return {"payload": _frame([(24, 24, 15, _COLOURS["red"]), (52, 54, small, _COLOURS["blue"])]), "subject": {"box": box, "named": kind < 2}}

    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    files = images.each_image(parts, drawn, "payload binary, subject struct<box: array<int>, named: boolean>").select("p_partkey", F.lit(1).alias("job"), F.lit("a.png").alias("source_name"), "payload", "subject")

    def colour(done: dict) -> dict:
        rgb, alpha = images.opened(done["files"][0]["body"])
        r, _, b = rgb[alpha > 0.9].mean(axis=0)
        return {"subject": "red" if r > b else "blue"}

    done = flow.process(files, _CUT, [("local", images.local_engine, 0.0)], use=(colour, "subject string"), passed=("notes",))
    note = F.get(F.filter("notes", lambda n: n.startswith("subject_")), F.lit(0))
    return done.select("p_partkey", "subject", note.alias("note"))


def _never(data: bytes, width: int, height: int) -> np.ndarray:
    raise images.Failed("vendor_error", "No call was due.")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'vendor_error' END AS code, CAST(0.0 AS DOUBLE) AS cost, CASE WHEN p_partkey % 5 > 0 THEN true END AS same FROM part")
def kept_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow's second run over the same files: it calls no engine and delivers the same, but where a kept mask does not hold its digest."""

    def drawn(row: dict) -> dict:
        return {"payload": _frame([(30, 20 + row["p_partkey"] % 30, 6 + row["p_size"] % 9, (0.5, 0.02 + row["p_partkey"] % 97 / 300, 0.02 + row["p_partkey"] % 89 / 300))])}

    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    files = images.each_image(parts, drawn, "payload binary").select("p_partkey", F.lit(1).alias("job"), F.lit("a.png").alias("source_name"), "payload")
    folder = shared_folder(spark, "masks")

    def digest(done: dict) -> dict:
        return {"digest": hashlib.sha256(done["files"][0]["body"]).hexdigest()}

    first = flow.process(spread(cutouts.with_known(files, f"{folder}/sound")), _CUT, [("local", images.local_engine, 0.3)], use=(digest, "digest string"), passed=("fresh",))
    first.select("p_partkey", "key", "fresh", F.col("digest").alias("before")).write.parquet(f"{folder}/first")
    again = spark.read.parquet(f"{folder}/first")
    cutouts.keep(again.withColumn("fresh", F.transform("fresh", lambda f: f.withField("mask", F.when(F.col("p_partkey") % 5 == 0, F.substring(f["mask"], F.lit(1), F.lit(40))).otherwise(f["mask"])))), f"{folder}/kept")
    second = flow.process(spread(cutouts.with_known(files, f"{folder}/kept")), _CUT, [("local", _never, 0.3)], use=(digest, "digest string"), passed=("cost",))
    done = second.select("p_partkey", F.col("error.code").alias("code"), "cost", F.col("digest").alias("after"))
    return done.join(again.select("p_partkey", "before"), "p_partkey").select("p_partkey", "code", "cost", (F.col("after") == F.col("before")).alias("same"))


def _disc(cx: int):
    def engine(data: bytes, width: int, height: int) -> np.ndarray:
        y, x = np.mgrid[0:height, 0:width]
        return np.clip(12.5 - np.hypot(y - 36, x - cx), 0, 1)

    engine.together = lambda shown: np.broadcast_to(engine(b"", shown.shape[2], shown.shape[1]), shown.shape[:3])
    return engine


def judged(first: bytes, second: bytes) -> str:
    """Prefers what lies further right in red pictures, whatever it is shown first in green ones, and fails on others."""
    return _judged(rasters.decode_png(first), rasters.decode_png(second))


def _judged(first: np.ndarray, second: np.ndarray) -> str:
    r, g, b = first[0, 0, :3]
    if b > max(r, g):
        raise RuntimeError("no answer")
    if g > r:
        return "first"
    right = [float(p[..., 3].sum(axis=0, dtype=float) @ np.arange(p.shape[1]) / p[..., 3].sum(dtype=float)) for p in (first, second)]
    return "first" if right[0] > right[1] else "second"


judged.pixels = _judged


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'right' ELSE 'left' END AS engine, CASE WHEN p_partkey % 3 = 0 THEN 'tiebreak_vision' ELSE 'tiebreak_deterministic' END AS note, p_partkey % 3 = 0 AS fallback, CAST(0.85 AS DOUBLE) AS cost FROM part")
def flow_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two masks that tie, and a judge asked twice with sides swapped: it overrules the order only where both answers name the same mask; its failures and prejudices cost their price alone."""

    def drawn(row: dict) -> dict:
        colour = ((0.8, 0.5, 0.5), (0.5, 0.8, 0.5), (0.5, 0.5, 0.8))[row["p_partkey"] % 3]
        return {"payload": rasters.encode_png(np.broadcast_to(images.light_levels(np.array(colour)), (SIDE, SIDE, 3)))}

    parts = spread(table(spark, sf_dir, "part").select("p_partkey"))
    files = images.each_image(parts, drawn, "payload binary").select("p_partkey", F.lit(1).alias("job"), F.lit("a.png").alias("source_name"), "payload")
    done = flow.process(files, _CUT, [("left", _disc(24), 0.5), ("right", _disc(47), 0.25)], (judged, 0.1), passed=("chosen_engine", "notes", "cost"))
    note = F.get(F.filter("notes", lambda n: n.startswith("tiebreak_")), F.lit(0))
    return done.select("p_partkey", F.col("chosen_engine").alias("engine"), note.alias("note"), F.array_contains("notes", "engine_fallback_used").alias("fallback"), F.round("cost", 6).alias("cost"))


# -- polygons and samples -------------------------------------------------------------------------


@query("""WITH g AS (SELECT unnest(range(0, 40)) AS v), q AS (SELECT p_partkey, 5 + p_size % 9 AS r, 3 + p_partkey % 8 AS w FROM part)
SELECT p_partkey, count(*) FILTER (abs(y.v - 15) + abs(x.v - 15) <= r) AS diamond, count(*) FILTER (y.v BETWEEN 20 AND 20 + w AND x.v BETWEEN 18 AND 18 + 2 * w) AS oblong,
  count(*) FILTER (abs(y.v - 15) + abs(x.v - 15) <= r OR (y.v BETWEEN 20 AND 20 + w AND x.v BETWEEN 18 AND 18 + 2 * w)) AS both FROM q, g x, g y GROUP BY p_partkey""")
def polygon_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of a model's answer filled with their borders, and united: cells of each and of both."""

    def filled(row: dict) -> dict:
        r, w = 5 + row["p_size"] % 9, 3 + row["p_partkey"] % 8
        diamond = kernels.fill_polygon([(15 - r, 15), (15, 15 + r), (15 + r, 15), (15, 15 - r)], 40, 40)
        oblong = kernels.fill_polygon([(20, 18), (20, 18 + 2 * w), (20 + w, 18 + 2 * w), (20 + w, 18)], 40, 40)
        return {"diamond": int(diamond.sum()), "oblong": int(oblong.sum()), "both": int((diamond | oblong).sum())}

    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return images.each_image(parts, filled, "diamond bigint, oblong bigint, both bigint").select("p_partkey", "diamond", "oblong", "both")


_SAMPLE = "'s' || doc_id || ['.png', '.txt', '.JPG', '', '.cr2', '.gif'][doc_id % 6 + 1]"


@query(f"""WITH s AS (SELECT {_SAMPLE} AS name, text FROM documents), o AS (SELECT * FROM s WHERE lower(regexp_extract(name, '[^.]*$')) IN ('png', 'jpg', 'cr2') AND contains(name, '.') ORDER BY name LIMIT 8)
SELECT name, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM o WHERE name <= (SELECT name FROM o ORDER BY name LIMIT 1 OFFSET 4)""")
def samples_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of the samples asked for by name: of the eight on offer (the report's own limit) the first five, whatever else is asked for."""
    spark.dataSource.register(ZipImages)
    ends = F.array(*map(F.lit, (".png", ".txt", ".JPG", "", ".cr2", ".gif")))
    name = F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 6).cast("int")))
    files = table(spark, sf_dir, "documents").select(name.alias("name"), F.encode("text", "UTF-8").alias("body"))
    wanted = rules.samples(files.select("name")).orderBy("name").limit(5).unionByName(spark.createDataFrame([("../s0.png",), ("/etc/passwd",), ("s1.txt",)], "name string"))
    folder = shared_folder(spark, "samples")
    flow.write_bundles(rules.samples(files, wanted).select(F.lit("samples").alias("job"), "name", "body"), folder)
    return spark.read.format("zipimages").option("read", "names").load(f"{folder}/*.zip").select(F.col("path").alias("name"), F.col("file_size").alias("bytes"))
