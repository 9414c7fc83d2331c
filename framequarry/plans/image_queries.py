"""Queries that need whole-image kernels, archives or streams. SQL has no words for most of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import python_ready
from ..operators import images, imaging, layered
from ..sources import rasters
from ..streaming import vendors
from .adapters import JOBS_SQL, PIXELS_SQL, SIDE, entries, job_images, pixels, spread
from .registry import ORACLES, query, table


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(imaging.scenes(table(spark, sf_dir, "part")))


@query()
def plate_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic backdrop fit, its uniformity gate and the darkest shadow of every scene."""
    return imaging.measured(_scenes(spark, sf_dir), imaging.plates_measured, "uniformity double, ground double, gate boolean, darkest double")


@query()
def place_on_canvas_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scene resampled, centred and pasted on an exact canvas."""
    return imaging.measured(_scenes(spark, sf_dir), imaging.one_by_one(imaging.placed), "scale double, coverage double, off_x double, off_y double")


@query()
def clipping_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contour, simplified and wound, as path records."""
    return imaging.measured(_scenes(spark, sf_dir), imaging.clipping_paths, "vertices int, area double, records binary")


@query()
def backdrop_keying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline segmenter against the true alpha."""
    return imaging.measured(_scenes(spark, sf_dir), imaging.all_keyed, "error_mean double, coverage double")


@query()
def traced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced contour lengths, edge widths and solidity."""
    return imaging.measured(_scenes(spark, sf_dir), imaging.traced_edges, "contour int, edge_width double, solidity double")


@query()
def encode_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures through the encoders and back."""
    return imaging.measured(_scenes(spark, sf_dir), imaging.one_by_one(imaging.encoded), "png int, bmp int, tiff int, psd int, layers string, reads_back boolean")


_OBJECTS = {"red": "r > 0.5", "green": "g > 0.5", "top": "y < 3"}
_SCENE = layered.Spec(product="top", profile="srgb", clipping_path=False)


@query(f"""WITH {PIXELS_SQL}, o AS ({' UNION ALL '.join(f"SELECT img, {k} AS k, '{n}' AS name, count(*) FILTER ({t}) AS area FROM px GROUP BY img" for k, (n, t) in enumerate(_OBJECTS.items()))})
SELECT img, CAST(1.0 AS DOUBLE) AS scale, 'BG,' || string_agg(name, ',' ORDER BY area DESC, k) AS layers, '120,' || string_agg(CAST(area AS VARCHAR), ',' ORDER BY area DESC, k) AS areas, 51 AS corner, 0 AS problems FROM o GROUP BY img""")
def scene_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as scenes of three objects on a larger canvas, written as PSD and read back: layers from below with their areas."""
    rows = pixels(spark, sf_dir).select("img", F.struct("i", "r", "g", *(F.expr(t).cast("double").alias(n) for n, t in _OBJECTS.items())).alias("p"))
    pictures = rows.groupBy("img").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a picture has 64 pixels
    flat = pictures.select("img", F.transform("p", lambda p: F.array(p["r"], p["g"], p["g"])).alias("colour"), F.array(*(F.col(f"p.{n}") for n in _OBJECTS)).alias("masks"))

    def packed(row: dict) -> dict:
        objects = [{"name": n, "alpha": images.packed(np.array(a))} for n, a in zip(_OBJECTS, row["masks"], strict=True)]
        return {"width": SIDE, "height": SIDE, "rgb": images.packed(np.array(row["colour"])), "objects": objects}

    scenes = images.each_image(flat, packed, "width int, height int, rgb binary, objects array<struct<name: string, alpha: binary>>").drop("colour", "masks")
    pad = tuple(float(images.linear(np.array(v / 255))) for v in (0x33, 0x66, 0x99))
    files = layered.checked(layered.scene_files(layered.placed_scenes(scenes, 12, 10, 0.0, False, pad), _SCENE), _SCENE, (12, 10))

    def read(row: dict) -> dict:
        parts = rasters.psd_parts(row["psd"])
        areas = [int(a[..., 3].sum() // 255) for _, a in parts["layers"]]
        return {"layers": ",".join(n for n, _ in parts["layers"]), "areas": ",".join(map(str, areas)), "corner": int(parts["merged"][0, 0, 0])}

    return images.each_image(files, read, "layers string, areas string, corner int", ("psd",)).select("img", "scale", "layers", "areas", "corner", F.size("faults").alias("problems"))


@query(f"""WITH {PIXELS_SQL} SELECT img, 'BG,SHADOW,PROD' AS layers, CAST(sum(floor(a * 255 + 0.5)) AS BIGINT) AS cover, CAST(sum(floor((1 - (8 + i % 8) / 16.0) * 255 + 0.5)) AS BIGINT) AS shade, true AS clipped, 0 AS problems FROM px GROUP BY img""")
def product_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with a shadow as PSD files with a clipping path, read back: opacity of product and shadow, and faults found."""
    rows = pixels(spark, sf_dir).select("img", F.struct("i", "r", "g", "b", "a").alias("p"))
    pictures = rows.groupBy("img").agg(F.array_sort(F.collect_list("p")).alias("p"))
    flat = pictures.select("img", F.transform("p", lambda p: F.array(p["r"], p["g"], p["b"])).alias("colour"), F.col("p.a").alias("mask"))

    def placed(row: dict) -> dict:
        ratio = (SIDE + np.arange(SIDE * SIDE) % SIDE) / 16
        return {"canvas_width": SIDE, "canvas_height": SIDE, "canvas_rgb": images.packed(np.array(row["colour"])), "canvas_alpha": images.packed(np.array(row["mask"])), "canvas_ratio": images.packed(ratio)}

    canvases = images.each_image(flat, placed, "canvas_width int, canvas_height int, canvas_rgb binary, canvas_alpha binary, canvas_ratio binary").drop("colour", "mask")
    files = layered.checked(layered.product_files(canvases), size=(SIDE, SIDE))

    def read(row: dict) -> dict:
        layers = dict(rasters.psd_parts(row["psd"])["layers"])
        return {"layers": ",".join(layers), "cover": int(layers["PROD"][..., 3].sum()), "shade": int(layers["SHADOW"][..., 3].sum())}

    made = images.each_image(files, read, "layers string, cover bigint, shade bigint", ("psd",))
    return made.select("img", "layers", "cover", "shade", (F.col("path_vertices") >= 3).alias("clipped"), F.size("faults").alias("problems"))


@query("SELECT page_id % 7 AS archive_id, count(*) AS entries, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages GROUP BY page_id % 7")
def zip_bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries bundled into stored archives and scanned again: counts and bytes of each archive's files.

    An archive is dealt out in pieces of bounded size, so no task holds more than one piece.
    """
    python_ready(spark)
    pieces = entries(spark, sf_dir).withColumn("piece", F.floor(F.col("page_id") / 700)).select("archive_id", "piece", "page_id", "payload")

    def run(group: pa.Table) -> pa.Table:
        import io

        from ..sources.zipimages import bundle, entries_of

        rows = group.to_pylist()
        body = bundle([(f"{r['page_id']}.html", r["payload"]) for r in rows])
        sizes = [len(e[6]) for e in entries_of("piece", io.BytesIO(body), True) if e[7] is None]
        return pa.table({"archive_id": pa.array([rows[0]["archive_id"]], pa.int64()), "entries": pa.array([len(sizes)], pa.int64()), "bytes": pa.array([sum(sizes)], pa.int64())})

    each = pieces.groupBy("archive_id", "piece").applyInArrow(run, "archive_id long, entries long, bytes long")
    return each.groupBy("archive_id").agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))


@query()
def aimd_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive limit as a stateful stream."""
    calls = vendors.event_stream(spark, sf_dir).select(F.col("user_id").alias("vendor"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("limited"))
    return vendors.drained(vendors.governed(calls), "aimd")


@query("SELECT DISTINCT props AS key FROM events")
def single_flight_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys computed once in a stream; every repeat is dropped."""
    calls = vendors.event_stream(spark, sf_dir).select("ts", F.col("props").alias("key"))
    return vendors.drained(vendors.computed_once(calls), "single-flight").select("key")


def _delay(rows: DataFrame) -> int:
    """How late a row can be in a stream that holds rows from everywhere, in milliseconds: the span of its times (ts), and a minute."""
    span = rows.agg((F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("span")).first()["span"]
    return (span or 0) + 60_000


def _shuffled(rows: DataFrame, name: str, delay: int, files: int = 3) -> DataFrame:
    """Rows (with ts) as a stream of several files, each with rows from everywhere; then one with a row of no key, later by far than the delay twice over, that lets the watermark pass."""
    spark = rows.sparkSession
    folder = vendors.shared_folder(spark, name)
    rows.repartition(files, F.xxhash64("seq")).write.parquet(folder)
    after = rows.agg(F.timestamp_millis(F.unix_millis(F.max("ts")) + 2 * delay + 60 * 86_400_000).alias("ts"))
    after.select(*(F.col("ts") if c == "ts" else F.lit(-1 if c in ("vendor", "job", "seq") else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query()
def governed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The governor with its pauses as a stream whose batches hold calls from everywhere, put in order by event time."""
    calls = job_images(spark, sf_dir).select(F.col("job").alias("vendor"), "seq", F.timestamp_millis((F.col("seq") * 500 + 1_700_000_000_000).cast("long")).alias("ts"), (F.col("seq") * 0.5).cast("double").alias("at"), (F.col("state") == "failed").alias("limited"), F.when(F.col("seq") % 3 > 0, F.col("retry_after")).alias("retry_after"))
    delay = _delay(calls)
    return vendors.drained(vendors.paused(_shuffled(calls, "calls", delay), f"{delay} milliseconds"), "governed")


@query(f"""WITH {JOBS_SQL}, q AS (SELECT job, min(seq) AS requested FROM ji WHERE state = 'failed' AND job % 3 = 0 GROUP BY job),
s AS (SELECT *, round(COALESCE(sum(cost) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) + 0.05 > 2.0 AS over FROM ji)
SELECT s.job, s.seq, CASE WHEN COALESCE(s.seq >= requested, false) OR over THEN 'skip' ELSE 'run' END AS action, CASE WHEN COALESCE(s.seq >= requested, false) THEN 'cancelled' WHEN over THEN 'budget' END AS reason FROM s LEFT JOIN q ON q.job = s.job""")
def stopped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs as a stream of uploads joined by one of requests to stop: which images start, and why others do not."""
    images_of = job_images(spark, sf_dir)
    ts = F.timestamp_seconds(F.col("seq") + 1_700_000_000)
    delay = _delay(images_of.select(ts.alias("ts")))
    uploads = _shuffled(images_of.select("job", "seq", ts.alias("ts"), "cost"), "uploads", delay)
    control = _shuffled(images_of.where("state = 'failed' and job % 3 = 0").groupBy("job").agg(F.min("seq").alias("seq")).select("job", "seq", ts.alias("ts")), "control", delay, 1)
    rows = vendors.drained(vendors.running(uploads, control, 2.0, 0.05, f"{delay} milliseconds"), "running")
    return rows.where("job >= 0")


ORACLES["governed_stream"] = ORACLES["aimd_pause"]
ORACLES["aimd_stream"] = ORACLES.get("aimd_limit", "")
