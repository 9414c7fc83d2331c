"""Closed-form expectations for functions, kernels, archives, codecs and streams."""

from __future__ import annotations

import io
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framequarry.functions import boxes, color, formats, web
from framequarry.operators import autopick, jobs, kernels, masks, paths
from framequarry.sources import rasters, zipimages


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# -- colour -----------------------------------------------------------------------------------


def test_half_white_over_black_encodes_to_188(spark):
    half = color.over(F.lit(1.0), F.lit(0.5), F.lit(0.0))
    row = one(spark, half.alias("linear"), color.to_uint(color.srgb_encode(half)).alias("encoded"))
    assert (row.linear, row.encoded) == (0.5, 188)


def test_every_level_survives_the_round_trip(spark):
    levels = spark.range(256).select("id", color.to_uint(color.srgb_encode(color.srgb_decode(color.from_uint8(F.col("id"))))).alias("back"))
    assert all(r.id == r.back for r in levels.collect())
    assert one(spark, color.srgb_decode(F.lit(0.5)).alias("x")).x == pytest.approx(0.214041, abs=1e-5)


def test_profiles_are_inverse_of_each_other(spark):
    there = color.convert_linear((F.lit(0.2), F.lit(0.5), F.lit(0.7)), "srgb", "adobe")
    row = one(spark, *(c.alias(n) for c, n in zip(color.convert_linear(there, "adobe", "srgb"), "rgb")))
    assert tuple(row) == pytest.approx((0.2, 0.5, 0.7))


@pytest.mark.parametrize(("text", "want"), [("#ABC", "#AABBCC"), ("f5f5f5", "#F5F5F5"), (" #0a0B0c ", "#0A0B0C"), ("#12345", None), ("white", None), ("", None)])
def test_hex(spark, text, want):
    assert one(spark, color.normalise_hex(F.lit(text)).alias("x")).x == want


# -- masks ------------------------------------------------------------------------------------


def square(n: int = 20, a: int = 5, b: int = 15) -> np.ndarray:
    out = np.zeros((n, n))
    out[a:b, a:b] = 1
    return out


def test_bounds_and_centroid(spark):
    df = spark.createDataFrame([(square().ravel().tolist(),), ([0.0] * 400,)], "alpha array<double>")
    full, empty = df.select(masks.bbox(F.col("alpha"), 20).alias("b"), masks.centroid(F.col("alpha"), 20).alias("c")).collect()
    assert tuple(full.b) == (5, 5, 15, 15) and tuple(full.c) == (10.0, 10.0)
    assert tuple(empty.b) == (0, 0, 0, 0) and empty.c is None


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([([0.05, 0.5, 0.95, 0.51],)], "alpha array<double>")
    row = df.select(masks.coverage(F.col("alpha")).alias("c"), masks.soft_count(F.col("alpha")).alias("s")).first()
    assert (row.c, row.s) == (0.5, 2)


def test_choice_recovers_the_largest_object_and_keeps_hopeless_images(spark):
    two = np.zeros((16, 16))
    two[2:8, 2:8] = 1
    two[10:15, 10:15] = 1
    frame = np.zeros((16, 16))
    frame[0] = frame[-1] = frame[:, 0] = frame[:, -1] = 1
    rows = [(1, 0, two.ravel().tolist()), (2, 0, frame.ravel().tolist()), (2, 1, [0.0] * 256), (3, 0, square(16, 4, 12).ravel().tolist()), (3, 1, square(16, 4, 12).ravel().tolist())]
    got = {r.image_id: r for r in autopick.choose(spark.createDataFrame(rows, "image_id long, pool_pos int, alpha array<double>"), 16).collect()}
    assert got[1].winner == 0 and "scene_largest_object" in got[1].notes and "single_engine_only" in got[1].notes
    assert got[2].winner is None and got[2].score is None
    assert got[3].winner == 0 and got[3].gap == 0 and "tiebreak_deterministic" in got[3].notes


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=1, max_size=7))
def test_components_equal_flood_fill(cells):
    mask, seen, want = np.array(cells), {}, 0
    for start in map(tuple, np.argwhere(mask)):
        if start in seen:
            continue
        want += 1
        stack = [start]
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < 7 and mask[y, x] and (y, x) not in seen:
                seen[(y, x)] = want
                stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = kernels.components(mask)
    assert all(got[k] == v for k, v in seen.items()) and (got > 0).sum() == len(seen)


def test_contour_of_a_square_and_a_pixel():
    assert len(kernels.contours(square() > 0)[0]) == 36
    dot = np.zeros((3, 3), bool)
    dot[1, 1] = True
    assert kernels.contours(dot) == [[(1, 1)]]


def test_resampling_keeps_flat_fields_and_exact_sizes():
    flat = np.full((30, 40, 3), 0.4)
    colour, alpha = kernels.resample(flat, np.ones((30, 40)), 11, 13)
    assert colour.shape == (11, 13, 3) and np.allclose(colour, 0.4) and np.allclose(alpha, 1)
    assert np.allclose(kernels.area_halve(np.arange(16.0).reshape(4, 4)), [[2.5, 4.5], [10.5, 12.5]])


def test_shadow_of_a_studio_scene_is_found_and_the_clean_backdrop_is_one():
    n = 96
    yy, xx = np.mgrid[0:n, 0:n]
    ratio = 1 - 0.45 * np.exp(-1.6 * (((xx - n / 2) / (0.23 * n)) ** 2 + ((yy - 0.68 * n) / (0.09 * n)) ** 2))
    alpha = np.clip(0.2 * n - np.hypot(xx - n / 2, yy - 0.47 * n) + 0.5, 0, 1)
    ground = 0.93 - 0.06 * ((xx / n - 0.5) ** 2 + (yy / n - 0.5) ** 2)
    rgb = (np.array([0.57, 0, 0]) * alpha[..., None]) + (ground * ratio)[..., None] * (1 - alpha[..., None])
    whole, uniformity, share = kernels.plate(rgb, alpha)
    got = kernels.shadow_ratio(rgb, alpha, whole)
    assert uniformity > 0.9 and share > 0.5
    shaded = (ratio < 0.95) & (alpha < 0.01)
    assert np.abs(got - ratio)[shaded].mean() < 0.02
    assert (got[(ratio > 0.999) & (alpha < 0.001) & (yy < 0.2 * n)] == 1).all()
    rng = np.random.default_rng(1)
    assert kernels.plate(rng.random((n, n, 3)), alpha)[1] < 0.5


# -- boxes, names, replies --------------------------------------------------------------------


def test_boxes(spark):
    a = boxes.box(*map(F.lit, (0, 0, 4, 4)))
    empty = boxes.box(*map(F.lit, (9, 9, 9, 9)))
    row = one(spark, boxes.union(a, empty).alias("u"), boxes.overlap(*map(F.lit, (4, 4, 4, 4, 5, 0))).alias("o"), boxes.pad_and_clamp(a, F.lit(5), F.lit(9), F.lit(62.5)).alias("p"))
    assert tuple(row.u) == (0, 0, 4, 4) and row.o is None and tuple(row.p) == (0, 0, 5, 6)


@pytest.mark.parametrize("path", ["../x", "/x", "C:\\x", "a/../b", "a\\..\\b", "nul\0.png", ""])
def test_unsafe_paths(spark, path):
    assert zipimages.is_unsafe(path)
    assert spark.createDataFrame([(path,)], "p string").select(formats.is_unsafe_path(F.col("p")).alias("x")).first().x


@pytest.mark.parametrize(("header", "want"), [("30", 30.0), ("-1", 0.0), ("soon", None), (None, None), ("Thu, 01 Jan 1970 00:01:40 GMT", 40.0), ("Thu, 01 Jan 1970 00:00:10 GMT", 0.0)])
def test_retry_after(spark, header, want):
    df = spark.createDataFrame([(header,)], "h string").select(web.retry_after_seconds(F.col("h"), F.lit(60).cast("timestamp")).alias("x"))
    assert df.first().x == want


def test_retry_delay_without_a_wish_doubles(spark):
    row = one(spark, web.retry_delay(F.lit(2), F.lit(None).cast("double")).alias("a"), web.retry_delay(F.lit(2), F.lit(99.0)).alias("b"))
    assert (row.a, row.b) == (2.0, 30.0)


def test_names_get_numbers_before_the_extension(spark):
    df = spark.createDataFrame([(1, "a.png"), (2, "a.png"), (3, "b"), (4, "b"), (5, ".x"), (6, ".x")], "pos int, name string")
    assert [r.unique_name for r in jobs.numbered_names(df, [], "pos", "name").orderBy("pos").collect()] == ["a.png", "a-1.png", "b", "b-1", ".x", ".x-1"]


def test_batches_close_before_they_overflow(spark):
    df = spark.createDataFrame([("o", k, s) for k, s in enumerate((60, 60, 300, 10, 10, 10))], "owner string, pos long, size long")
    assert [r.batch for r in jobs.batches(df, 100, 2).orderBy("pos").collect()] == [0, 1, 2, 3, 3, 4]


# -- archives and files -----------------------------------------------------------------------


def archive(files: dict[str, bytes], method: int = zipfile.ZIP_STORED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as zipped:
        for name, body in files.items():
            zipped.writestr(name, body)
    return out.getvalue()


def scanned(data: bytes, **caps):
    return [(r[1], r[7]) for r in zipimages.entries_of("x", io.BytesIO(data), True, **caps)]


def test_archive_guards():
    assert scanned(b"nonsense") == [(None, "malicious_archive")]
    assert scanned(archive({})) == scanned(archive({"__MACOSX/a": b"", ".DS_Store": b""})) == [(None, "empty_archive")]
    assert scanned(archive({"b.png": b"1", "a.png": b"2", "../c": b"3"})) == [("../c", "malicious_archive"), ("a.png", None), ("b.png", None)]
    assert scanned(archive({"a": b"x", "b": b"y"}), most_entries=1) == [(None, "too_many_images")]
    assert scanned(archive({"a": b"x" * 10}), most_total=5) == [(None, "malicious_archive")]
    assert scanned(archive({"a": b"x" * 10}), most_entry=5) == [("a", "file_too_large")]
    assert scanned(archive({"a": b"\0" * 1_000_000}, zipfile.ZIP_DEFLATED)) == [("a", "malicious_archive")]


def test_a_forged_size_is_found_out():
    data = bytearray(archive({"a.bin": b"x" * 100}))
    at = data.rindex(b"PK\x01\x02")
    data[at + 24 : at + 28] = (50).to_bytes(4, "little")
    assert scanned(bytes(data))[0][1] in ("malicious_archive", "corrupt_image")


def test_the_source_reads_archives_through_spark(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(archive({"a.png": b"\x89PNG\r\n\x1a\nrest", "b.txt": b"hi"}))
    (tmp_path / "two.zip").write_bytes(b"broken")
    spark.dataSource.register(zipimages.ZipImages)
    index = spark.read.format("zipimages").load(f"{tmp_path}/*.zip").orderBy("archive", "path").collect()
    assert [(r.name, r.payload, r.code) for r in index] == [("a.png", None, None), ("b.txt", None, None), (None, None, "malicious_archive")]
    whole = spark.read.format("zipimages").option("payload", "true").load(f"{tmp_path}/one.zip")
    sniffed = whole.orderBy("path").select("payload", formats.sniff(F.col("payload")).alias("mime")).collect()
    assert [r.mime for r in sniffed] == ["image/png", "application/octet-stream"] and bytes(sniffed[1].payload) == b"hi"


def test_bundles_number_repeats():
    with zipfile.ZipFile(io.BytesIO(zipimages.bundle([("a.png", b"1"), ("a.png", b"2"), ("b", b"3"), ("b", b"4")]))) as z:
        assert z.namelist() == ["a.png", "a-1.png", "b", "b-1"]


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_round_trip(channels, kind):
    pixels = np.random.default_rng(1).integers(0, np.iinfo(kind).max, (9, 7, channels)).astype(kind)
    assert (np.round(rasters.decode(rasters.encode_png(pixels)) * np.iinfo(kind).max) == pixels).all()
    assert rasters.dimensions(rasters.encode_png(pixels)) == (7, 9)


def test_png_filters():
    rng, h, w = np.random.default_rng(2), 6, 5
    pixels = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
    flat, raw = pixels.reshape(h, -1).astype(int), b""
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(15, int)
        left, corner = np.concatenate([[0] * 3, flat[y][:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = (np.zeros(15, int), left, up, (left + up) // 2, near)[y % 5]
        raw += bytes([y % 5]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes()
    head = rasters.encode_png(pixels)[:33]
    data = head + rasters._chunk(b"IDAT", zlib.compress(raw)) + rasters._chunk(b"IEND", b"")
    assert (np.round(rasters.decode(data) * 255) == pixels).all()


def test_other_codecs_and_refusals():
    pixels = np.random.default_rng(3).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (np.round(rasters.decode(rasters.encode_bmp(pixels)) * 255) == pixels).all()
    profile = rasters.icc_profile("test", ((0.4361, 0.2225, 0.0139), (0.3851, 0.7169, 0.0971), (0.1431, 0.0606, 0.7141)), 2.2)
    assert len(profile) == int.from_bytes(profile[:4], "big") and profile[36:40] == b"acsp" and profile == rasters.icc_profile("test", ((0.4361, 0.2225, 0.0139), (0.3851, 0.7169, 0.0971), (0.1431, 0.0606, 0.7141)), 2.2)
    deep = pixels.astype(np.uint16) * 257
    assert (np.round(rasters.decode(rasters.encode_tiff16(deep, profile)) * 65535) == deep).all()
    rgba = np.concatenate([pixels, pixels[..., :1]], axis=2)
    assert rasters.psd_layers(rasters.encode_psd([("BG", rgba), ("PROD", rgba)], pixels)) == ((7, 5), ["BG", "PROD"])
    for bad in (b"8BPS", b"GIF89a", b""):
        with pytest.raises(rasters.Unsupported):
            rasters.decode(bad)
    with pytest.raises(rasters.Unsupported):
        rasters.encode_bmp(rgba)


def test_paths_wind_and_read_back():
    points = paths.contour(square())
    assert len(points) == 4 and abs(paths.signed_area(points)) == 81
    left = paths.wound(points, True)
    assert paths.signed_area(left) < 0 < paths.signed_area(paths.wound(points, False))
    assert paths.decoded(paths.records(left, 20, 20)) == [pytest.approx((x / 20, y / 20), abs=1e-6) for x, y in left.tolist()]
    assert paths.contour(np.zeros((5, 5))) is None
    assert paths.polygon_points([1, 2, 3, 4]) == paths.polygon_points([[1, 2], [3, 4]]) == paths.polygon_points([{"y": 1, "x": 2}, {"y": 3, "x": 4}])
    with pytest.raises(ValueError):
        paths.polygon_points("encoded")
    assert kernels.fill_polygon([(2, 2), (2, 7), (7, 7), (7, 2)], 10, 10).sum() == 36
