"""Image operators, the flow and its sinks on closed-form pictures."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest

from framequarry.operators import cutouts, flow, folds, images, jobs, kernels, paths
from framequarry.sources import rasters, sinks, zipimages


def studio(n: int = 120):
    """A product with a cast shadow before a backdrop that falls off; the true alpha and ratio."""
    y, x = np.mgrid[0:n, 0:n].astype(float)
    backdrop = images.linear(0.97 - 0.03 * ((x / n - 0.5) ** 2 + (y / n - 0.5) ** 2))
    d = ((x - n / 2) / (0.23 * n)) ** 2 + ((y - 0.68 * n) / (0.09 * n)) ** 2
    ratio = np.clip(1 - 0.45 * np.exp(-1.6 * d), 0, 1)
    alpha = np.clip(0.2 * n - np.hypot(x - n / 2, y - 0.47 * n) + 0.5, 0, 1)
    product = np.array([float(images.linear(np.array(0.78))), 0.0, 0.0])
    return product * alpha[..., None] + (backdrop * ratio)[..., None] * (1 - alpha[..., None]), alpha, ratio


def test_the_shadow_of_a_studio_scene_is_recovered():
    rgb, alpha, truth = studio()
    plate, uniformity, share = kernels.plate(rgb, alpha)
    ratio = kernels.shadow_ratio(rgb, alpha, plate)
    assert uniformity > 0.5 and share > 0.5 and ratio is not None
    shaded, clean = (truth < 0.95) & (alpha < 0.01), (truth > 0.999) & (alpha < 0.001)
    assert np.abs(ratio - truth)[shaded].mean() < 0.02 and (ratio[clean] == 1).all() and (ratio[alpha > 0.02] == 1).all()


def test_plates_of_little_or_no_backdrop():
    full = np.full((40, 40, 3), 0.3)
    plate, uniformity, share = kernels.plate(full, np.ones((40, 40)))
    assert (plate == 0.5).all() and uniformity == 0 and share == 0
    alpha = np.ones((12, 12))
    alpha[:4] = 0  # fewer than 32 bright cells: all of the backdrop is fitted
    plate, uniformity, share = kernels.plate(np.full((12, 12, 3), 0.4), alpha)
    assert uniformity == pytest.approx(1) and np.allclose(plate[:2], 0.4)
    wide = np.full((200, 200, 3), 0.9)
    wide[20:] *= 0.6
    assert kernels.shadow_ratio(wide, np.zeros((200, 200)), np.full((200, 200, 3), 0.9)) is None


def test_polygons_in_every_shape():
    points = [(1, 2), (3, 4), (5, 6)]
    assert paths.polygon_points([1, 2, 3, 4, 5, 6]) == paths.polygon_points([[1, 2, 3, 4, 5, 6]]) == paths.polygon_points([[1, 2], [3, 4], [5, 6]]) == points
    assert paths.polygon_points([[1, 2], ["a", 2], 7, [3], [3, 4]]) == points[:2] and paths.polygon_points([]) == paths.polygon_points(None) == [] and paths.polygon_points([[1, 2]]) == [(1, 2)]
    with pytest.raises(ValueError):
        paths.polygon_points("rle")
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert paths.signed_area(square) == pytest.approx(16) and np.array_equal(paths.wound(square, True), square[::-1]) and np.array_equal(paths.wound(square, False), square)


def test_fields_are_fitted_by_area_or_between_cells():
    field = np.arange(16, dtype=float).reshape(4, 4)
    assert np.allclose(kernels.fit(field, 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    grown = kernels.fit(field, 8, 8)
    assert grown.shape == (8, 8) and grown.min() == 0 and grown.max() == 15 and np.allclose(grown[0, :4], [0, 0.25, 0.75, 1.25])
    assert kernels.fit(field, 3, 3).mean() == pytest.approx(field.mean())


def test_an_upload_is_shrunk_until_it_fits():
    rng = np.random.default_rng(1)
    noise = rng.random((64, 96, 3))
    whole, small = images.under_budget(noise, 10**6)
    assert not small and rasters.dimensions(whole) == (96, 64)
    data, small = images.under_budget(noise, 6000, 24)
    assert small and max(rasters.dimensions(data)) in (48, 24)
    assert max(rasters.dimensions(images.under_budget(noise, 10, 24)[0])) == 24


def pictures(spark):
    rgb, _, _ = studio(60)
    own = np.zeros((60, 60))
    own[20:40, 25:35] = 1
    rows = [
        (1, "a.png", images.encode(rgb, None, "png")), (1, "a.bmp", images.encode(rgb, None, "bmp")), (1, "cut.png", images.encode(rgb, own, "png")), (2, "raw.nef", images.encode(rgb, None, "tiff")),
        (2, "broken.png", b"\x89PNG\r\n\x1a\n1234"), (2, "none.png", None), (2, "text.txt", b"hello"), (2, "flat.png", images.encode(np.full((60, 60, 3), 0.9), None, "png")),
    ]
    return spark.createDataFrame(rows, "job long, source_name string, payload binary")


def test_one_bad_file_stops_nothing(spark):
    config = flow.Config(width=80, height=50, formats=("png",), match_source=True, most_pixels=10_000)
    done = flow.process(pictures(spark), config, [("local", images.local_engine, 0.02)])
    got = {r.source_name: r for r in flow.results(done).collect()}
    assert {n: r.error and r.error.code for n, r in got.items()} == {
        "a.png": None, "a.bmp": None, "cut.png": None, "raw.nef": None, "broken.png": "image_decode_failed", "none.png": "image_decode_failed", "text.txt": "unsupported_file", "flat.png": "no_foreground_found",
    }
    assert got["a.png"].cost == 0.02 and got["cut.png"].cost == 0.0 and got["cut.png"].chosen_engine is None and got["cut.png"].uniformity is None
    assert "format_substituted" in got["raw.nef"].notes and "single_engine_only" in got["a.png"].notes and abs(got["a.png"].centroid_offset.dx) <= 0.5
    files = {(r.source_name, r.format): r for r in flow.outputs(done).where("body is not null").collect()}
    assert set(files) == {("a.png", "png"), ("a.bmp", "png"), ("a.bmp", "bmp"), ("cut.png", "png"), ("raw.nef", "png"), ("raw.nef", "tiff")}
    for r in files.values():
        assert (r.width, r.height) == (80, 50) == tuple(rasters.dimensions(bytes(r.body))) and r.bytes == len(r.body)
        corner = rasters.decode(bytes(r.body))[0, 0, :3]
        assert np.allclose(corner, 1, atol=0.01)
    large = flow.process(pictures(spark).where("source_name = 'a.png'"), flow.Config(width=800, height=500, most_output_pixels=1000), [("local", images.local_engine, 0.0)])
    assert flow.results(large).first().error.code == "output_too_large"
    empty = flow.process(pictures(spark).limit(0), config, [("local", images.local_engine, 0.0)])
    assert flow.results(empty).collect() == [] and flow.outputs(empty).collect() == []


def test_engines_plug_in_and_fail_as_data(spark):
    _, truth, _ = studio(60)

    def good(data: bytes, w: int, h: int):
        return truth[::2, ::2]  # a vendor that caps its resolution

    def cutout(data: bytes, w: int, h: int):
        return rasters.encode_png(images.levels(np.dstack([np.zeros((60, 60, 3)), truth > 0.5])))

    def limited(data: bytes, w: int, h: int):
        raise images.Failed("vendor_rate_limited", "Later.")

    def broke(data: bytes, w: int, h: int):
        raise images.Failed("vendor_out_of_credits", "Pay.")

    files = pictures(spark).where("source_name = 'a.png'")
    decoded = images.decode(files)
    pool = [("limited", limited, 1.0), ("cutout", cutout, 0.5), ("good", good, 0.25)]
    r = images.chosen(images.candidates_of(decoded, pool)).first()
    assert r.chosen_engine == "good" and r.cost == 0.75 and r.error is None and r.gap > 0.04 and r.cutout_notes == ["engine_fallback_used"]
    r = images.chosen(images.candidates_of(decoded, [("limited", limited, 1.0), ("broke", broke, 1.0)])).first()
    assert r.error.code == "vendor_out_of_credits" and not r.error.retryable and r.cost == 0.0
    two = np.zeros((60, 60))
    two[2:26, 2:26] = two[30:56, 30:56] = 1
    two = kernels.gaussian(two, 1.0)
    r = images.chosen(images.candidates_of(decoded, [("two", lambda d, w, h: two, 1.0)])).first()
    assert "scene_largest_object" in r.cutout_notes and np.frombuffer(r.mask, "<f4").reshape(60, 60)[:20, :20].max() == 0


def test_bundles_stream_into_parts(spark, tmp_path):
    rows = [(1, "a.txt", b"x" * 400), (1, "a.txt", b"y" * 400), (1, "b.txt", b"z" * 400), (2, "c.txt", b"w"), (2, "none", None)]
    folder = f"file://{tmp_path}/out"
    made = {(r.job, r.part): r for r in flow.write_bundles(spark.createDataFrame(rows, "job long, name string, body binary"), folder, most_bytes=900).collect()}
    assert {k: (r.entries, r.bytes) for k, r in made.items()} == {("1", 0): (2, 800), ("1", 1): (1, 400), ("2", 0): (1, 1)}
    with zipfile.ZipFile(made[("1", 0)].path) as z:
        assert sorted(z.namelist()) == ["a-1.txt", "a.txt"] and z.testzip() is None
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1-2.zip", "1.zip", "2.zip"]


def test_archives_are_read_as_deep_as_asked(spark, tmp_path):
    spark.dataSource.register(zipimages.ZipImages)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("x.png", "a/__MACOSX/b.png", "a/._d/f.png", "THUMBS.DB", "b/Thumbs.db", "y.bin"):
            z.writestr(name, b"0123456789")

    def rows(**options):
        reader = spark.read.format("zipimages")
        for k, v in options.items():
            reader = reader.option(k, v)
        return {r.path: r for r in reader.load(f"{tmp_path}/*.zip").collect()}

    names = rows(read="names")
    assert set(names) == {"x.png", "THUMBS.DB", "y.bin"} and names["x.png"].head is None
    assert rows()["x.png"].head == b"0123456789" and rows()["x.png"].payload is None and rows(read="payload")["x.png"].payload == b"0123456789"
    assert rows(mostArchive="10")[None].code == "file_too_large" and rows(mostEntries="2")[None].code == "too_many_images"
    assert [e[7] for e in zipimages.entries_of("a", io.BytesIO((tmp_path / "a.zip").read_bytes()), True, most_total=10**6)] == [None] * 3


def test_folds_walk_keys_of_any_size(spark):
    n = 60_000
    files = spark.range(n).selectExpr("if(id % 3 = 0, 7, id % 5) as owner", "id as pos", "1L as size").repartition(6)
    got = jobs.batches(files, 10**9, 50).where("owner = 7").orderBy("pos").collect()
    assert [r.batch for r in got] == [k // 50 for k in range(len(got))]
    calls = spark.createDataFrame([("v", k, float(k), k in (3, 4), 2.0 if k == 3 else None) for k in range(30)] + [(None, 0, 0.0, True, 500.0)], "vendor string, seq long, at double, limited boolean, retry_after double")
    rows = jobs.governed_calls(calls).orderBy("vendor", "seq").collect()
    assert (rows[0].allowed, rows[0].resume_at) == (4, 120.0)
    mine = rows[1:]
    assert [r.allowed for r in mine[:5]] == [8, 8, 8, 4, 2] and (mine[3].resume_at, mine[4].resume_at, mine[-1].events) == (5.0, 9.0, 2) and mine[16].allowed == 3 and mine[28].allowed == 4
    empty = folds.ordered_fold(calls.limit(0), "vendor", ("seq",), ("at",), 0, lambda s, at: (s, (1,)), "x int")
    assert empty.collect() == [] and empty.columns == ["vendor", "seq", "x"]


def test_a_python_verdict_is_the_sql_one(spark):
    _, truth, _ = studio(60)

    def engine(kind: str):
        def remove(data: bytes, w: int, h: int):
            if kind.startswith("vendor"):
                raise images.Failed(kind, "no")
            two = np.zeros((60, 60))
            two[2:26, 2:26] = two[30:56, 30:56] = 1
            return {"good": truth, "soft": kernels.gaussian(truth, 2.0), "two": kernels.gaussian(two, 1.0), "empty": truth * 0, "full": truth * 0 + 1}[kind]

        return remove

    kinds = ("good", "soft", "two", "empty", "full", "vendor_timeout", "vendor_out_of_credits")
    pools = [("good",), ("two",), ("empty",), ("vendor_timeout",), ("good", "good"), ("soft", "good"), ("vendor_timeout", "good"), ("empty", "two"), ("vendor_timeout", "vendor_out_of_credits"), ("full", "empty"), kinds]
    decoded = images.decode(pictures(spark).where("source_name = 'a.png'"))
    rgb, _ = images.pixels_of(decoded.first().asDict())
    for names in pools:
        pool = [(f"{k}{name}", engine(name), 0.25 * (k + 1)) for k, name in enumerate(names)]
        row = images.chosen(images.candidates_of(decoded, pool)).first()
        try:
            told = images.verdict(images.asked(rgb, pool))
        except images.Failed as failure:
            assert (row.error.code, row.error.message, row.error.retryable) == tuple(failure.info.values()) and row.cost == failure.known["cost"]
            continue
        assert row.error is None and told["mask"].tobytes() and np.allclose(np.frombuffer(row.mask, "<f4").reshape(60, 60), told["mask"], atol=1e-6)
        assert (row.chosen_engine, row.cost, row.cutout_notes) == (told["chosen_engine"], told["cost"], told["cutout_notes"]) and row.score == pytest.approx(told["score"], abs=1e-4) and (row.gap is None) == (told["gap"] is None)


def test_black_light_and_pierced_products_are_cut_out():
    y, x = np.mgrid[0:200, 0:200].astype(float)
    far = np.hypot(x - 100, y - 100)
    soft = np.clip(40 - far + 0.5, 0, 1)
    for product, back in (((0.0, 0.0, 0.0), float(images.linear(np.array(0.97)))), ((0.5, 0.5, 0.5), 0.03), ((0.02, 0.02, 0.02), 0.9), ((0.5, 0.1, 0.1), 0.8)):
        got = images.key_on_backdrop(np.array(product) * soft[..., None] + back * (1 - soft[..., None]))
        assert np.abs(got - soft).mean() < 0.01 and ((got > 0.05) & (got < 0.95)).any()
    label = soft * (far > 8)
    got = images.key_on_backdrop(np.array([0.5, 0.1, 0.1]) * label[..., None] + 0.8 * (1 - label[..., None]))
    assert (got[far < 30] > 0.95).all()
    assert images.key_on_backdrop(np.full((60, 60, 3), 0.8)).max() == 0.0
    rgb, alpha, ratio = studio()
    got = images.key_on_backdrop(rgb)
    assert np.abs(got - alpha)[(alpha > 0.01) | (got > 0.01)].mean() < 0.02 and got[(ratio < 0.9) & (alpha < 0.01)].max() < 0.1
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[3:6, 3:6] = False
    assert images.holes(ring).sum() == 9 and images.holes(np.pad(np.eye(3, dtype=bool), 2)).sum() == 0


def test_boxes_of_subjects():
    assert flow.pixel_box([0, 0, 1000, 500], 200, 100, 0) == (0, 0, 100, 100) and flow.pixel_box([100, 100, 200, 200], 200, 100, 10) == (18, 9, 42, 21) and flow.pixel_box([5, 5, 5, 9], 200, 100, 50) is None
    assert flow.subject_box(None, 10, 10, 0) == (None, []) and flow.subject_box({"box": None, "named": True}, 10, 10, 0) == (None, ["subject_not_found"])
    assert flow.subject_box({"box": [0, 0, 1000, 1000], "named": False}, 100, 100, 0) == (None, []) and flow.subject_box({"box": [0, 0, 30, 30], "named": False}, 100, 100, 0) == (None, [])
    assert flow.subject_box({"box": [200, 200, 800, 800], "named": False}, 100, 100, 0) == ((20, 20, 80, 80), ["subject_auto_detected"])


def test_every_format_and_a_thumbnail_come_out_of_one_map(spark):
    config = flow.Config(width=60, height=50, formats=("psd", "jpeg", "webp", "eps", "tiff", "bmp"), profile="adobe", thumbnail=20, preserve_shadow=False)
    done = flow.process(pictures(spark).where("source_name = 'a.png'"), config, [("local", images.local_engine, 0.0)]).cache()
    files = {r.format: bytes(r.body) for r in flow.outputs(done, "adobe").collect()}
    assert list(files) == ["psd", "jpeg", "webp", "eps", "tiff", "bmp"] and {f: rasters.dimensions(b) for f, b in files.items() if f != "eps"} == dict.fromkeys(("psd", "jpeg", "webp", "tiff", "bmp"), (60, 50))
    row = flow.results(done).first()
    assert max(rasters.dimensions(bytes(row.thumbnail))) == 20 and row.state == "done"
    clear = flow.process(pictures(spark).where("source_name = 'a.png'"), flow.Config(width=60, height=50, formats=("psd",), background=None), [("local", images.local_engine, 0.0)])
    assert [r.format for r in flow.outputs(clear).collect()] == ["psd", "png"]
    refused = flow.process(pictures(spark).where("source_name = 'a.png'"), flow.Config(width=60, height=50, formats=("jpeg",), background=None), [("local", images.local_engine, 0.5)])
    assert flow.results(refused).first().error.code == "internal_error" and flow.results(refused).first().cost == 0.5


def failing_once(folder: str):
    """A map that fails in the first attempt of every task, after some of its rows."""

    def run(batches):
        import pathlib

        from pyspark import TaskContext

        task = TaskContext.get()
        for k, batch in enumerate(batches):
            yield batch
            mark = pathlib.Path(folder, f"tried-{task.partitionId()}")
            if not mark.exists():
                mark.write_text("x")
                raise RuntimeError("lost")

    return run


def test_a_sink_shows_all_of_a_write_or_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.dataSource.register(sinks.FileSink)
    rows = spark.range(0, 30, 1, 3).select(F.concat(F.lit("a/"), (F.col("id") % 4).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("body"))
    target = tmp_path / "objects"
    target.mkdir()
    with pytest.raises(Exception, match="lost"):  # tasks are not tried again here, so the write aborts
        rows.mapInArrow(failing_once(str(tmp_path)), "key string, body binary").write.format("filesink").mode("append").save(f"file://{target}")
    assert list(target.iterdir()) == []
    flow.write_objects(rows, f"file://{target}")
    assert sorted(p.relative_to(target).as_posix() for p in target.rglob("*") if p.is_file()) == sorted(f"a/{k % 4}/{k}" for k in range(30))
    flow.write_objects(rows.where("key = 'a/1/5'").selectExpr("key", "cast('new' as binary) as body"), f"file://{target}")
    keys = spark.createDataFrame([("a/1/5",), ("a/2/6",), ("a/9/9",), ("../x",), (None,)], "key string")
    assert {r.key: r.body and bytes(r.body) for r in flow.read_objects(keys, f"file://{target}").collect()} == {"a/1/5": b"new", "a/2/6": b"6", "a/9/9": None, "../x": None, None: None}
    with pytest.raises(Exception, match="does not leave"):
        flow.write_objects(spark.createDataFrame([("../x", b"1")], "key string, body binary"), f"file://{target}")
    assert not [p for p in tmp_path.rglob("_writing*")]


def test_an_attempt_that_failed_leaves_nothing_in_a_commit(tmp_path):
    """Two attempts of a task wrote; the commit knows of one."""
    import pyarrow as pa

    writer = sinks.Writer({"path": f"file://{tmp_path}/out"})
    fs, base = zipimages.filesystem(f"file://{tmp_path}/out")
    for attempt, body in ((1, b"half"), (2, b"whole")):
        sink = sinks.Objects(fs, f"{base}/{writer.run}/0-{attempt}")
        sink.take(pa.RecordBatch.from_pydict({"key": ["k/one"] + ["k/two"] * (attempt == 1), "body": [body] * (1 + (attempt == 1))}))
    writer.commit([sinks.Attempt(f"{base}/{writer.run}/0-2"), None])
    assert {p.relative_to(tmp_path).as_posix(): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {"out/k/one": b"whole"}


def test_kept_masks_that_do_not_hold_are_misses(spark, tmp_path):
    files = pictures(spark).where("source_name in ('a.png', 'broken.png', 'none.png')")
    folder, config, calls = f"file://{tmp_path}/masks", flow.Config(width=60, height=50), []
    first = flow.process(cutouts.with_known(files, folder), config, [("local", images.local_engine, 0.5)])
    cutouts.keep(first, folder)
    cutouts.keep(first, folder)  # twice the same
    kept = spark.read.parquet(folder)
    assert kept.count() == 2 and kept.select("key").distinct().count() == 1

    def never(data, w, h):
        raise images.Failed("vendor_error", "called")

    def states(where: str) -> dict:
        done = flow.process(cutouts.with_known(files, where), config, [("local", never, 0.5)])
        return {r.source_name: (r.error and r.error.code, r.cost) for r in flow.results(done).collect()}

    assert states(folder) == {"a.png": (None, 0.0), "broken.png": ("image_decode_failed", 0.0), "none.png": ("image_decode_failed", 0.0)}
    bad = f"file://{tmp_path}/bad"
    kept.selectExpr("key", "engine", "box", "mask", "'0' as digest").write.parquet(bad)
    assert states(bad)["a.png"] == ("vendor_error", 0.0) and calls == []


def test_patience_with_engines():
    def flaky(code: str, times: int, wait=None):
        calls = []

        def remove(data, w, h):
            calls.append(1)
            if len(calls) <= times:
                raise images.Failed(code, "no", {} if wait is None else {"retry_after": wait})
            return np.ones((h, w))

        return remove, calls

    for code, times, wait, attempts, waits in (("vendor_timeout", 0, None, 1, []), ("vendor_timeout", 2, None, 3, [0.5, 1.0]), ("vendor_rate_limited", 1, 90.0, 2, [30.0]), ("vendor_timeout", 5, 2.0, 3, [2.0, 2.0]), ("vendor_out_of_credits", 5, None, 1, [])):
        remove, calls = flaky(code, times, wait)
        slept = []
        engine = images.patient(remove, sleep=slept.append)
        if times < 3 and code != "vendor_out_of_credits":
            assert engine(b"", 2, 2).all()
        else:
            with pytest.raises(images.Failed) as failure:
                engine(b"", 2, 2)
            assert failure.value.info["code"] == code
        assert (len(calls), slept) == (attempts, waits)


def test_a_configuration_hashes_alike_in_any_order(spark):
    import hashlib
    import json

    from framequarry.operators import rules

    config = {"b": {"y": None, "x": [1, 2]}, "a": [{"q": "z", "p": 1.5}], "preset_name": "n"}
    want = hashlib.sha256(json.dumps({k: v for k, v in config.items() if k != "preset_name"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    one = spark.createDataFrame([((("n"), (None, [1, 2]), [("z", 1.5)]),)], "config struct<preset_name: string, b: struct<y: string, x: array<int>>, a: array<struct<q: string, p: double>>>")
    two = spark.createDataFrame([(([(1.5, "z")], "other", ([1, 2], None)),)], "config struct<a: array<struct<p: double, q: string>>, preset_name: string, b: struct<x: array<int>, y: string>>")
    assert [rules.with_config_hash(df).first().config_hash for df in (one, two)] == [want, want]
