"""Pictures that go through the flow together: what comes out is what each by itself gives, in less work, and a fault is one picture's."""

from __future__ import annotations

import numpy as np
import pytest

from framequarry.operators import flow, images, imaging
from framequarry.plans import catalogue
from framequarry.sources import jpeg, webp

from .test_picture_work import _calls, _scenes

LOCAL = [("local", images.local_engine, 0.1)]


def _uploads() -> list[tuple]:
    """Pictures of two sizes: with and without an alpha of their own, one of 16 bits, one broken, one bare, and one whose product touches the border."""
    rgb, alpha = _scenes()
    rows = [(k, f"p{k}.png", images.encode(rgb[k], alpha[k] if k % 9 == 4 else None, "tiff" if k % 4 == 1 else "png")) for k in range(30)]
    wide = np.pad(rgb[5], ((4, 4), (10, 10), (0, 0)), mode="edge")
    return [*rows, (30, "wide.png", images.encode(wide, None, "png")), (31, "cut.png", rows[0][2][:50]), (32, "bare.png", images.encode(np.full((32, 32, 3), 0.8), None, "png")), (33, "edge.png", images.encode(np.roll(rgb[8], 9, axis=1), None, "png"))]


@pytest.mark.parametrize("config", [
    flow.Config(48, 40, formats=("png", "tiff"), background="#F0F0F0"),
    flow.Config(40, 36, formats=("jpeg", "psd", "webp", "eps"), profile="adobe", thumbnail=16, preserve_shadow=False),
    flow.Config(30, 60, cover=True, background=None),
    flow.Config(90, 80, allow_upscale=False, clean_edges=False),
    flow.Config(50, 60, centroid=True),
])
def test_pictures_taken_together_come_out_as_each_by_itself(spark, config):
    files = spark.createDataFrame([(1, name, body) for _, name, body in _uploads()], "job int, source_name string, payload binary")
    ways = [flow.process(part, config, LOCAL).orderBy("source_name").collect() for part in (files.coalesce(1), files.repartition(40, "source_name"))]
    assert ways[0] == ways[1] and sum(r["error"] is None for r in ways[0]) >= 28


def test_the_steps_of_a_flow_take_few_calls_a_picture():
    rgb, alpha = _scenes()
    n = len(rgb)

    def work() -> None:
        images.all_asked(rgb, LOCAL, [None] * n, [{}] * n)
        colours, _, ratio, shadow = images.shaded(rgb, alpha)
        canvases, _ = images.all_placed(colours, alpha, ratio, shadow, 48, 40, 10.0)
        images.all_encoded(images.all_flattened(canvases, (0.9, 0.9, 0.9))[0], None, [("png",)] * n)

    assert _calls(work) < 330 * n


def test_an_engine_gets_pictures_together_and_a_fault_asks_none_again(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def each(data: bytes, width: int, height: int) -> np.ndarray:
        with open(seen, "a") as out:
            out.write("one\n")
        if images.rasters.decode_png(data)[0, 0, 2] < 0.5:
            raise RuntimeError("not this one")
        return images.local_engine(data, width, height)

    def both(data: bytes, width: int, height: int) -> np.ndarray:
        raise RuntimeError("never called")

    both.together = lambda shown: [images.Failed("vendor_rate_limited", "later") if k % 2 else mask for k, mask in enumerate(images.local_engine.together(shown))]
    rgb, _ = _scenes()
    odd = rgb[2].copy()
    odd[0, 0, 2] = 0.01
    bodies = [images.encode(p, None, "png") for p in (*rgb[:6], odd)]
    files = spark.createDataFrame([(1, f"{k}.png", body) for k, body in enumerate(bodies)], "job int, source_name string, payload binary").coalesce(1)
    done = flow.process(files, flow.Config(40, 40), [("each", each, 0.5)]).select("source_name", "error.code", "cost").collect()
    assert [(r["code"], r["cost"]) for r in done] == [(None, 0.5)] * 6 + [("internal_error", None)]
    assert open(seen).read().count("one") == 7
    told = flow.process(files, flow.Config(40, 40), [("both", both, 0.5)]).select("error.code").collect()
    assert [r["code"] for r in told] == [None, "vendor_rate_limited"] * 3 + [None]


@pytest.mark.parametrize("profile", [None, "adobe"])
def test_levels_by_where_they_begin_are_those_of_the_curve(profile):
    rng, least = np.random.default_rng(3), images._thresholds(profile)[0][:-1]
    light = np.concatenate([rng.random(20_000), rng.random(20_000) ** 6, least, np.nextafter(least, 0), [0, 1]])
    assert np.array_equal(images.light_levels(light, profile), images.levels(images._curve(light, profile)))


@pytest.mark.parametrize("name, maps", [("image_flow", 2), ("flow_outputs", 2), ("flow_formats", 2), ("scene_layers", 2), ("subject_crops", 2), ("flow_tiebreak", 2)])
def test_files_are_made_used_and_left_in_one_map(spark, small, name, maps):
    plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(made) == maps and "payload" not in made[0].split("[", 1)[1] and "fresh" not in made[0]


def test_scenes_rendered_for_uploads_are_those_of_the_pictures(spark, small):
    from framequarry.plans import flow_queries

    parts = spark.read.parquet(f"{small}/part.parquet")
    wanted = {r["image_id"]: r for r in imaging.rendered(imaging.scenes(parts)).where("image_id % 9 > 0 and image_id % 7 > 0 and image_id % 4 = 2").collect()}
    for r in flow_queries.scene_files(spark, small).where("source_name like '%.tif'").collect():
        key = int(r["source_name"][1:-4])
        if key in wanted:
            assert r["payload"] == images.encode(images.pixels_of(wanted[key].asDict())[0], None, "tiff")


def _pictures(channels: int) -> np.ndarray:
    """An even one, one of noise, one of few colours, and a shaded disc."""
    rng, (y, x) = np.random.default_rng(5), np.mgrid[0:36, 0:40]
    disc = np.where((np.hypot(y - 18, x - 20) < 12)[..., None], np.stack([180 + y, 60 + x, 60 + (x + y) // 2, 255 - y], axis=2), 232)
    return np.stack([np.full((36, 40, 4), 90), rng.integers(0, 256, (36, 40, 4)), rng.integers(0, 3, (36, 40, 4)) * 100, disc])[..., :channels].astype(np.uint8)


@pytest.mark.parametrize("channels", [3, 4])
def test_pictures_written_together_are_files_as_each_by_itself(channels):
    pixels = _pictures(channels)
    files = webp.all_encoded(pixels)
    assert files == [webp.encode(p) for p in pixels]
    assert all(np.array_equal(np.rint(webp.decode(f)[0] * 255), p) for f, p in zip(files, pixels, strict=True))
    if channels == 3:
        assert jpeg.all_encoded(pixels, 90, b"profile") == [jpeg.encode(p, 90, b"profile") for p in pixels]


@pytest.mark.parametrize("channels", [3, 4])
def test_pixels_read_at_once_are_those_read_one_by_one(monkeypatch, channels):
    for pixels in _pictures(channels):
        data = webp.encode(pixels)
        ways = []
        for few in (0, 1 << 30):
            monkeypatch.setattr(webp, "FEW_PIXELS", few)
            ways.append(webp.decode(data)[0])
        assert np.array_equal(*ways)
        monkeypatch.setattr(webp, "FEW_PIXELS", 0)
        monkeypatch.setattr(webp, "STRETCH", 64)
        assert np.array_equal(webp.decode(data)[0], ways[0])
        with pytest.raises(webp.BadWebp):
            webp.decode(data[:12] + data[12:16] + (len(data) - 50).to_bytes(4, "little") + data[20 : len(data) - 30])


def test_writing_many_pictures_takes_few_calls():
    pixels = np.concatenate([_pictures(3)[3:]] * 32)
    assert _calls(lambda: jpeg.all_encoded(pixels)) < 32 * 500
    assert _calls(lambda: webp.all_encoded(pixels)) < 32 * 1_400
