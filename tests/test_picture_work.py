"""The work that a picture takes in the flow and in queries over pictures, and that quick ways find what plain ones find."""

from __future__ import annotations

import base64
import sys

import numpy as np
import pytest

from framequarry.operators import images, imaging, kernels
from framequarry.plans import catalogue
from framequarry.sources import eps, jpeg, webp


def _calls(step) -> int:
    """Calls that a step makes, once what it keeps is there."""
    step()
    count = 0

    def seen(frame, event, arg):
        nonlocal count
        count += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        step()
    finally:
        sys.setprofile(None)
    return count


def _product(h: int = 36, w: int = 40) -> np.ndarray:
    """A shaded disc with a soft edge on a fill, as the flow delivers it."""
    y, x = np.mgrid[0:h, 0:w]
    cover = np.clip(12.5 - np.hypot(y - h / 2, x - w / 2), 0, 1)[..., None]
    return np.rint(cover * np.stack([180 + 0.8 * y, 60 + x, 60 + 0.4 * (x + y)], axis=2) + (1 - cover) * 232).astype(np.uint8)


def test_reading_what_the_flow_delivers_takes_few_calls():
    pixels = _product()
    files = webp.encode(pixels), eps.encode(pixels), jpeg.encode(pixels)
    assert _calls(lambda: webp.decode(files[0])) < 8_000
    assert _calls(lambda: eps.decode(files[1])) < 300
    assert np.array_equal(np.rint(webp.decode(files[0])[0] * 255), pixels) and np.array_equal(np.rint(eps.decode(files[1]) * 255), pixels)


@pytest.mark.parametrize("mode", range(16))
def test_predictions_point_by_point_are_those_of_whole_slants(monkeypatch, mode):
    rng = np.random.default_rng(mode)
    modes = np.zeros((5, 4, 4), np.int64)
    for levels, kinds in ((256, mode), (2, mode), (256, rng.integers(0, 16, (5, 4)))):
        rest = rng.integers(0, levels, (19, 14, 4)) * (255 // (levels - 1))
        modes[..., 1] = kinds
        monkeypatch.setattr(webp, "FEW_POINTS", 0)
        wanted = webp._unpredicted(rest, modes, 2)
        monkeypatch.setattr(webp, "FEW_POINTS", 1 << 30)
        assert np.array_equal(webp._unpredicted(rest, modes, 2), wanted)


def test_characters_of_an_eps_are_those_of_the_standard_library():
    rng = np.random.default_rng(5)
    for size in range(24):
        raw = (rng.integers(0, 256, size) * rng.integers(0, 2, size // 4 + 1).repeat(4)[:size]).astype(np.uint8).tobytes()
        assert eps.to_ascii85(raw) == base64.a85encode(raw) and eps.from_ascii85(base64.a85encode(raw, wrapcol=7)) == raw
    for bad in (b"!!z!!", b"v!!!!", b"uuuuu"):
        with pytest.raises(ValueError):
            eps.from_ascii85(bad)


def _backdrops(n: int) -> np.ndarray:
    """Discs and noise in front of even backdrops; some with nothing at all."""
    rng = np.random.default_rng(n)
    y, x = np.mgrid[0:24, 0:30]
    out = 0.8 + 0.002 * rng.standard_normal((n, 24, 30, 3))
    for k in range(n):
        cover = np.clip(rng.integers(-2, 9) - np.hypot(y - rng.integers(4, 20), x - rng.integers(4, 26)) + 0.5, 0, 1) * (rng.random((24, 30)) > 0.1 * (k % 3))
        out[k] += cover[..., None] * (rng.random(3) * rng.integers(0, 2) - 0.75)
    return np.clip(out, 0, 1)


def test_pictures_keyed_together_are_keyed_as_each_by_itself():
    rgb = _backdrops(60)
    assert np.array_equal(images.keyed(rgb), np.array([images.key_on_backdrop(p) for p in rgb]))


def test_many_pictures_keyed_take_few_calls():
    rgb = _backdrops(64)
    assert _calls(lambda: images.keyed(rgb)) < 64 * 60


def test_a_fault_in_a_stack_is_that_row_s(spark):
    def step(rows: list[dict]) -> list[dict]:
        if any(r["id"] == 5 for r in rows):
            raise images.Failed("no_foreground_found", "five")
        return [{"made": r["id"], "together": len(rows)} for r in rows]

    rows = spark.range(0, 40, 1, 1).selectExpr("id", f"if(id = 7, named_struct('code', 'c', 'message', 'before', 'retryable', false), cast(null as {images.ERROR})) as error")
    got = images.each_stack(rows, step, "made bigint, together int", ("id",)).selectExpr("id", "made", "together", "error.message as told").collect()
    assert [(r["id"], r["made"], r["told"]) for r in got] == [(k, None if k in (5, 7) else k, {5: "five", 7: "before"}.get(k)) for k in range(40)]
    assert {r["together"] for r in images.each_stack(rows.where("id > 7"), step, "made bigint, together int", ("id",), size=lambda row: images.MADE // 8).collect()} == {8}


def _scenes() -> tuple[np.ndarray, np.ndarray]:
    return imaging.renders([{"size": size, "shift": k % 5 - 2, "soft": k % 2 == 0, "second": k % 3 == 0} for size in range(1, 51, 7) for k in range(8)])


@pytest.mark.parametrize("together, single, most", [(imaging.plates_measured, imaging.plate_measures, 20), (imaging.clipping_paths, imaging.clipping_path, 900), (imaging.all_keyed, imaging.keyed, 30), (imaging.traced_edges, imaging.traced_edge, 200)])
def test_scenes_measured_together_are_measured_as_each_by_itself(together, single, most):
    rgb, alpha = _scenes()
    assert together(rgb, alpha) == [single(*picture) for picture in zip(rgb, alpha, strict=True)]
    assert _calls(lambda: together(rgb, alpha)) < most * len(rgb)


def test_what_alpha_does_not_reach_is_not_resampled():
    for rgb, alpha in zip(*_scenes(), strict=True):
        whole, wanted = np.zeros((200, 200, 3)), np.zeros((200, 200))
        colour, a, top, left = kernels.resampled(rgb, alpha, 200, 200)
        whole[top : top + a.shape[0], left : left + a.shape[1]], wanted[top : top + a.shape[0], left : left + a.shape[1]] = colour, a
        for got, full in zip((whole, wanted), kernels.resample(rgb, alpha, 200, 200), strict=True):
            assert np.allclose(got, full, rtol=0, atol=1e-9)
        ys, xs = np.nonzero(alpha)
        for first, many, at in ((top, a.shape[0], ys), (left, a.shape[1], xs)):
            assert first >= (at.min() - 3) * 200 / 32 and first + many <= (at.max() + 4) * 200 / 32


def test_scenes_are_measured_where_they_are_made(spark, small):
    df = catalogue.QUERIES["traced_edges"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and df.count() == spark.read.parquet(f"{small}/part.parquet").count()


def test_new_words_of_op9_take_few_calls():
    bitplanes = pytest.importorskip("framequarry.llm.bitplanes")
    encoder = bitplanes.word_encoder(bitplanes.default_tokenizer())
    words = [f"w{k}x{k * 7}" for k in range(3000)]

    def learnt() -> list[bytes]:
        encoder.known.clear()
        encoder.pieces.clear()
        return encoder.encode_all([" ".join(words), None, "y" * 300 + " " + words[0]])

    ids = learnt()
    assert ids[1] == b"" and ids[0].startswith(encoder.encode_all([words[0]])[0]) and encoder.encode_all(["y" * 300])[0] not in encoder.known.values()
    assert ids == encoder._ids([" ".join(words), "", "y" * 300 + " " + words[0]])
    count = _calls(learnt)
    assert count < 3000 * 18
