"""Codecs and profiles: against closed forms, the JVM's own reader, and bytes fixed by hand."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pytest

from framequarry.operators import images
from framequarry.sources import eps, jpeg, profiles, rasters, tiff, webp


def smooth(h: int = 61, w: int = 83) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 3 % 256, y * 4 % 256, 128 + 60 * np.sin(x / 9) * np.cos(y / 7)], axis=2).clip(0, 255).astype(np.uint8)


def noise(shape, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, shape).astype(np.uint8)


# -- JPEG --------------------------------------------------------------------------------------


@pytest.mark.parametrize("quality", [30, 92, 100])
def test_jpeg_comes_back_near(quality):
    for pixels in (smooth(), smooth()[..., :1], smooth(8, 8), smooth(1, 1), np.full((17, 9, 3), 77, np.uint8)):
        values, head = jpeg.decode(jpeg.encode(pixels, quality))
        off = np.abs(values * 255 - pixels)
        assert values.shape == pixels.shape and (head.width, head.height) == pixels.shape[1::-1] and off.max() <= {30: 60, 92: 12, 100: 2}[quality]
    assert np.abs(jpeg.decode(jpeg.encode(noise((40, 40, 3)), 100))[0] * 255 - noise((40, 40, 3))).max() <= 3


def test_the_jvm_reads_what_is_written_here_and_the_other_way_round(spark, tmp_path):
    pixels = smooth()
    (tmp_path / "ours.jpg").write_bytes(jpeg.encode(pixels, 92, images.profile_of("srgb")))
    row = spark.read.format("image").load(str(tmp_path / "ours.jpg")).select("image.*").first()
    theirs = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)[..., ::-1]
    ours = jpeg.decode((tmp_path / "ours.jpg").read_bytes())[0] * 255
    assert np.abs(theirs - ours).max() <= 2 and np.abs(theirs.astype(int) - pixels).max() <= 14
    # the JVM's writer thins colours out, two by two
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(83, 61, 1)
    for y in range(61):
        for x in range(83):
            r, g, b = pixels[y, x].tolist()
            picture.setRGB(x, y, (r << 16) | (g << 8) | b)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "theirs.jpg")))
    data = (tmp_path / "theirs.jpg").read_bytes()
    row = spark.read.format("image").load(str(tmp_path / "theirs.jpg")).select("image.*").first()
    theirs = np.frombuffer(row["data"], np.uint8).reshape(61, 83, 3)[..., ::-1]
    values, head = jpeg.decode(data)
    assert [c[1:3] for c in head.components] == [(2, 2), (1, 1), (1, 1)] and np.abs(values * 255 - theirs).mean() < 4


def test_broken_and_other_jpegs():
    data = jpeg.encode(smooth())
    for cut in (3, 30, len(data) // 2, len(data) - 40, len(data) - 2):
        with pytest.raises(jpeg.BadJpeg):
            jpeg.decode(data[:cut])
    at = data.index(b"\xff\xc0")
    with pytest.raises(jpeg.OtherJpeg):
        jpeg.decode(data[: at + 1] + b"\xc2" + data[at + 2 :])
    with pytest.raises(images.Failed, match="progressive"):
        images.opened(data[: at + 1] + b"\xc2" + data[at + 2 :])
    with pytest.raises(images.Failed) as failure:
        images.opened(data[: len(data) // 2])
    assert failure.value.info["code"] == "image_decode_failed"


def test_code_lengths_stay_short_and_fill_the_code():
    steep = np.array([1 << k for k in range(30)])
    lengths = jpeg.code_lengths(steep, 16)
    assert lengths.max() == 16 and (2.0**-lengths).sum() == 1
    assert jpeg.code_lengths(np.array([5, 0, 5, 5, 5]), 16).tolist() == [2, 0, 2, 2, 2]


@pytest.mark.parametrize("turn", range(1, 9))
def test_exif_turns_a_picture(turn):
    pixels = noise((5, 7, 3))
    stored = {1: pixels, 2: pixels[:, ::-1], 3: pixels[::-1, ::-1], 4: pixels[::-1], 5: pixels.swapaxes(0, 1), 6: np.rot90(pixels), 7: pixels[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(pixels, -1)}[turn]
    for mark in "<>":
        exif = {"<": b"II*\0", ">": b"MM\0*"}[mark] + struct.pack(mark + "IHHHIHHI", 8, 1, 274, 3, 1, turn, 0, 0)
        body = b"Exif\0\0" + exif
        data = jpeg.encode(np.ascontiguousarray(stored), 100)
        data = data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:]
        assert np.abs(rasters.read(data).values * 255 - pixels).max() <= 3
        png = rasters.encode_png(np.ascontiguousarray(stored))
        chunk = struct.pack(">I", len(exif)) + b"eXIf" + exif + struct.pack(">I", zlib.crc32(b"eXIf" + exif))
        assert (np.rint(rasters.read(png[:33] + chunk + png[33:]).values * 255) == pixels).all()


# -- lossless formats --------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 4), (1, 9, 3), (9, 1, 4), (20, 33, 4), (70, 50, 3), (40, 40, 4)])
def test_webp_comes_back_exactly(shape):
    for pixels in (noise(shape), np.full(shape, 7, np.uint8), (np.indices(shape).sum(0) * 3 % 256).astype(np.uint8)):
        values, profile, _ = webp.decode(webp.encode(pixels, b"held"))
        assert (np.rint(values * 255) == pixels).all() and profile == b"held" and webp.size(webp.encode(pixels)) == shape[1::-1]


def test_webp_fixed_bytes_and_refusals():
    one = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    values, _, _ = webp.decode(one)
    assert values.shape == (1, 1, 4)
    data = webp.encode(noise((30, 30, 3)))
    for cut in (10, 20, len(data) // 2):
        with pytest.raises(webp.BadWebp):
            webp.decode(data[:cut])
    lossy = b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd"
    with pytest.raises(rasters.Unsupported):
        rasters.read(lossy)


def test_webp_palettes_and_references_of_other_writers():
    """A stream made bit by bit: two colours packed eight to a byte, and a row repeated by reference."""
    bits: list[int] = []

    def put(value: int, size: int) -> None:
        bits.extend(value >> k & 1 for k in range(size))

    put(0x2F, 8), put(7, 14), put(3, 14), put(1, 1), put(0, 3)  # 8 by 4, with alpha
    put(1, 1), put(3, 2), put(1, 8)  # a palette of two
    put(0, 1)
    # colours are differences: red 255 and opaque, then green 255 and red back
    put(1, 1), put(1, 1), put(1, 1), put(0, 8), put(255, 8)  # green: 0 or 255
    put(1, 1), put(1, 1), put(1, 1), put(255, 8), put(1, 8)  # red: 255 or 1
    put(1, 1), put(0, 1), put(0, 1), put(0, 1)  # blue: 0
    put(1, 1), put(1, 1), put(1, 1), put(255, 8), put(0, 8)  # alpha: 255 or 0
    put(1, 1), put(0, 1), put(0, 1), put(0, 1)  # no distances
    # of two symbols the smaller has code 0
    put(0, 1), put(1, 1), put(1, 1)  # green 0, red 255, alpha 255
    put(1, 1), put(0, 1), put(0, 1)  # green 255, red 1, alpha 0
    put(0, 1)  # no more transforms
    put(0, 1), put(0, 1)  # no cache, one group
    # green: bytes 0b10110001 and length symbol 258 (three pixels): lengths by a code of its own
    put(0, 1), put(4 - 4 + 8, 4)  # twelve code lengths are told
    for symbol in (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8):
        put({18: 1, 1: 1}.get(symbol, 0), 3)
    put(0, 1)
    zeros = lambda n: (put(1, 1), put(n - 11, 7))  # noqa: E731  (18 has code 1, symbol 1 code 0)
    zeros(138), zeros(39), put(0, 1), zeros(80), put(0, 1), zeros(21)
    put(1, 1), put(0, 1), put(0, 1), put(0, 1)  # red 0
    put(1, 1), put(0, 1), put(0, 1), put(0, 1)  # blue 0
    put(1, 1), put(0, 1), put(1, 1), put(255, 8)  # alpha 255
    put(1, 1), put(0, 1), put(0, 1), put(0, 1)  # distance symbol 0: the pixel above
    put(0, 1)  # the byte
    put(1, 1)  # three pixels from above
    body = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    data = b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    values = np.rint(webp.decode(data)[0] * 255).astype(int)
    row = [0b10110001 >> k & 1 for k in range(8)]
    assert values.tolist() == [[[0, 255, 0, 255] if v else [255, 0, 0, 255] for v in row]] * 4


def tiff_of(pixels: np.ndarray, mark: str, packing: int, planar: bool = False, predictor: bool = False, tile: int = 0) -> bytes:
    """A TIFF by other means than the library's writer."""
    h, w, channels = pixels.shape
    kind = f"{mark}u{pixels.itemsize}"
    planes = [pixels[..., k : k + 1] for k in range(channels)] if planar else [pixels]
    parts = []
    for plane in planes:
        for y in range(0, h, tile or 3):
            for x in range(0, w, tile or w):
                part = plane[y : y + (tile or 3), x : x + (tile or w)]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                if predictor:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(kind).tobytes()
                parts.append({1: raw, 8: zlib.compress(raw), 32773: eps.packed(raw)[:-1], 5: lzw_of(raw)}[packing])
    places, at = [], 8
    for part in parts:
        places.append(at)
        at += len(part)
    starts, counts = struct.pack(f"{mark}{len(parts)}I", *places), struct.pack(f"{mark}{len(parts)}I", *map(len, parts))
    bits = struct.pack(f"{mark}{channels}H", *[8 * pixels.itemsize] * channels)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, channels, bits), (259, 3, 1, packing), (262, 3, 1, 2 if channels > 2 else 1), (277, 3, 1, channels), (284, 3, 1, 2 if planar else 1), (317, 3, 1, 2 if predictor else 1)]
    tags += [(322, 3, 1, tile), (323, 3, 1, tile), (324, 4, len(parts), starts), (325, 4, len(parts), counts)] if tile else [(273, 4, len(parts), starts), (278, 3, 1, 3), (279, 4, len(parts), counts)]
    if channels in (2, 4):
        tags.append((338, 3, 1, 2))
    body, extra = b"".join(parts), b""
    directory = 8 + len(body)
    after = directory + 6 + 12 * len(tags)
    out = struct.pack(mark + "H", len(tags))
    for tag, form, many, value in sorted(tags, key=lambda t: t[0]):
        size = many * (2 if form == 3 else 4)
        if isinstance(value, int):
            held = struct.pack(mark + ("H2x" if form == 3 else "I"), value)
        elif size <= 4:
            held = value.ljust(4, b"\0")
        else:
            held = struct.pack(mark + "I", after + len(extra))
            extra += value
        out += struct.pack(mark + "HHI", tag, form, many) + held
    return {"<": b"II*\0", ">": b"MM\0*"}[mark] + struct.pack(mark + "I", directory) + body + out + struct.pack(mark + "I", 0) + extra


def lzw_of(raw: bytes) -> bytes:
    """LZW as TIFF wants it, by the book."""
    bits, table, width, word = "", {bytes([k]): k for k in range(256)}, 9, b""
    bits += format(256, "09b")
    following = 258
    for k in range(len(raw)):
        more = word + raw[k : k + 1]
        if more in table:
            word = more
            continue
        bits += format(table[word], f"0{width}b")
        table[more] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            bits += format(256, "012b")
            table, following, width = {bytes([j]): j for j in range(256)}, 258, 9
        word = raw[k : k + 1]
    if word:
        bits += format(table[word], f"0{width}b")
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    bits += format(257, f"0{width}b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("mark", "<>")
@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
def test_tiffs_of_other_writers(mark, packing):
    for pixels in (noise((10, 13, 3)), noise((10, 13, 4)), noise((7, 5, 1)), noise((9, 40, 3), 2) // 64 * 64, (noise((6, 5, 3)).astype(np.uint16) << 8) + 17, np.repeat(noise((40, 60, 1)), 3, axis=2)):
        top = 65535 if pixels.dtype == np.uint16 else 255
        for options in ({}, {"planar": True}, {"predictor": True}, {"tile": 16}):
            data = tiff_of(pixels, mark, packing, **options)
            assert rasters.dimensions(data) == pixels.shape[1::-1] and (np.rint(rasters.decode(data) * top) == pixels).all(), options


def test_broken_tiffs_and_other_kinds():
    data = tiff_of(noise((10, 13, 3)), "<", 1)
    for cut in (4, 9, len(data) - 30):
        with pytest.raises(Exception):  # noqa: B017
            rasters.read(data[:cut])
        with pytest.raises(images.Failed):
            images.opened(data[:cut])
    odd = data.replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0))
    with pytest.raises(rasters.Unsupported):
        rasters.read(odd)
    assert tiff.run_lengths(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])) == bytes([1, 2, 3, 9, 9, 9, 7])


def test_eps_comes_back_and_refuses_alpha():
    for pixels in (noise((9, 11, 3)), np.full((300, 2, 3), 9, np.uint8), smooth()):
        data = eps.encode(pixels)
        assert (np.rint(eps.decode(data) * 255) == pixels).all() and data.startswith(b"%!PS-Adobe-3.0 EPSF-3.0") and max(map(len, data.splitlines())) < 160
    assert eps.packed(b"aaabcc") == bytes([254, 97, 2, 98, 99, 99, 128])
    with pytest.raises(images.Failed):
        images.encode(np.zeros((2, 2, 3)), np.zeros((2, 2)), "eps")


def test_alpha_is_kept_where_a_format_carries_it():
    rgb, alpha = smooth(9, 7) / 255.0, np.linspace(0, 1, 63).reshape(9, 7)
    for fmt in ("png", "webp", "tiff"):
        for profile in (None, "adobe"):
            back, a = images.opened(images.encode(rgb, alpha, fmt, profile))
            assert np.abs(a - alpha).max() < 0.003 and np.abs(back - rgb)[alpha > 0].max() < 0.02
    for fmt in ("jpeg", "bmp", "eps"):
        with pytest.raises(images.Failed):
            images.encode(rgb, alpha, fmt)


def test_a_psd_is_read_by_its_merged_picture():
    pixels = noise((6, 9, 3))
    data = rasters.encode_psd([("BG", np.concatenate([pixels, pixels[..., :1]], axis=2))], pixels, [(1039, "", images.profile_of("adobe"))])
    picture = rasters.read(data)
    assert (np.rint(picture.values * 255) == pixels).all() and profiles.description(picture.profile) == "Adobe RGB (1998)" and rasters.dimensions(data) == (9, 6)
    raw = 3 * 6 * 9
    rows = [eps.packed(pixels[y, :, c].tobytes())[:-1] for c in range(3) for y in range(6)]
    runs = data[: -raw - 2] + struct.pack(">H", 1) + struct.pack(f">{len(rows)}H", *map(len, rows)) + b"".join(rows)
    assert (np.rint(rasters.read(runs).values * 255) == pixels).all()


# -- profiles ----------------------------------------------------------------------------------


def with_tags(tags: dict[bytes, bytes], space: bytes = b"RGB ", connection: bytes = b"XYZ ") -> bytes:
    at, table, body = 132 + 12 * len(tags), struct.pack(">I", len(tags)), b""
    for key, value in tags.items():
        table += key + struct.pack(">II", at + len(body), len(value))
        body += value + b"\0" * (-len(value) % 4)
    return (b"\0" * 16 + space + connection + b"\0" * 12 + b"acsp").ljust(128, b"\0") + table + body


def s15(*values: float) -> bytes:
    return struct.pack(f">{len(values)}i", *(round(v * 65536) for v in values))


def test_matrix_profiles_in_closed_form():
    device = noise((4, 5, 3)) / 255
    same = profiles.to_linear_srgb(images.profile_of("srgb"), device)
    assert np.abs(same - images.linear(device)).max() < 6e-4
    adobe = profiles.to_linear_srgb(images.profile_of("adobe"), images.profiled(images.linear(device), "adobe"))
    assert np.abs(adobe - images.linear(device)).max() < 2e-3
    white = profiles.to_linear_srgb(images.profile_of("adobe"), np.ones((1, 1, 3)))
    assert np.abs(white - 1).max() < 1e-3


def test_every_kind_of_curve():
    x = np.linspace(0, 1, 11)
    cases = [
        (b"curv\0\0\0\0" + struct.pack(">I", 0), x), (b"curv\0\0\0\0" + struct.pack(">IH", 1, 512), x**2), (b"curv\0\0\0\0" + struct.pack(">I3H", 3, 0, 16384, 65535), np.interp(x, [0, 0.5, 1], [0, 16384 / 65535, 1])),
        (b"para\0\0\0\0" + struct.pack(">HH", 0, 0) + s15(2.0), x**2),
        (b"para\0\0\0\0" + struct.pack(">HH", 1, 0) + s15(2.0, 2.0, -0.5), np.where(x >= 0.25, np.maximum(2 * x - 0.5, 0) ** 2, 0)),
        (b"para\0\0\0\0" + struct.pack(">HH", 2, 0) + s15(2.0, 2.0, -0.5, 0.125), np.where(x >= 0.25, np.maximum(2 * x - 0.5, 0) ** 2 + 0.125, 0.125)),
        (b"para\0\0\0\0" + struct.pack(">HH", 3, 0) + s15(2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045), images.linear(x)),
        (b"para\0\0\0\0" + struct.pack(">HH", 4, 0) + s15(2.0, 1.0, 0.0, 0.5, 0.5, 0.25, 0.125), np.where(x >= 0.5, x**2 + 0.25, 0.5 * x + 0.125)),
    ]
    for raw, expected in cases:
        curve, size = profiles._curve(raw)
        assert np.abs(curve(x) - expected).max() < 1e-4 and size == len(raw)
    with pytest.raises(profiles.BadProfile):
        profiles._curve(b"para\0\0\0\0" + struct.pack(">HH", 9, 0))


def test_tables_of_three_and_four_inputs():
    corner = np.stack(np.meshgrid(*[np.arange(3) / 2] * 3, indexing="ij"), axis=-1)
    points = np.random.default_rng(2).random((200, 3))
    linear = corner @ np.array([[0.2, 0.5, 0.1], [0.3, 0.1, 0.2], [0.1, 0.2, 0.4]])
    expected = points @ np.array([[0.2, 0.5, 0.1], [0.3, 0.1, 0.2], [0.1, 0.2, 0.4]])
    assert np.abs(profiles.tetrahedral(linear, points) - expected).max() < 1e-12 and np.abs(profiles.multilinear(linear, points) - expected).max() < 1e-12
    # a table that is the identity into XYZ halved, as 16 bits count it
    grid = np.rint(corner.reshape(-1, 3) * 32768).astype(">u2").tobytes()
    ramp = np.array([0, 65535], ">u2").tobytes() * 3
    raw = b"mft2\0\0\0\0" + bytes([3, 3, 3, 0]) + s15(1, 0, 0, 0, 1, 0, 0, 0, 1) + struct.pack(">HH", 2, 2) + ramp + grid + ramp
    device = points.reshape(10, 20, 3) * 0.3 + 0.1
    got = profiles.to_linear_srgb(with_tags({b"A2B0": raw}), device)
    assert np.abs(got - np.clip(device @ profiles.XYZ_TO_SRGB.T, 0, 1)).max() < 1e-3
    # ink: no ink is white, black ink is black, in Lab and 8 bits
    inks = np.stack(np.meshgrid(*[np.arange(2)] * 4, indexing="ij"), axis=-1).reshape(-1, 4)
    lab = np.stack([(1 - inks.max(axis=1)) * 255, np.full(16, 128), np.full(16, 128)], axis=1).astype(np.uint8)
    ramp8 = bytes(range(256))
    raw = b"mft1\0\0\0\0" + bytes([4, 3, 2, 0]) + s15(1, 0, 0, 0, 1, 0, 0, 0, 1) + ramp8 * 4 + lab.tobytes() + ramp8 * 3
    got = profiles.to_linear_srgb(with_tags({b"A2B0": raw}, b"CMYK", b"Lab "), np.array([[[0, 0, 0, 0.0], [0, 0, 0, 1.0]]]))
    assert np.abs(got[0, 0] - 1).max() < 0.01 and got[0, 1].max() < 1e-3


def test_tables_between_curves():
    flat = b"curv\0\0\0\0" + struct.pack(">I", 0)
    square = b"para\0\0\0\0" + struct.pack(">HH", 0, 0) + s15(2.0)
    matrix = s15(0.25, 0, 0, 0, 0.25, 0, 0, 0, 0.25, 0.0, 0.0, 0.0)
    head = 32
    b_at, matrix_at = head, head + 3 * len(flat)
    m_at = matrix_at + len(matrix)
    raw = b"mAB \0\0\0\0" + bytes([3, 3, 0, 0]) + struct.pack(">5I", b_at, matrix_at, m_at, 0, 0) + flat * 3 + matrix + square * 3
    device = noise((3, 4, 3)) / 255
    got = profiles.to_linear_srgb(with_tags({b"A2B0": raw}), device)
    assert np.abs(got - np.clip(device**2 * 0.25 * 65535 / 32768 @ profiles.XYZ_TO_SRGB.T, 0, 1)).max() < 1e-3


def test_a_broken_profile_is_no_failure():
    pixels = noise((4, 4, 3))
    good = images.profile_of("adobe")
    for held in (b"x", good[:200], good[:36] + b"none" + good[40:], with_tags({}), good[:16] + b"CMYK" + good[20:]):
        rgb, _ = images.opened(rasters.encode_png(pixels, held))
        assert np.abs(rgb - images.linear(pixels / 255)).max() < 1e-9
    assert profiles.description(good) == "Adobe RGB (1998)" and np.abs(images.opened(rasters.encode_png(pixels, good))[0] - images.linear(pixels / 255)).max() > 0.01
