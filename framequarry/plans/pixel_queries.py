"""Queries over colour, compositing, shadows, backdrops and placement arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, color
from ..operators import pixels as px
from .adapters import PIXELS_SQL, picture, pixels
from .registry import query, table

_DECODE = "CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"
_ENCODE = "CASE WHEN {x} <= 0.0031308 THEN {x} * 12.92 ELSE 1.055 * pow({x}, 1 / 2.4) - 0.055 END"
_LUM = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


def _rounded(df: DataFrame, keys: list[str], values: dict[str, Column], digits: int = 6) -> DataFrame:
    return df.select(*keys, *(F.round(v, digits).alias(n) for n, v in values.items()))


@query(f"WITH l AS (SELECT DISTINCT p_partkey % 256 AS level FROM part) SELECT level, CAST(floor(least(1.0, greatest(0.0, {_DECODE.format(x='(level / 255.0)')})) * 65535 + 0.5) AS INTEGER) AS linear16, CAST(level AS INTEGER) AS back8 FROM l")
def srgb_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 8-bit level to 16-bit linear, and back to where it came from."""
    levels = table(spark, sf_dir, "part").select((F.col("p_partkey") % 256).alias("level")).distinct()
    linear = color.srgb_decode(color.from_uint8(F.col("level")))
    return levels.select("level", color.to_uint(linear, 65535).alias("linear16"), color.to_uint(color.srgb_encode(linear)).alias("back8"))


@query(f"""WITH {PIXELS_SQL}, a AS (SELECT img, i, {' , '.join('+ '.join(f'{m!r} * {c}' for m, c in zip(row, 'rgb', strict=True)) + f' AS {n}' for row, n in zip(color.SRGB_TO_ADOBE, ('ar', 'ag', 'ab'), strict=True))} FROM px)
SELECT img, i, {', '.join(f'round(pow(least(1.0, greatest(0.0, {n})), 1 / (563.0 / 256.0)), 6) AS {n}' for n in ('ar', 'ag', 'ab'))} FROM a""")
def adobe_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear sRGB pixels as encoded Adobe RGB."""
    converted = color.convert_linear((F.col("r"), F.col("g"), F.col("b")), "srgb", "adobe")
    return _rounded(pixels(spark, sf_dir), ["img", "i"], {n: color.adobe_encode(c) for n, c in zip(("ar", "ag", "ab"), converted, strict=True)})


_HEXES = "CASE p_partkey % 6 WHEN 0 THEN '#' || printf('%06x', p_partkey * 7919 % 16777216) WHEN 1 THEN printf('%06X', p_partkey * 7919 % 16777216) WHEN 2 THEN '#' || printf('%03x', p_partkey % 4096) WHEN 3 THEN printf('%03X', p_partkey % 4096) WHEN 4 THEN '#12345' ELSE 'white' END"


@query(f"""WITH h AS (SELECT p_partkey, upper(regexp_replace(trim({_HEXES}), '^#', '')) AS bare FROM part),
n AS (SELECT p_partkey, CASE WHEN length(bare) = 3 THEN regexp_replace(bare, '([0-9A-F])', '\\1\\1', 'g') ELSE bare END AS six FROM h)
SELECT p_partkey, CASE WHEN regexp_full_match(six, '[0-9A-F]{{6}}') THEN '#' || six END AS colour,
  {', '.join(f"CASE WHEN regexp_full_match(six, '[0-9A-F]{{6}}') THEN CAST('0x' || six[{2 * k + 1}:{2 * k + 2}] AS INTEGER) END AS {c}" for k, c in enumerate('rgb'))} FROM n""")
def hex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background colours in all accepted and two refused spellings."""
    key = F.col("p_partkey")
    six, three = F.lpad(F.hex(key * 7919 % 16777216), 6, "0"), F.lpad(F.hex(key % 4096), 3, "0")
    text = F.when(key % 6 == 0, F.concat(F.lit("#"), F.lower(six))).when(key % 6 == 1, six).when(key % 6 == 2, F.concat(F.lit("#"), F.lower(three))).when(key % 6 == 3, three).when(key % 6 == 4, "#12345").otherwise("white")
    named = table(spark, sf_dir, "part").select("p_partkey", color.normalise_hex(text).alias("colour"))
    return named.select("p_partkey", "colour", *(color.hex_channel(F.col("colour"), k).alias(c) for k, c in enumerate("rgb")))


@query(f"WITH {PIXELS_SQL} SELECT img, i, CAST(floor(r * 255 + 0.5) AS INTEGER) AS r8, CAST(floor(g * 65535 + 0.5) AS INTEGER) AS g16, round({_LUM}, 6) AS lum FROM px")
def uint8_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised channels (half up) and luminance."""
    return pixels(spark, sf_dir).select("img", "i", color.to_uint(F.col("r")).alias("r8"), color.to_uint(F.col("g"), 65535).alias("g16"), F.round(color.luminance(F.col("r"), F.col("g"), F.col("b")), 6).alias("lum"))


_SHADOW = "(1 - 0.4 * y / 7.0)"


@query(f"""WITH {PIXELS_SQL}, f AS (SELECT img, i, img % 3 = 0 AS transparent, a, {', '.join(f'{c} * a + least(1.0, greatest(0.0, 0.9 * {_SHADOW})) * (1 - a) AS flat_{c}, {c}' for c in 'rgb')} FROM px)
SELECT img, i, {', '.join(f'round(CASE WHEN transparent THEN {c} ELSE flat_{c} END, 6) AS {c}' for c in 'rgb')}, round(CASE WHEN transparent THEN a ELSE 1.0 END, 6) AS a FROM f""")
def composite_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures over a shadowed plate; a transparent job passes through and drops the shadow."""
    return _rounded(px.flatten(pixels(spark, sf_dir), F.when(F.col("img") % 3 != 0, F.lit(0.9)), 1 - 0.4 * F.col("y") / 7.0), ["img", "i"], {c: F.col(c) for c in "rgba"})


@query(f"WITH {PIXELS_SQL} SELECT img, i, round(least(1.0, greatest(0.0, r * (0.5 + y / 5.0))), 6) AS shaded FROM px")
def shadow_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background times a shadow ratio that may exceed one, clipped."""
    return _rounded(pixels(spark, sf_dir), ["img", "i"], {"shaded": px.shaded(F.col("r"), 0.5 + F.col("y") / 5.0)})


@query(f"""WITH {PIXELS_SQL}, off AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE abs(dx) <= CAST(round_even(sqrt(9 - dy * dy), 0) AS INTEGER)),
band AS (SELECT DISTINCT s.img, s.y + dy AS y, s.x + dx AS x FROM px s, off WHERE s.a > 0.001 AND s.a < 0.999),
w AS (SELECT px.*, band.img IS NOT NULL AND px.a > 0.001 AS inside, greatest(0.0, least(1.0, (px.a - 0.08) / (0.25 - 0.08))) AS t FROM px LEFT JOIN band ON band.img = px.img AND band.y = px.y AND band.x = px.x)
SELECT img, i, {', '.join(f'round(CASE WHEN inside THEN {c} + (least(1.0, greatest(0.0, ({c} - (1 - a) * 0.9) / greatest(a, 0.08))) - {c}) * t ELSE {c} END, 6) AS {c}' for c in 'rgb')} FROM w""")
def decontaminate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take the backdrop's colour out of the soft edge, within a band around it."""
    return _rounded(px.decontaminate(pixels(spark, sf_dir), F.lit(0.9), 8), ["img", "i"], {c: F.col(c) for c in "rgb"})


_RING = "ring AS (SELECT * FROM px WHERE y = 0 UNION ALL SELECT * FROM px WHERE y = 7 UNION ALL SELECT * FROM px WHERE x = 0 UNION ALL SELECT * FROM px WHERE x = 7)"
_BACK = "back AS (SELECT img, " + ", ".join(f"quantile_cont({c}, 0.5) AS b{c}" for c in "rgb") + " FROM ring GROUP BY img)"


@query(f"WITH {PIXELS_SQL}, {_RING}, {_BACK} SELECT img, round(br, 6) AS br, round(bg, 6) AS bg, round(bb, 6) AS bb FROM back")
def backdrop_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median colour of the border ring, corners counting twice."""
    return _rounded(px.backdrop(picture(spark, sf_dir), 8), ["img"], {c: F.col(c) for c in ("br", "bg", "bb")})


_PRODUCT = "prod AS (SELECT img, " + ", ".join(f"quantile_cont({c}, 0.5) AS f{c}" for c in "rgb") + " FROM px WHERE a > 0.5 GROUP BY img)"


@query(f"""WITH {PIXELS_SQL}, {_RING}, {_BACK}, {_PRODUCT}, s AS (
  SELECT img, i, fr * fr + fg * fg + fb * fb AS ff, br * br + bg * bg + bb * bb AS bb2, fr * br + fg * bg + fb * bb AS fb2, fr * r + fg * g + fb * b AS fo, br * r + bg * g + bb * b AS bo FROM px JOIN back USING (img) JOIN prod USING (img))
SELECT img, i, round(CASE WHEN ff * bb2 - fb2 * fb2 < 1e-6 OR ff < 1e-6 THEN 0.0 ELSE least(1.0, greatest(0.0, (bb2 * fo - fb2 * bo) / (ff * bb2 - fb2 * fb2))) END, 5) AS a, round(least(1.0, greatest(0.0, 1 - bo / bb2)), 5) AS loss FROM s""")
def mixture_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha of each pixel as a mixture of product and backdrop, and as loss of backdrop."""
    return _rounded(px.mixture(pixels(spark, sf_dir), picture(spark, sf_dir), 8), ["img", "i"], {"a": F.col("mix"), "loss": F.col("loss")}, 5)


@query(f"""WITH {PIXELS_SQL}, l AS (SELECT *, {_LUM} AS lum, x / 7.0 - 0.5 AS u, y / 7.0 - 0.5 AS v FROM px WHERE a <= 0.02), c AS (SELECT img, quantile_cont(lum, 0.7) AS cut FROM l GROUP BY img)
SELECT l.img, CAST(count(*) AS BIGINT) AS n, round(sum(u), 4) AS su, round(sum(v), 4) AS sv, round(sum(u * u), 4) AS suu, round(sum(u * v), 4) AS suv, round(sum(v * v), 4) AS svv, round(sum(u * u * u * u), 4) AS s4, round(sum(lum), 4) AS sl, round(sum(lum * u), 4) AS slu, round(sum(lum * v * v), 4) AS slvv
FROM l JOIN c ON l.img = c.img AND l.lum >= cut GROUP BY l.img""")
def plate_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal-equation sums of the quadratic backdrop fit over the brightest backdrop pixels."""
    return px.plate_sums(pixels(spark, sf_dir), 8)


@query(f"""WITH {PIXELS_SQL}, p AS (SELECT img, max({_LUM}) AS plate FROM px GROUP BY img), r AS (SELECT px.img, i, CASE WHEN a > 0.02 OR abs(least(3.0, greatest(0.0, {_LUM} / greatest(plate, 1e-4))) - 1) < 0.02 THEN 1.0 ELSE least(3.0, greatest(0.0, {_LUM} / greatest(plate, 1e-4))) END AS ratio FROM px JOIN p ON px.img = p.img)
SELECT img, round(min(ratio), 6) AS darkest, round(avg(CASE WHEN abs(ratio - 1) > 0.02 THEN 1.0 ELSE 0.0 END), 6) AS coverage, avg(CASE WHEN abs(ratio - 1) > 0.02 THEN 1.0 ELSE 0.0 END) BETWEEN 1e-9 AND 0.35 AS kept FROM r GROUP BY img""")
def ratio_deadband_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadow ratio against a flat plate without smoothing: dead band, pinning under the product, coverage guard."""
    return px.flat_shadow(pixels(spark, sf_dir))


_LI = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, CAST(l_partkey % 997 AS INTEGER) AS p, CAST(l_suppkey % 97 AS INTEGER) AS s FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") % 997).cast("int").alias("p"), (F.col("l_suppkey") % 97).cast("int").alias("s"))


_BOX = "l AS (" + _LI + "), bx AS (SELECT *, s AS x0, q AS y0, s + p % 50 AS x1, q + p % 30 AS y1, 200 AS w, 150 AS h FROM l)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.box(F.col("s"), F.col("q"), F.col("s") + F.col("p") % 50, F.col("q") + F.col("p") % 30)
    return _lines(spark, sf_dir).withColumn("b", b)


@query(f"""WITH l AS ({_LI}), r AS (SELECT *, q % 2 = 0 AS cover, p % 3 = 0 AS up, greatest(400.0 / (p + 1), 300.0 / (s + 1)) AS big, least(400.0 * (1 - 2 * (q % 10) / 100.0) / (p + 1), 300.0 * (1 - 2 * (q % 10) / 100.0) / (s + 1)) AS small FROM l)
SELECT l_orderkey, l_linenumber, round(CASE WHEN (CASE WHEN cover THEN big ELSE small END) > 1 AND NOT up THEN 1.0 WHEN cover THEN big ELSE small END, 6) AS scale, (CASE WHEN cover THEN big ELSE small END) > 1 AND NOT up AS upscale_skipped FROM r""")
def scale_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale of a product on a 400x300 canvas: contain with margin, or cover; growing only if allowed."""
    f = boxes.scale_to_fit(F.col("p") + 1, F.col("s") + 1, F.lit(400.0), F.lit(300.0), F.col("q") % 10, F.col("q") % 2 == 0, F.col("p") % 3 == 0)
    return _lines(spark, sf_dir).withColumn("f", f).select("l_orderkey", "l_linenumber", F.round("f.scale", 6).alias("scale"), F.col("f.upscale_skipped").alias("upscale_skipped"))


@query(f"""WITH l AS ({_LI}), o AS (SELECT *, greatest(0, q - 25) AS x0, greatest(0, s - 60) AS y0, least(40, q - 25 + p % 60) AS x1, least(30, s - 60 + p % 40) AS y1 FROM l)
SELECT l_orderkey, l_linenumber, {', '.join(f'CASE WHEN x0 < x1 AND y0 < y1 THEN {c} END AS {c}' for c in ('x0', 'y0', 'x1', 'y1'))} FROM o""")
def overlap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a shifted source meets a 40x30 target."""
    o = boxes.overlap(F.col("p") % 60, F.col("p") % 40, F.lit(40), F.lit(30), F.col("q") - 25, F.col("s") - 60)
    return _lines(spark, sf_dir).withColumn("o", o).select("l_orderkey", "l_linenumber", *(F.col(f"o.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"""WITH {_BOX} SELECT l_orderkey, l_linenumber, greatest(0, x0 - CAST(round_even((x1 - x0) * 15 / 100.0, 0) AS INTEGER)) AS x0, greatest(0, y0 - CAST(round_even((y1 - y0) * 15 / 100.0, 0) AS INTEGER)) AS y0,
  least(w, x1 + CAST(round_even((x1 - x0) * 15 / 100.0, 0) AS INTEGER)) AS x1, least(h, y1 + CAST(round_even((y1 - y0) * 15 / 100.0, 0) AS INTEGER)) AS y1 FROM bx""")
def box_pad_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes padded by 15 % of their own size, half to even, within the frame."""
    padded = boxes.pad_and_clamp(F.col("b"), F.lit(200), F.lit(150), F.lit(15))
    return _boxes(spark, sf_dir).withColumn("c", padded).select("l_orderkey", "l_linenumber", *(F.col(f"c.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")))


@query(f"WITH l AS ({_LI}) SELECT l_orderkey, l_linenumber, s * 641 // 1000 AS x0, q * 479 // 1000 AS y0, p * 641 // 1000 AS x1, (p + s) % 1000 * 479 // 1000 AS y1 FROM l")
def box_norm_to_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y-first boxes in thousandths as x-first pixels of a 641x479 frame."""
    c = boxes.norm_to_pixels(F.col("q"), F.col("s"), (F.col("p") + F.col("s")) % 1000, F.col("p"), F.lit(641), F.lit(479))
    return _lines(spark, sf_dir).withColumn("c", c).select("l_orderkey", "l_linenumber", *(F.col(f"c.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")))


@query(f"WITH {_BOX} SELECT l_orderkey, l_linenumber, x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) * 1.0 / (w * h) BETWEEN 0.005 AND 0.92 AS plausible FROM bx")
def box_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a box could be a subject: not empty, not a speck, not the whole frame."""
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", boxes.plausible_subject(F.col("b"), F.lit(200), F.lit(150)).alias("plausible"))


_POLY = "v AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS pos, (10 + o_orderkey % 17) * 1.0 AS x, CAST(floor(o_totalprice) AS BIGINT) % 23 * 1.0 AS y FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"


@query(f"""WITH {_POLY}, e AS (SELECT *, COALESCE(lead(x) OVER w, first_value(x) OVER w) AS nx, COALESCE(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY pos))
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(x * ny - nx * y) / 2, 6) AS area, sum(x * ny - nx * y) / 2 < 0 AS reversed FROM e GROUP BY o_custkey""")
def polygon_winding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed area of each polygon by the shoelace sum, wrapping around, and whether it must be reversed."""
    v = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (10.0 + F.col("o_orderkey") % 17).alias("x"), (F.floor("o_totalprice") % 23).cast("double").alias("y"))
    ring = v.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "x", "y"))).alias("p"))  # a polygon's vertices, one array
    size = F.size("p")

    def term(i: Column) -> Column:
        a, b = F.get("p", i), F.get("p", (i + 1) % size)
        return a["x"] * b["y"] - b["x"] * a["y"]

    area = F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), term), F.lit(0.0), lambda s, t: s + t) / 2
    return ring.select("o_custkey", size.cast("long").alias("n"), F.round(area, 6).alias("area"), (area < 0).alias("reversed"))


@query("SELECT p_partkey, CAST(round_even((p_size - 25) / 25.0 * 16777216.0, 0) AS BIGINT) & 4294967295 AS raw, CAST(round_even((p_size - 25) / 25.0 * 16777216.0, 0) AS BIGINT) AS back FROM part")
def fixed_8_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions as 8.24 fixed point modulo 2^32, and their signed value again."""
    raw = boxes.fixed_8_24((F.col("p_size") - 25) / 25.0)
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), boxes.signed32(raw).alias("back"))


@query("""WITH r AS (SELECT p_partkey, p_size * 900 AS w, (p_partkey % 60) * 500 AS h FROM part)
SELECT p_partkey, least(greatest(w, 1), 20000) AS w, least(greatest(h, 1), 20000) AS h, CAST(least(greatest(w, 1), 20000) AS BIGINT) * least(greatest(h, 1), 20000) > 200000000 AS too_large, CASE WHEN p_partkey % 2000 = 0 THEN 'auto' WHEN CAST(w AS BIGINT) * h <= 250000 THEN 'preview' ELSE 'auto' END AS quality FROM r""")
def size_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output sizes that follow the source, clamped; too many pixels; the vendor's size class."""
    w, h = F.col("p_size").cast("long") * 900, F.col("p_partkey") % 60 * 500
    cw, ch = boxes.clamp_size(w), boxes.clamp_size(h)
    return table(spark, sf_dir, "part").select("p_partkey", cw.alias("w"), ch.alias("h"), (cw * ch > 200000000).alias("too_large"), F.when(F.col("p_partkey") % 2000 == 0, "auto").when(w * h <= 250000, "preview").otherwise("auto").alias("quality"))



