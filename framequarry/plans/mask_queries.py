"""Queries over masks: measures, rejection, ranking, selection, union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import autopick, masks
from .adapters import GRID_SQL, JOBS_SQL, SIDE, grid, job_images
from .registry import query, table

MEASURES = f"""{GRID_SQL}, core AS (SELECT vec_id, i, y, x FROM m WHERE a > 0.5),
border AS (
  SELECT c.vec_id, count(*) AS perimeter FROM core c
  WHERE c.x = 0 OR c.x = 7 OR c.y = 0 OR c.y = 7 OR (
    SELECT count(*) FROM core d WHERE d.vec_id = c.vec_id AND abs(d.x - c.x) + abs(d.y - c.y) = 1) < 4
  GROUP BY c.vec_id
), mm AS (
  SELECT vec_id, any_value(image_id) AS image_id, any_value(pool_pos) AS pool_pos, count(*) FILTER (a > 0.5) / 64.0 AS coverage, count(*) FILTER (a > 0.05 AND a < 0.95) AS soft_px,
    bool_or(a > 0.5 AND y = 0) AND bool_or(a > 0.5 AND y = 7) AND bool_or(a > 0.5 AND x = 0) AND bool_or(a > 0.5 AND x = 7) AS all_edges
  FROM m GROUP BY vec_id
)"""

REACH = """reach(vec_id, root, i, y, x) AS (
  SELECT vec_id, i, i, y, x FROM core
  UNION
  SELECT r.vec_id, r.root, c.i, c.y, c.x FROM reach r JOIN core c ON c.vec_id = r.vec_id AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1
), label AS (SELECT vec_id, i, min(root) AS l FROM reach GROUP BY vec_id, i),
solid AS (SELECT vec_id, max(n) * 1.0 / sum(n) AS solidity FROM (SELECT vec_id, l, count(*) AS n FROM label GROUP BY vec_id, l) GROUP BY vec_id)"""

SCORED = """scored AS (
  SELECT mm.*, COALESCE(solidity, 0.0) AS solidity, COALESCE(perimeter, 0) AS perimeter FROM mm LEFT JOIN solid USING (vec_id) LEFT JOIN border USING (vec_id)
), judged AS (
  SELECT *, CASE WHEN coverage < 0.001 THEN 'empty' WHEN coverage > 0.995 THEN 'full_frame' WHEN all_edges THEN 'inverted' WHEN solidity < 0.60 THEN 'fragmented' END AS reason,
    CASE WHEN perimeter < 8 OR soft_px / 64.0 < 1e-5 THEN 0.0 ELSE exp(-power((soft_px * 1.0 / perimeter - 1.5) / 1.8, 2)) END AS edge,
    CASE WHEN coverage BETWEEN 0.05 AND 0.70 THEN 1.0 WHEN coverage < 0.05 THEN coverage / 0.05 ELSE greatest(0.0, 1.0 - (coverage - 0.70) / 0.30) END AS plausible
  FROM scored
), rated AS (SELECT *, CASE WHEN reason IS NULL THEN least(1.0, greatest(0.0, 0.55 * edge + 0.30 * solidity + 0.15 * plausible)) END AS score FROM judged)"""


@query(f"""WITH {GRID_SQL} SELECT vec_id, CAST(COALESCE(min(x) FILTER (a > 0.05), 0) AS INTEGER) AS x0, CAST(COALESCE(min(y) FILTER (a > 0.05), 0) AS INTEGER) AS y0,
  CAST(COALESCE(max(x) FILTER (a > 0.05) + 1, 0) AS INTEGER) AS x1, CAST(COALESCE(max(y) FILTER (a > 0.05) + 1, 0) AS INTEGER) AS y1 FROM m GROUP BY vec_id""")
def mask_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = grid(spark, sf_dir).select("vec_id", masks.bbox(F.col("alpha"), SIDE).alias("b"))
    return b.select("vec_id", *(F.col(f"b.{n}").cast("int").alias(n) for n in ("x0", "y0", "x1", "y1")))


@query(f"WITH {GRID_SQL} SELECT vec_id, CASE WHEN sum(a) > 0 THEN round(sum(a * x) / sum(a) + 0.5, 6) END AS cx, CASE WHEN sum(a) > 0 THEN round(sum(a * y) / sum(a) + 0.5, 6) END AS cy FROM m GROUP BY vec_id")
def mask_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = grid(spark, sf_dir).select("vec_id", masks.centroid(F.col("alpha"), SIDE).alias("c"))
    return c.select("vec_id", F.round("c.cx", 6).alias("cx"), F.round("c.cy", 6).alias("cy"))


@query(f"WITH {MEASURES} SELECT mm.vec_id, round(coverage, 6) AS coverage, round(soft_px / 64.0, 6) AS soft, CAST(COALESCE(perimeter, 0) AS INTEGER) AS perimeter, all_edges FROM mm LEFT JOIN border USING (vec_id)")
def mask_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("alpha")
    return grid(spark, sf_dir).select("vec_id", F.round(masks.coverage(a), 6).alias("coverage"), F.round(masks.soft_count(a) / F.size(a), 6).alias("soft"), masks.border_count(a, SIDE).alias("perimeter"), masks.touches_all_edges(a, SIDE).alias("all_edges"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autopick.measured(autopick.with_objects(grid(spark, sf_dir), SIDE), SIDE, traced=False)


@query(f"WITH RECURSIVE {MEASURES}, {REACH} SELECT mm.vec_id, round(COALESCE(solidity, 0), 6) AS solidity FROM mm LEFT JOIN solid USING (vec_id)")
def mask_solidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autopick.with_objects(grid(spark, sf_dir), SIDE).select("vec_id", F.round("solidity", 6).alias("solidity"))


@query(f"WITH RECURSIVE {MEASURES}, {REACH}, {SCORED} SELECT vec_id, reason FROM judged")
def mask_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("vec_id", "reason")


@query(f"WITH RECURSIVE {MEASURES}, {REACH}, {SCORED} SELECT vec_id, round(edge, 6) AS edge, round(plausible, 6) AS plausible, round(score, 4) AS score FROM rated")
def edge_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    edge = masks.edge_quality(F.col("soft_px"), F.col("perimeter"), F.size("alpha"), F.lit(float(SIDE)))
    return m.select("vec_id", F.round(edge, 6).alias("edge"), F.round(masks.coverage_plausibility(F.col("coverage")), 6).alias("plausible"), F.round("score", 4).alias("score"))


_ISOLATED = f"""WITH RECURSIVE {MEASURES}, {REACH}, {SCORED},
faint AS (SELECT m.vec_id, m.i, m.y, m.x, m.a FROM m JOIN rated r ON r.vec_id = m.vec_id AND r.reason = 'fragmented' WHERE m.a > 0.05),
reach2(vec_id, root, i, y, x) AS (
  SELECT vec_id, i, i, y, x FROM faint UNION
  SELECT r.vec_id, r.root, c.i, c.y, c.x FROM reach2 r JOIN faint c ON c.vec_id = r.vec_id AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1
), label2 AS (SELECT vec_id, i, min(root) AS l FROM reach2 GROUP BY vec_id, i),
sizes AS (SELECT f.vec_id, l, count(*) FILTER (a > 0.5) AS n FROM faint f JOIN label2 USING (vec_id, i) GROUP BY f.vec_id, l),
pick AS (SELECT vec_id, l FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, l DESC) AS k, count(*) OVER (PARTITION BY vec_id) AS many FROM sizes) WHERE k = 1 AND many > 1),
m3 AS (
  SELECT m.vec_id, m.image_id, m.pool_pos, m.i, m.y, m.x, CASE WHEN label2.l = pick.l THEN m.a ELSE 0.0 END AS a
  FROM m JOIN pick ON m.vec_id = pick.vec_id LEFT JOIN label2 ON label2.vec_id = m.vec_id AND label2.i = m.i
), core3 AS (SELECT vec_id, i, y, x FROM m3 WHERE a > 0.5),
border3 AS (
  SELECT c.vec_id, count(*) AS perimeter FROM core3 c
  WHERE c.x = 0 OR c.x = 7 OR c.y = 0 OR c.y = 7 OR (SELECT count(*) FROM core3 d WHERE d.vec_id = c.vec_id AND abs(d.x - c.x) + abs(d.y - c.y) = 1) < 4
  GROUP BY c.vec_id
), mm3 AS (
  SELECT vec_id, any_value(image_id) AS image_id, any_value(pool_pos) AS pool_pos, count(*) FILTER (a > 0.5) / 64.0 AS coverage, count(*) FILTER (a > 0.05 AND a < 0.95) AS soft_px,
    bool_or(a > 0.5 AND y = 0) AND bool_or(a > 0.5 AND y = 7) AND bool_or(a > 0.5 AND x = 0) AND bool_or(a > 0.5 AND x = 7) AS all_edges
  FROM m3 GROUP BY vec_id
), reach3(vec_id, root, i, y, x) AS (
  SELECT vec_id, i, i, y, x FROM core3 UNION
  SELECT r.vec_id, r.root, c.i, c.y, c.x FROM reach3 r JOIN core3 c ON c.vec_id = r.vec_id AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1
), label3 AS (SELECT vec_id, i, min(root) AS l FROM reach3 GROUP BY vec_id, i),
solid3 AS (SELECT vec_id, max(n) * 1.0 / sum(n) AS solidity FROM (SELECT vec_id, l, count(*) AS n FROM label3 GROUP BY vec_id, l) GROUP BY vec_id),
again AS (
  SELECT mm3.*, COALESCE(solidity, 0.0) AS solidity, COALESCE(perimeter, 0) AS perimeter FROM mm3 LEFT JOIN solid3 USING (vec_id) LEFT JOIN border3 USING (vec_id)
), again2 AS (
  SELECT image_id, pool_pos, least(1.0, greatest(0.0, 0.55 * (CASE WHEN perimeter < 8 OR soft_px / 64.0 < 1e-5 THEN 0.0 ELSE exp(-power((soft_px * 1.0 / perimeter - 1.5) / 1.8, 2)) END) + 0.30 * solidity
    + 0.15 * (CASE WHEN coverage BETWEEN 0.05 AND 0.70 THEN 1.0 WHEN coverage < 0.05 THEN coverage / 0.05 ELSE greatest(0.0, 1.0 - (coverage - 0.70) / 0.30) END))) AS score
  FROM again WHERE NOT (coverage < 0.001 OR coverage > 0.995 OR all_edges OR solidity < 0.60)
), images AS (SELECT image_id, count(*) AS pool, min(pool_pos) AS preferred, bool_or(score IS NOT NULL) AS usable FROM rated GROUP BY image_id),
tried AS (
  SELECT image_id, pool_pos, score, false AS recovered FROM rated WHERE score IS NOT NULL
  UNION ALL SELECT a.image_id, pool_pos, score, true FROM again2 a JOIN images i ON i.image_id = a.image_id WHERE NOT usable
), ranked AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next_score FROM tried WINDOW w AS (PARTITION BY image_id ORDER BY score DESC, pool_pos))
SELECT images.image_id, pool_pos AS winner, round(score, 4) AS score, round(score - next_score, 4) AS gap,
  array_to_string(list_filter([CASE WHEN pool = 1 THEN 'single_engine_only' END, CASE WHEN recovered THEN 'scene_largest_object' END, CASE WHEN score - next_score < 0.04 THEN 'tiebreak_deterministic' END,
    CASE WHEN pool_pos <> preferred THEN 'engine_fallback_used' END, CASE WHEN score < 0.45 THEN 'alpha_suspect' END], lambda n: n IS NOT NULL), ',') AS notes
FROM images LEFT JOIN ranked ON ranked.image_id = images.image_id AND k = 1"""


@query(_ISOLATED)
def autopick_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: measure, reject, score and rank the masks of every image, with recovery and notes; edges by border cells, which SQL can count."""
    return autopick.choose(grid(spark, sf_dir), SIDE, traced=False)


_ENGINES = "(VALUES ('photoroom', 0), ('removebg', 1), ('fal', 2), ('gemini', 3)) AS e(engine, priority)"


@query(f"""WITH j AS (SELECT c_custkey AS job, engine, priority, (c_custkey + priority * 7) % 5 = 0 AS available FROM customer, {_ENGINES}),
ranked AS (SELECT job, engine, row_number() OVER (PARTITION BY job ORDER BY priority) - 1 AS pos FROM j WHERE available)
SELECT job, engine, CAST(pos AS INTEGER) AS pos FROM ranked WHERE pos < 2
UNION ALL SELECT job, 'local', 0 FROM j GROUP BY job HAVING NOT bool_or(available)""")
def engine_pool_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = spark.createDataFrame([("photoroom", 0), ("removebg", 1), ("fal", 2), ("gemini", 3)], "engine string, priority int")
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job")).crossJoin(F.broadcast(engines))  # four rows, a constant
    return autopick.select_pool(jobs.withColumn("available", (F.col("job") + F.col("priority") * 7) % 5 == 0))


@query(f"""WITH {JOBS_SQL}, f AS (
  SELECT job, seq, CASE seq % 6 WHEN 0 THEN 'vendor_timeout' WHEN 1 THEN 'vendor_rate_limited' WHEN 2 THEN 'vendor_error' WHEN 3 THEN 'internal_error' WHEN 4 THEN 'vendor_unauthorized' ELSE 'vendor_out_of_credits' END AS code
  FROM ji WHERE state = 'failed')
SELECT job, code FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY CASE code WHEN 'vendor_out_of_credits' THEN 0 WHEN 'vendor_unauthorized' THEN 1 WHEN 'vendor_rate_limited' THEN 2 WHEN 'vendor_timeout' THEN 3 WHEN 'internal_error' THEN 5 ELSE 4 END, seq) AS k FROM f) WHERE k = 1""")
def failure_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most telling failure of every job with any."""
    codes = F.array(*map(F.lit, ("vendor_timeout", "vendor_rate_limited", "vendor_error", "internal_error", "vendor_unauthorized", "vendor_out_of_credits")))
    failed = job_images(spark, sf_dir).where(F.col("state") == "failed")
    return autopick.most_informative(failed.select("job", "seq", F.get(codes, (F.col("seq") % 6).cast("int")).alias("code")), "job")


@query(f"WITH {GRID_SQL} SELECT image_id, round(sum(a), 6) AS total, CAST(count(*) FILTER (a > 0.5) AS INTEGER) AS core FROM (SELECT image_id, i, max(a) AS a FROM m GROUP BY image_id, i) GROUP BY image_id")
def union_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of an image's masks: the cell-wise maximum, in the array layout."""
    both = grid(spark, sf_dir).groupBy("image_id").agg(F.collect_list("alpha").alias("masks"))
    united = both.select("image_id", F.aggregate(F.slice("masks", 2, F.greatest(F.size("masks") - 1, F.lit(0))), F.get("masks", F.lit(0)), lambda u, n: F.zip_with(u, n, lambda a, b: F.greatest(a, b))).alias("alpha"))
    total = F.aggregate("alpha", F.lit(0.0), lambda s, a: s + a)
    return united.select("image_id", F.round(total, 6).alias("total"), masks.count(F.col("alpha"), lambda a: a > masks.CORE).alias("core"))


@query(f"WITH {GRID_SQL} SELECT vec_id, round(avg(CASE WHEN a > 0.01 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN a > 0.01 THEN 1.0 ELSE 0.0 END) > 0.02 AS warn FROM m WHERE y < 1 OR y >= 7 GROUP BY vec_id")
def watermark_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the top and bottom eighth that is not clear, and whether that looks like a stamped logo."""
    a = F.col("alpha")
    band = F.concat(F.slice(a, 1, SIDE), F.slice(a, SIDE * (SIDE - 1) + 1, SIDE))
    share = masks.count(band, lambda v: v > 0.01) / F.size(band)
    return grid(spark, sf_dir).select("vec_id", F.round(share, 6).alias("share"), (share > 0.02).alias("warn"))


@query(f"""WITH {GRID_SQL}, w AS (SELECT vec_id, count(*) FILTER (a > 0.05) AS total, count(*) FILTER (a > 0.05 AND x + vec_id % 4 < 8 AND y + vec_id % 3 < 8) AS inside FROM m GROUP BY vec_id)
SELECT vec_id, CAST(total - inside AS INTEGER) AS lost, inside < total - 0.5 AS cover_cropped FROM w""")
def cover_cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a shifted frame cuts off part of the product."""
    a, v = F.col("alpha"), F.col("vec_id")
    at = masks.where_above(a, 0.05)
    inside = F.filter(at, lambda i: (i % SIDE + v % 4 < SIDE) & (F.floor(i / SIDE) + v % 3 < SIDE))
    return grid(spark, sf_dir).select("vec_id", (F.size(at) - F.size(inside)).alias("lost"), (F.size(inside) < F.size(at) - 0.5).alias("cover_cropped"))


@query(f"WITH {GRID_SQL} SELECT vec_id, y // 2 AS y, x // 2 AS x, round(avg(a), 6) AS a FROM m GROUP BY vec_id, y // 2, x // 2")
def area_halve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mask at half its size: means of 2x2 cells."""
    def cell(i):
        top = F.floor(i / (SIDE // 2)) * 2 * SIDE + i % (SIDE // 2) * 2
        return sum((F.get("alpha", (top + d).cast("int")) for d in (1, SIDE, SIDE + 1)), F.get("alpha", top.cast("int"))) / 4

    halved = grid(spark, sf_dir).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), cell)).alias("i", "a"))
    return halved.select("vec_id", F.floor(F.col("i") / 4).alias("y"), (F.col("i") % 4).cast("long").alias("x"), F.round("a", 6).alias("a"))


@query(f"""WITH {GRID_SQL}, b AS (SELECT vec_id, min(x) FILTER (a > 0.05) AS x0, min(y) FILTER (a > 0.05) AS y0, max(x) FILTER (a > 0.05) + 1 AS x1, max(y) FILTER (a > 0.05) + 1 AS y1 FROM m GROUP BY vec_id),
d AS (SELECT *, CAST(round_even(8 - (x0 + x1) / 2.0, 0) AS BIGINT) AS dx, CAST(round_even(8 - (y0 + y1) / 2.0, 0) AS BIGINT) AS dy FROM b WHERE x0 IS NOT NULL)
SELECT vec_id, m.y + dy AS y, m.x + dx AS x, round(a, 6) AS a FROM m JOIN d USING (vec_id) WHERE a > 0.05 AND m.x + dx BETWEEN 0 AND 15 AND m.y + dy BETWEEN 0 AND 15""")
def place_on_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mask at its own scale on a 16x16 canvas, its bounds centred; cells above the threshold."""
    b = grid(spark, sf_dir).withColumn("b", masks.bbox(F.col("alpha"), SIDE))
    shifted = b.where("b.x1 > b.x0").select("vec_id", F.bround(8 - (F.col("b.x0") + F.col("b.x1")) / 2, 0).cast("long").alias("dx"), F.bround(8 - (F.col("b.y0") + F.col("b.y1")) / 2, 0).cast("long").alias("dy"), F.posexplode("alpha").alias("i", "a"))
    moved = shifted.where("a > 0.05").select("vec_id", (F.floor(F.col("i") / SIDE) + F.col("dy")).alias("y"), (F.col("i") % SIDE + F.col("dx")).alias("x"), F.round("a", 6).alias("a"))
    return moved.where(F.col("x").between(0, 15) & F.col("y").between(0, 15))
