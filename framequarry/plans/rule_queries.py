"""Queries over configurations, results, keys, uploads and the pool's fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..operators import masks, rules
from .adapters import GRID_SQL, JOBS_SQL, SIDE, grid, job_images
from .registry import query, table

_CONFIG = """c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'single' ELSE 'auto' END AS strategy, CASE WHEN p_partkey % 3 > 0 THEN 'local' END AS engine, p_partkey % 5 = 0 AS transparent,
  CASE WHEN p_partkey % 7 > 0 THEN '#FFFFFF' END AS color, list_filter([CASE WHEN p_size % 2 = 0 THEN 'jpeg' END, CASE WHEN p_size % 3 = 0 THEN 'psd' END], lambda f: f IS NOT NULL) AS formats, p_size % 5 = 0 AS match_source, p_size % 4 = 0 AS psd FROM part)"""


@query(f"""WITH {_CONFIG} SELECT p_partkey, array_to_string(list_filter([CASE WHEN strategy = 'single' AND engine IS NULL THEN 'engine_required' END, CASE WHEN NOT transparent AND color IS NULL THEN 'color_required' END,
  CASE WHEN len(formats) = 0 AND NOT match_source THEN 'nothing_delivered' END, CASE WHEN transparent AND list_contains(formats, 'jpeg') THEN 'transparent_jpeg' END, CASE WHEN psd AND NOT list_contains(formats, 'psd') THEN 'psd_missing' END,
  CASE WHEN NOT psd AND list_contains(formats, 'psd') THEN 'psd_disabled' END], lambda v: v IS NOT NULL), ',') AS broken FROM c""")
def config_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule each configuration breaks."""
    k, s = F.col("p_partkey"), F.col("p_size")
    formats = F.array_compact(F.array(F.when(s % 2 == 0, "jpeg"), F.when(s % 3 == 0, "psd")))
    broken = rules.violations(F.when(k % 2 == 0, "single").otherwise("auto"), F.when(k % 3 > 0, "local"), k % 5 == 0, F.when(k % 7 > 0, "#FFFFFF"), formats, s % 5 == 0, s % 4 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(broken, ",").alias("broken"))


@query("SELECT p_partkey, COALESCE(NOT (p_partkey % 6 = 0) AND (CASE WHEN p_size < 45 THEN p_size / 100.0 END) <= 0.05 AND (CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 100) / 100.0 END) < 0.6, false) AS scene FROM part")
def scene_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which results look like a furnished room."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", rules.looks_like_a_scene(F.when(s < 45, s / 100), F.when(k % 4 > 0, k % 100 / 100), k % 6 == 0).alias("scene"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'photoroom: empty' END, CASE WHEN p_size % 3 = 0 THEN 'removebg: inverted' END], lambda v: v IS NOT NULL), '; ') AS detail FROM part")
def no_usable_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an image has no mask: each refused engine with its reason."""
    s = F.col("p_size")
    candidates = F.array(F.struct(F.lit("photoroom").alias("engine"), F.when(s % 2 == 0, "empty").alias("reason")), F.struct(F.lit("removebg").alias("engine"), F.when(s % 3 == 0, "inverted").alias("reason")))
    return table(spark, sf_dir, "part").select("p_partkey", rules.rejection_text(candidates).alias("detail"))


@query("""SELECT p_partkey, 'jobs/j' || p_partkey % 9 || '/out/' || CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.v2' ELSE '.hidden' END || '.' || CASE WHEN p_size % 2 = 0 THEN 'png' ELSE 'tiff' END AS key,
  CASE WHEN p_partkey % 3 = 0 THEN 'image/jpeg' WHEN p_partkey % 3 = 1 THEN 'image/png' ELSE 'application/octet-stream' END AS type FROM part""")
def output_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where outputs are stored and what type their source has."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit(".JPG"))).when(k % 3 == 1, F.concat("p_name", F.lit(".v2.png"))).otherwise(".hidden")
    key = rules.output_key(F.concat(F.lit("j"), (k % 9).cast("string")), name, F.when(F.col("p_size") % 2 == 0, "png").otherwise("tiff"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key"), rules.content_type(name).alias("type"))


@query("""WITH RECURSIVE u AS (SELECT o_custkey AS job, o_orderkey AS pos, o_orderkey % 9 + 1 AS images, CAST(floor(o_totalprice) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
r AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b, 0 AS taken, CAST(NULL AS VARCHAR) AS error FROM u
  UNION ALL SELECT u.job, u.pos, u.k, CASE WHEN r.n + images > 30 OR r.b + bytes > 900000 THEN r.n ELSE r.n + images END, CASE WHEN r.n + images > 30 OR r.b + bytes > 900000 THEN r.b ELSE r.b + bytes END,
    CASE WHEN r.n + images > 30 OR r.b + bytes > 900000 THEN r.taken ELSE r.taken + 1 END, CASE WHEN r.n + images > 30 THEN 'too_many_images' WHEN r.b + bytes > 900000 THEN 'too_many_bytes' END
  FROM r JOIN u ON u.job = r.job AND u.k = r.k + 1)
SELECT job, pos, error, CASE WHEN error IS NULL THEN CASE WHEN taken = 1 THEN 'source.zip' ELSE 'source-' || lpad(CAST(taken - 1 AS VARCHAR), 3, '0') || '.zip' END END AS key FROM r WHERE k > 0""")
def accept_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload batches a job takes or refuses under its caps, and where they are kept."""
    uploads = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 9 + 1).alias("images"), F.floor("o_totalprice").alias("bytes"))
    return rules.accepted(uploads, 30, 900000)


@query(f"""WITH RECURSIVE {JOBS_SQL}, c AS (SELECT job, seq, seq * 1.5 AS t, state = 'done' AS ok, row_number() OVER (PARTITION BY job ORDER BY seq) AS k FROM ji),
r AS (SELECT job, seq, k, t AS asked, ok AS trusted FROM c WHERE k = 1
  UNION ALL SELECT c.job, c.seq, c.k, CASE WHEN c.t - r.asked >= 5 THEN c.t ELSE r.asked END, CASE WHEN c.t - r.asked >= 5 THEN c.ok ELSE r.trusted END FROM r JOIN c ON c.job = r.job AND c.k = r.k + 1)
SELECT job, seq, trusted FROM r""")
def probe_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a probe trusted for five seconds from when it was made."""
    probes = job_images(spark, sf_dir).select("job", "seq", (F.col("seq") * 1.5).cast("double").alias("at"), (F.col("state") == "done").alias("ok"))
    return rules.trusted_probe(probes, "job").select("job", "seq", "trusted")


@query("""WITH e AS (SELECT * FROM (VALUES ('photoroom', 0.02), ('removebg', 0.20)) AS t(engine, price)), c AS (SELECT DISTINCT sha256(text) AS key, CASE WHEN doc_id % 2 = 0 THEN 'photoroom' ELSE 'removebg' END AS engine FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id AS image_id, e.engine, c.key IS NOT NULL AS cache_hit, CAST(CASE WHEN c.key IS NOT NULL THEN 0.0 ELSE price END AS DOUBLE) AS cost FROM documents d CROSS JOIN e LEFT JOIN c ON c.key = sha256(d.text) AND c.engine = e.engine""")
def pool_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with both engines of a pool: what the cache answers, and what has to be computed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.sha2("text", 256).alias("key"))
    engines = spark.createDataFrame([("photoroom", 0.02), ("removebg", 0.20)], "engine string, price double")
    cache = docs.where("image_id % 3 = 0").select("key", F.when(F.col("image_id") % 2 == 0, "photoroom").otherwise("removebg").alias("engine")).distinct()
    return rules.fan_out(docs, engines, cache)


@query(f"WITH {GRID_SQL} SELECT vec_id, round(sum(a), 6) AS total, CAST(count(*) FILTER (a > 0.5) AS INTEGER) AS core FROM m WHERE x + vec_id % 9 - 2 BETWEEN 0 AND 11 AND y + vec_id % 7 - 1 BETWEEN 0 AND 11 GROUP BY vec_id")
def roi_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of a region put back into their 12x12 frame, clipped."""
    v = F.col("vec_id")
    whole = grid(spark, sf_dir).select("vec_id", rules.pasted(F.col("alpha"), v % 9 - 2, v % 7 - 1, SIDE, 12).alias("alpha"))
    return whole.select("vec_id", F.round(F.aggregate("alpha", F.lit(0.0), lambda s, a: s + a), 6).alias("total"), masks.count(F.col("alpha"), lambda a: a > 0.5).alias("core"))


@query(f"""WITH {GRID_SQL}, s AS (SELECT image_id, vec_id, sum(a) AS area FROM m GROUP BY image_id, vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(area, 6) DESC, vec_id) AS k FROM s)
SELECT image_id, vec_id, CAST(k AS INTEGER) AS layer, round(area, 6) AS area FROM r""")
def layers_largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image's object layers, largest first: one array an image, ordered in place."""
    area = F.round(F.aggregate("alpha", F.lit(0.0), lambda s, a: s + a), 6)
    per = grid(spark, sf_dir).select("image_id", "vec_id", area.alias("area")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("low"), "vec_id"))).alias("l"))
    return per.select("image_id", F.posexplode("l").alias("k", "o")).select("image_id", "o.vec_id", (F.col("k") + 1).alias("layer"), (-F.col("o.low")).alias("area"))


@query("SELECT p_partkey, CAST(p_size * 37 AS BIGINT) AS width, p_partkey * 3 AS height FROM part")
def png_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height from the first 24 bytes of a PNG, in SQL."""

    def four(value):
        return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))

    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), four(F.col("p_size") * 37), four(F.col("p_partkey") * 3))
    bytes_ = table(spark, sf_dir, "part").select("p_partkey", head.alias("head"))
    return bytes_.select("p_partkey", *(F.conv(F.hex(F.substring("head", at, 4)), 16, 10).cast("long").alias(n) for n, at in (("width", 17), ("height", 21))))


_SAMPLES = "'s' || doc_id || ['.png', '.txt', '.JPG', '', '.cr2', '.gif'][doc_id % 6 + 1]"


@query(f"SELECT name, n_chars AS size FROM (SELECT {_SAMPLES} AS name, n_chars FROM documents) WHERE lower(regexp_extract(name, '[^.]*$')) IN ('png', 'jpg', 'cr2') AND contains(name, '.') ORDER BY name LIMIT 8")
def samples_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight readable samples by name (the report's own limit), with their sizes."""
    ends = F.array(*map(F.lit, (".png", ".txt", ".JPG", "", ".cr2", ".gif")))
    name = F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 6).cast("int")))
    named = table(spark, sf_dir, "documents").select(name.alias("name"), F.col("n_chars").alias("size"))
    return rules.samples(named)


@query("SELECT seq, cast(floor(seq / 7) AS BIGINT) AS job, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 3 = 0 THEN 'chair' ELSE 'lamp' END AS prompt FROM (SELECT event_id AS seq FROM events)")
def blank_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts trimmed; a blank one is no prompt."""
    k = F.col("event_id")
    text = F.when(k % 11 == 0, "   ").when(k % 3 == 0, " chair ").otherwise("lamp")
    return table(spark, sf_dir, "events").select(k.alias("seq"), F.floor(k / 7).alias("job"), rules.blank_to_null(text).alias("prompt"))


_CONFIG = """'{"background":{"color":' || CASE WHEN p_partkey % 7 > 0 THEN '"#FF' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '"' ELSE 'null' END || ',"shadow":"preserve","transparent":' || (p_partkey % 7 = 0) || '},"export":{"formats":[' || CASE WHEN p_size % 2 = 0 THEN '"png","psd"' ELSE '"tiff"' END
  || '],"quality":92},"objects":[{"label":"' || p_brand || '","order":' || p_size || '}],"size":{"height":' || p_size * 20 || ',"margin_pct":10.5,"width":' || p_size * 10 || '}}'"""


@query(f"SELECT p_partkey, substr(sha256({_CONFIG}), 1, 16) AS config_hash FROM part")
def config_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of whole configurations, whose fields come in any order and whose preset's name does not count."""
    p, size = F.col("p_partkey"), F.col("p_size")
    config = F.struct(
        F.col("p_name").alias("preset_name"),
        F.struct((size * 10).alias("width"), (size * 20).alias("height"), F.lit(10.5).alias("margin_pct")).alias("size"),
        F.struct((p % 7 == 0).alias("transparent"), F.when(p % 7 > 0, F.concat(F.lit("#FF"), F.lpad(size.cast("string"), 4, "0"))).alias("color"), F.lit("preserve").alias("shadow")).alias("background"),
        F.array(F.struct(size.alias("order"), F.col("p_brand").alias("label"))).alias("objects"),
        F.struct(F.lit(92).alias("quality"), F.when(size % 2 == 0, F.array(F.lit("png"), F.lit("psd"))).otherwise(F.array(F.lit("tiff"))).alias("formats")).alias("export"),
    )
    return rules.with_config_hash(table(spark, sf_dir, "part").select("p_partkey", config.alias("config"))).select("p_partkey", "config_hash")
