"""Views of the test tables as the library's abstractions: masks, pictures, archive entries, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

SIDE = 8


def spread(rows: DataFrame) -> DataFrame:
    """Descriptors of pictures dealt out before pictures are made of them: a small file is one split, and a picture is much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8x8 mask in one row: vec_id, image_id, pool_pos, alpha (row-major array of double)."""

    def alpha(v: Column, i: Column) -> Column:
        y, x = F.floor(i / SIDE), i % SIDE
        edge = F.greatest(F.abs(y - 3.5), F.abs(x - 3.5))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.2 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.25 + 4 * v.cast("double"))) * (1 - edge / 5)))

    return table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 2).alias("image_id"), (F.col("vec_id") % 2).cast("int").alias("pool_pos"), F.transform("embedding", alpha).alias("alpha"))


#: The same masks in SQL, one row a cell: m(vec_id, image_id, pool_pos, i, y, x, a).
GRID_SQL = """g AS (
  SELECT vec_id, i - 1 AS i, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)
), m AS (
  SELECT vec_id, vec_id // 2 AS image_id, CAST(vec_id % 2 AS INTEGER) AS pool_pos, i, y, x,
    greatest(0.0, least(1.0, 2.2 * least(1.0, greatest(0.0, 0.25 + 4 * v)) * (1 - greatest(abs(y - 3.5), abs(x - 3.5)) / 5))) AS a
  FROM g
)"""


def picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors in a row as one 8x8 picture: img, rgb (array of r, g, b structs in linear light), alpha of the first."""
    parts = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("img"), (F.col("vec_id") % 3).alias("k"), F.transform("embedding", lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.cast("double") + 0.5))).alias("c"))
    one = parts.groupBy("img").agg(*(F.first(F.when(F.col("k") == k, F.col("c")), ignorenulls=True).alias(n) for k, n in enumerate("rgb")))
    return one.where("r is not null and g is not null and b is not null").select("img", F.arrays_zip("r", "g", "b").alias("rgb"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures' pixels: img, i, y, x, r, g, b and a soft disc a as alpha."""
    flat = picture(spark, sf_dir).select("img", F.posexplode("rgb").alias("i", "p")).select("img", F.col("i"), F.floor(F.col("i") / SIDE).alias("y"), (F.col("i") % SIDE).alias("x"), "p.r", "p.g", "p.b")
    return flat.withColumn("a", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (14.0 - ((F.col("x") - 3.5) * (F.col("x") - 3.5) + (F.col("y") - 3.5) * (F.col("y") - 3.5))) / 8.0)))


PIXELS_SQL = """e AS (
  SELECT vec_id // 3 AS img, vec_id % 3 AS k, i - 1 AS i, least(1.0, greatest(0.0, CAST(embedding[i] AS DOUBLE) + 0.5)) AS c
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)
), px AS (
  SELECT img, i, i // 8 AS y, i % 8 AS x, max(c) FILTER (k = 0) AS r, max(c) FILTER (k = 1) AS g, max(c) FILTER (k = 2) AS b,
    least(1.0, greatest(0.0, (14.0 - ((i % 8 - 3.5) * (i % 8 - 3.5) + (i // 8 - 3.5) * (i // 8 - 3.5))) / 8.0)) AS a
  FROM e GROUP BY img, i HAVING count(*) = 3
)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archive entries: archive_id, path, file_size, compress_size, payload."""
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return pages.select((F.col("page_id") % 7).alias("archive_id"), "page_id", path.alias("path"), F.octet_length("html").cast("long").alias("file_size"), (F.floor(F.octet_length("html") / (1 + F.col("page_id") % 300))).alias("compress_size"), F.encode("html", "UTF-8").alias("payload"))


ENTRIES_SQL = """en AS (
  SELECT page_id % 7 AS archive_id, page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path, CAST(octet_length(encode(html)) AS BIGINT) AS file_size,
    CAST(floor(octet_length(encode(html)) / (1 + page_id % 300)) AS BIGINT) AS compress_size, html
  FROM pages
)"""


def job_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as images of a job: job, seq, ts, cost, state, retry_after."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("done")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", F.round(F.col("value") / 1000, 6).alias("cost"), state.alias("state"), "event_type", F.get_json_object("props", "$.k").cast("double").alias("retry_after"))


JOBS_SQL = """ji AS (
  SELECT user_id AS job, event_id AS seq, ts, round(value / 1000, 6) AS cost, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'done' END AS state,
    event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS retry_after
  FROM events
)"""
