"""Queries over archives, names, jobs, caching, budgets and vendor replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, web
from ..operators import jobs
from .adapters import ENTRIES_SQL, JOBS_SQL, entries, job_images
from .registry import query, table

_PATHS = """p AS (SELECT *, CASE page_id % 9 WHEN 0 THEN '../' || path WHEN 1 THEN '/' || path WHEN 2 THEN 'C:' || path WHEN 3 THEN '__MACOSX/' || path WHEN 4 THEN path || '/' WHEN 5 THEN 'a\\' || path || '.PNG' WHEN 6 THEN '._' || path WHEN 7 THEN CASE page_id % 4 WHEN 0 THEN 'a/__MACOSX/' || path WHEN 1 THEN 'a/._d/' || path WHEN 2 THEN 'b/Thumbs.db' ELSE 'THUMBS.DB' END ELSE path || '.jpeg' END AS name FROM en)"""


def _deep(path: Column) -> Column:
    """Litter below the top, and a name that differs from litter in case only."""
    turn = F.col("page_id") % 4
    return F.when(turn == 0, F.concat(F.lit("a/__MACOSX/"), path)).when(turn == 1, F.concat(F.lit("a/._d/"), path)).when(turn == 2, F.lit("b/Thumbs.db")).otherwise(F.lit("THUMBS.DB"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, path = F.col("page_id") % 9, F.col("path")
    name = F.when(k == 0, F.concat(F.lit("../"), path)).when(k == 1, F.concat(F.lit("/"), path)).when(k == 2, F.concat(F.lit("C:"), path)).when(k == 3, F.concat(F.lit("__MACOSX/"), path)).when(k == 4, F.concat(path, F.lit("/"))).when(k == 5, F.concat(F.lit("a\\"), path, F.lit(".PNG"))).when(k == 6, F.concat(F.lit("._"), path)).when(k == 7, _deep(path)).otherwise(F.concat(path, F.lit(".jpeg")))
    return entries(spark, sf_dir).withColumn("name", name)


@query(f"""WITH {ENTRIES_SQL}, {_PATHS}, s AS (SELECT *, replace(name, '\\', '/') AS sl FROM p)
SELECT page_id, ends_with(name, '/') OR regexp_matches(name, '(^|/)(__MACOSX/|[.]_)') OR regexp_extract(rtrim(sl, '/'), '[^/]*$') IN ('.DS_Store', 'Thumbs.db', 'desktop.ini') AS junk,
  CASE WHEN name = '' OR starts_with(sl, '/') OR sl[2:2] = ':' OR list_contains(string_split(sl, '/'), '..') THEN 'malicious_archive' WHEN file_size > 4000 THEN 'file_too_large' WHEN compress_size > 0 AND file_size * 1.0 / compress_size > 200 THEN 'malicious_archive' END AS code FROM s""")
def entry_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entries are litter, and the first reason to refuse the others."""
    e = _named(spark, sf_dir)
    return e.select("page_id", formats.is_junk(F.col("name")).alias("junk"), formats.screen(F.col("name"), F.col("file_size"), F.col("compress_size"), 4000).alias("code"))


_HEADS = {0: ("FFD8FFE0", "image/jpeg"), 1: ("89504E470D0A1A0A", "image/png"), 2: ("474946383961", "image/gif"), 3: ("49492A00", "image/tiff"), 4: ("4D4D002A", "image/tiff"), 5: ("524946460000000057454250", "image/webp"), 6: ("424D", "image/bmp"), 7: ("38425053", "image/vnd.adobe.photoshop"), 8: ("0A203C3F786D6C20", "image/svg+xml"), 9: ("00", "application/octet-stream")}


@query("SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '{m}'" for k, (_, m) in _HEADS.items()) + " END AS mime FROM pages")
def entry_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by first bytes: each page's bytes behind a known head."""
    heads = F.array(*(F.lit(h) for h, _ in _HEADS.values()))
    payload = F.concat(F.unhex(F.get(heads, (F.col("page_id") % 10).cast("int"))), F.encode(F.lit("~"), "UTF-8"), F.col("payload"))
    return entries(spark, sf_dir).select("page_id", formats.sniff(payload).alias("mime"))


@query(f"""WITH {ENTRIES_SQL}, {_PATHS}, b AS (SELECT page_id, regexp_extract(rtrim(replace(name, '\\', '/'), '/'), '[^/]*$') AS base FROM p)
SELECT page_id, CASE WHEN base = '' THEN 'unnamed' ELSE base END AS basename, CASE WHEN contains(base, '.') AND regexp_extract(base, '[^.]*$') <> '' THEN lower(trim(regexp_extract(base, '[^.]*$'))) END AS ext FROM b""")
def entry_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named(spark, sf_dir).select("page_id", formats.basename(F.col("name")).alias("basename"))
    return named.select("page_id", "basename", formats.extension(F.col("basename")).alias("ext"))


@query(f"WITH {ENTRIES_SQL} SELECT archive_id, count(*) AS entries, CAST(sum(file_size) AS BIGINT) AS declared, count(*) > 36 AS too_many, sum(file_size) > 120000 AS too_large FROM en GROUP BY archive_id")
def archive_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry count and declared total of each archive against their caps."""
    n, total = F.count(F.lit(1)), F.sum("file_size")
    return entries(spark, sf_dir).groupBy("archive_id").agg(n.alias("entries"), total.alias("declared"), (n > 36).alias("too_many"), (total > 120000).alias("too_large"))


@query(f"WITH {ENTRIES_SQL}, r AS (SELECT *, sum(file_size) OVER (PARTITION BY archive_id ORDER BY path, page_id ROWS UNBOUNDED PRECEDING) AS running FROM en) SELECT archive_id, page_id, CAST(running AS BIGINT) AS running, running > 100000 AS over FROM r")
def running_bytes_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes read so far in path order within each archive, and where the cap is passed."""
    w = Window.partitionBy("archive_id").orderBy("path", "page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries(spark, sf_dir).select("archive_id", "page_id", F.sum("file_size").over(w).alias("running")).withColumn("over", F.col("running") > 100000)


_DIM = "(VALUES " + ", ".join(f"('{e}', '{s}', {str(s in formats.RAW).lower()}, '{formats.RAW_SUBSTITUTE if s in formats.RAW else s}', {str(s in formats.RENDERABLE).lower()}, {str(s not in formats.NO_ALPHA and s not in formats.RAW).lower()})" for e, s in formats.EXTENSIONS.items()) + ") AS d(ext, source, is_raw, output, renderable, carries_alpha)"
_EXTS = [*formats.EXTENSIONS, "gif", "txt"]


@query(f"""WITH x AS (SELECT p_partkey, [{', '.join(f"'{e}'" for e in _EXTS)}][p_partkey % {len(_EXTS)} + 1] AS ext, p_partkey % 2 = 0 AS transparent FROM part)
SELECT p_partkey, source, is_raw, list_sort(list_distinct(list_filter(['png', CASE WHEN transparent AND source IN ('jpeg', 'bmp', 'eps') THEN 'png' ELSE output END], lambda f: f IS NOT NULL))) AS formats FROM x LEFT JOIN {_DIM} USING (ext)""")
def format_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source format by extension, and what is delivered: png and the source's own format or its substitute."""
    names = F.array(*map(F.lit, _EXTS))
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(_EXTS)).cast("int")).alias("ext"), (F.col("p_partkey") % 2 == 0).alias("transparent"))
    joined = p.join(F.broadcast(formats.dim_format(spark)), "ext", "left")  # fifteen rows
    own = F.when(F.col("transparent") & F.col("source").isin(*formats.NO_ALPHA), formats.ALPHA_SUBSTITUTE).otherwise(F.col("output"))
    wanted = F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit("png"), own))))
    return joined.select("p_partkey", "source", "is_raw", wanted.alias("formats"))


@query("SELECT p_partkey, CASE WHEN NOT list_has_any(f, ['png', 'jpeg', 'webp', 'bmp']) THEN 'png' END AS preview FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['tiff'] WHEN 1 THEN ['tiff', 'psd'] WHEN 2 THEN ['psd', 'jpeg'] ELSE ['eps'] END AS f FROM part)")
def preview_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    sets = F.when(k == 0, F.array(F.lit("tiff"))).when(k == 1, F.array(F.lit("tiff"), F.lit("psd"))).when(k == 2, F.array(F.lit("psd"), F.lit("jpeg"))).otherwise(F.array(F.lit("eps")))
    return table(spark, sf_dir, "part").select("p_partkey", formats.preview_format(sets).alias("preview"))


@query("SELECT doc_id, sha256(text) || ':' || CASE doc_id % 2 WHEN 0 THEN 'photoroom' ELSE 'removebg' END || CASE WHEN doc_id % 5 = 0 THEN ':1,2,3,' || (doc_id % 9 + 4) ELSE '' END AS key FROM documents")
def content_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    engine = F.when(k % 2 == 0, "photoroom").otherwise("removebg")
    roi = F.when(k % 5 == 0, F.concat(F.lit("1,2,3,"), (k % 9 + 4).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", jobs.cache_key(F.col("text"), engine, roi).alias("key"))


@query("SELECT sha256(text) AS key, doc_id AS seq, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS cache_hit, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 0.0 ELSE 0.02 END AS cost FROM documents")
def single_flight_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), F.col("doc_id").alias("seq"), F.lit(0.02).alias("price"))
    return jobs.single_flight(calls)


@query("SELECT source, count(*) AS calls, count(DISTINCT text) AS computed, round(1 - count(DISTINCT text) * 1.0 / count(*), 6) AS hit_rate FROM documents GROUP BY source")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of calls a cache answers, by source; keys are hashes, so no text is shuffled."""
    keyed = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("key"))
    per_key = keyed.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("source").agg(F.sum("n").alias("calls"), F.count(F.lit(1)).alias("computed")).withColumn("hit_rate", F.round(1 - F.col("computed") / F.col("calls"), 6))


@query(f"""WITH {JOBS_SQL}, c AS (SELECT job, count(*) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped, round(sum(cost), 4) AS cost FROM ji GROUP BY job)
SELECT *, CASE WHEN done > 0 THEN 'completed' WHEN skipped > 0 THEN 'cancelled' ELSE 'failed' END AS state, round_even(100.0 * (done + failed) / total, 1) AS progress_pct FROM c""")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rollup(job_images(spark, sf_dir))


@query(f"""WITH {JOBS_SQL}, s AS (SELECT *, COALESCE(sum(cost) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM ji) SELECT job, seq, round(spent, 6) + 0.05 > 2.0 AS stopped FROM s""")
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images a budget of 2 would keep from starting, one at a time."""
    return jobs.stopped_at(job_images(spark, sf_dir), 2.0, 0.05).select("job", "seq", "stopped")


@query(f"""WITH {JOBS_SQL}, planned AS (SELECT DISTINCT job, 'img-' || seq % 97 || '.png' AS name FROM ji), rec AS (SELECT DISTINCT job, 'img-' || seq % 97 || '.png' AS name FROM ji WHERE state = 'done')
SELECT job, name, 'skipped' AS state, 'budget' AS reason FROM planned p WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.job = p.job AND r.name = p.name)""")
def unprocessed_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = job_images(spark, sf_dir).select("job", "state", F.concat(F.lit("img-"), (F.col("seq") % 97).cast("string"), F.lit(".png")).alias("name"))
    return jobs.unprocessed(named.select("job", "name").distinct(), named.where("state = 'done'"), "budget")


@query("""WITH j AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['photoroom', 'removebg'] WHEN 1 THEN ['gemini', 'local'] ELSE ['fal'] END AS e, c_custkey % 400 AS n FROM customer),
p AS (SELECT c_custkey, n, round(list_sum(list_transform(e, lambda x: CASE x WHEN 'photoroom' THEN 0.02 WHEN 'removebg' THEN 0.20 WHEN 'fal' THEN 0.04 WHEN 'gemini' THEN 0.0065 ELSE 0.0 END)), 6) AS per_image FROM j)
SELECT c_custkey, CAST(per_image AS DOUBLE) AS per_image, CAST(round(per_image * n, 4) AS DOUBLE) AS estimate, round(per_image * n, 4) >= 10 AS over FROM p""")
def estimate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    engines = F.when(k % 3 == 0, F.array(F.lit("photoroom"), F.lit("removebg"))).when(k % 3 == 1, F.array(F.lit("gemini"), F.lit("local"))).otherwise(F.array(F.lit("fal")))
    return jobs.estimate(table(spark, sf_dir, "customer").select("c_custkey"), engines, k % 400, F.lit(10.0)).select("c_custkey", "per_image", "estimate", "over")


@query("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def image_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a job's records in order, with the total."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    return jobs.page(orders, ["o_orderdate", "o_orderkey"], 100, 50).crossJoin(F.broadcast(total)).select("o_orderkey", "o_custkey", "total")  # one row


@query("""WITH RECURSIVE f AS (SELECT source AS owner, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT owner, doc_id AS pos, k, size AS bytes, 1 AS n, 0 AS batch FROM f WHERE k = 1
  UNION ALL SELECT f.owner, f.doc_id, f.k, CASE WHEN r.bytes + f.size > 20000 OR r.n >= 50 THEN f.size ELSE r.bytes + f.size END, CASE WHEN r.bytes + f.size > 20000 OR r.n >= 50 THEN 1 ELSE r.n + 1 END, CASE WHEN r.bytes + f.size > 20000 OR r.n >= 50 THEN r.batch + 1 ELSE r.batch END
  FROM r JOIN f ON f.owner = r.owner AND f.k = r.k + 1)
SELECT owner, pos, batch FROM r""")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload batches of each source's documents, packed in order."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"))
    return jobs.batches(files, 20000, 50)


@query(f"WITH {ENTRIES_SQL} SELECT archive_id, page_id, CAST(COALESCE(sum(30 + octet_length(encode(path)) + file_size) OVER (PARTITION BY archive_id ORDER BY path, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM en")
def zip_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each stored entry's header begins in its bundle."""
    w = Window.partitionBy("archive_id").orderBy("path", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    size = 30 + F.octet_length("path") + F.col("file_size")
    return entries(spark, sf_dir).select("archive_id", "page_id", F.coalesce(F.sum(size).over(w), F.lit(0)).alias("at"))


@query("""SELECT o_custkey, CASE WHEN count(*) = 1 THEN 'AI_' || trim(regexp_replace(regexp_replace(min('order: ' || o_orderkey || ' "#x?".v1.png'), '\\.[^.]*$', ''), '["\\\\/:*?<>|]', '', 'g')) || '.zip' ELSE 'AI_' || count(*) || '-files_' || strftime(min(o_orderdate), '%Y-%m-%d_%H%M') || '.zip' END AS bundle FROM orders GROUP BY o_custkey""")
def bundle_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat(F.lit("order: "), F.col("o_orderkey").cast("string"), F.lit(' "#x?".v1.png'))).alias("one"), F.min("o_orderdate").alias("at"))
    many = F.concat(F.lit("AI_"), F.col("n").cast("string"), F.lit("-files_"), F.date_format("at", "yyyy-MM-dd_HHmm"), F.lit(".zip"))
    return per.select("o_custkey", F.when(F.col("n") == 1, F.concat(F.lit("AI_"), web.safe_stem(F.col("one")), F.lit(".zip"))).otherwise(many).alias("bundle"))


@query("""SELECT doc_id, 'attachment; filename="' || regexp_replace(regexp_replace(n, '[\\x00-\\x1F\\x7F"\\\\]', '_', 'g'), '[^\\x00-\\x7F]', '?', 'g') || '"; filename*=UTF-8''''' || replace(url_encode(n), '%2F', '/') AS header FROM (SELECT doc_id, left(text, 24) || '.zip' AS n FROM documents)""")
def content_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download headers of names in four languages, whatever signs they hold."""
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring("text", 1, 24), F.lit(".zip")).alias("n"))
    return named.select("doc_id", web.content_disposition(F.col("n")).alias("header"))


@query(f"WITH {JOBS_SQL} SELECT seq, attempt, CASE WHEN seq % 2 = 0 AND retry_after IS NOT NULL THEN least(retry_after, 30.0) ELSE 0.5 * pow(2, attempt) END AS delay FROM ji, (SELECT unnest(range(0, 3)) AS attempt)")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("seq") % 2 == 0, F.col("retry_after"))
    each = job_images(spark, sf_dir).select("seq", asked.alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
    return each.select("seq", F.col("attempt").cast("long").alias("attempt"), web.retry_delay(F.col("attempt"), F.col("asked")).alias("delay"))


_HEADERS = {0: "30", 1: "-1", 2: "Wed, 21 Oct 2015 07:28:00 GMT", 3: "soon", 4: None, 5: "2.5"}


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 30.0 WHEN 1 THEN 0.0 WHEN 2 THEN greatest(0.0, 1445412480.0 - (1445412400 + event_id % 200)) WHEN 5 THEN 2.5 END AS wait FROM events")
def retry_after_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits from a number, a negative number, an HTTP date, nonsense and nothing."""
    header = F.get(F.array(*(F.lit(h) for h in _HEADERS.values())), (F.col("event_id") % 6).cast("int"))
    now = (F.lit(1445412400) + F.col("event_id") % 200).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", web.retry_after_seconds(header, now).alias("wait"))


@query("""SELECT event_id, CASE s WHEN 200 THEN NULL WHEN 429 THEN 'vendor_rate_limited' WHEN 402 THEN 'vendor_out_of_credits' WHEN 401 THEN 'vendor_unauthorized' WHEN 403 THEN 'vendor_unauthorized' WHEN 413 THEN 'vendor_payload_too_large' WHEN 400 THEN CASE WHEN event_id % 3 = 0 THEN 'no_foreground_found' ELSE 'vendor_error' END WHEN 418 THEN CASE WHEN event_id % 3 = 0 THEN 'no_foreground_found' ELSE 'vendor_error' END ELSE 'vendor_error' END AS error
FROM (SELECT event_id, [200, 429, 402, 401, 403, 413, 500, 503, 400, 418][event_id % 10 + 1] AS s FROM events)""")
def http_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, (200, 429, 402, 401, 403, 413, 500, 503, 400, 418))), (F.col("event_id") % 10).cast("int"))
    body = F.when(F.col("event_id") % 3 == 0, '{"errors": [{"code": "unknown_foreground"}]}').when(F.col("event_id") % 3 == 1, '{"errors": []}').otherwise("not json")
    return table(spark, sf_dir, "events").select("event_id", web.classify(status, web.error_code(body)).alias("error"))


@query("SELECT event_id, least(5000.0, 1200 * pow(1.25, event_id % 12)) AS wait_ms FROM events")
def poll_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", web.poll_interval_ms(F.col("event_id") % 12).alias("wait_ms"))


@query(f"""WITH RECURSIVE {JOBS_SQL}, c AS (SELECT job, seq, state = 'failed' AS limited, row_number() OVER (PARTITION BY job ORDER BY seq) AS k FROM ji),
r AS (SELECT job, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, 8 AS lim, 0 AS good FROM (SELECT DISTINCT job FROM c)
  UNION ALL SELECT c.job, c.seq, c.k, CASE WHEN limited THEN greatest(1, lim // 2) WHEN good + 1 >= 12 THEN least(8, lim + 1) ELSE lim END, CASE WHEN limited OR good + 1 >= 12 THEN 0 ELSE good + 1 END FROM r JOIN c ON c.job = r.job AND c.k = r.k + 1)
SELECT job AS vendor, seq, lim AS allowed FROM r WHERE k > 0""")
def aimd_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls at once a vendor is allowed after each outcome."""
    return jobs.governor(job_images(spark, sf_dir).select(F.col("job").alias("vendor"), "seq", (F.col("state") == "failed").alias("limited")))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) WHEN 3 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of good JSON, cut-off JSON, no JSON, and JSON within a JSON string; null on any mismatch."""
    good, turn = F.col("props"), F.col("event_id") % 4
    quoted = F.to_json(F.struct(good.alias("text")))
    body = F.when(turn == 0, good).when(turn == 1, F.expr("substring(props, 1, 4)")).when(turn == 2, "plain words").otherwise(quoted)
    inner = F.coalesce(F.get_json_object(body, "$.text"), body)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(inner, "$.k").try_cast("bigint").alias("k"))


@query("""SELECT p_partkey, substr(sha256('{"background":"' || p_brand || '","margin":' || p_size || ',"size":[' || p_size * 10 || ',' || p_size * 20 || ']}'), 1, 16) AS hash FROM part""")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sixteen digits of sha256 over a configuration's canonical JSON: sorted keys, no blanks."""
    spec = F.to_json(F.struct(F.col("p_brand").alias("background"), F.col("p_size").alias("margin"), F.array(F.col("p_size") * 10, F.col("p_size") * 20).alias("size")))
    return table(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha2(spec, 256), 1, 16).alias("hash"))


@query("SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '-' || k END AS label FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def label_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated labels get -2, -3, ... in order."""
    k = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").withColumn("k", k).select("p_partkey", F.when(F.col("k") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("-"), F.col("k").cast("string"))).alias("label"))


@query("SELECT p_partkey, CASE WHEN k = 0 THEN n WHEN p_partkey % 3 = 0 THEN n || '-' || k ELSE p_name || '-' || k || '.png' END AS unique_name FROM (SELECT p_partkey, p_name, n, row_number() OVER (PARTITION BY n ORDER BY p_partkey) - 1 AS k FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || '.png' END AS n FROM part))")
def name_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated file names get a number before the extension."""
    named = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(".png"))).alias("n"))
    return jobs.numbered_names(named, [], "p_partkey", "n").select("p_partkey", "unique_name")


@query("WITH p AS (SELECT p_partkey, p_retailprice / 20 AS mp, p_size % 8 + 1 AS c FROM part) SELECT p_partkey, round(mp * 88.0 * c, 3) AS peak_mb, mp * 88.0 * c <= 16384 - 2048 AS fits, CAST(greatest(1, floor((16384 - 2048) / (mp * 88.0))) AS INTEGER) AS suggested FROM p")
def memory_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether runs of given size and concurrency fit 16 GB."""
    s = jobs.memory_admission(F.col("p_retailprice") / 20, F.col("p_size") % 8 + 1, F.lit(16384))
    return table(spark, sf_dir, "part").withColumn("s", s).select("p_partkey", "s.peak_mb", "s.fits", "s.suggested")


@query(f"WITH {JOBS_SQL}, n AS (SELECT job, seq, (row_number() OVER (PARTITION BY job ORDER BY seq) - 1) // 10 AS flush FROM ji) SELECT job, flush, count(*) AS changes, max(seq) AS last FROM n GROUP BY job, flush")
def progress_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of a job's progress: one for every ten changes."""
    nth = F.row_number().over(Window.partitionBy("job").orderBy("seq"))
    flush = F.floor((nth - 1) / jobs.COALESCE_EVERY)
    return job_images(spark, sf_dir).select("job", "seq", flush.alias("flush")).groupBy("job", "flush").agg(F.count(F.lit(1)).alias("changes"), F.max("seq").alias("last"))


@query(f"WITH {JOBS_SQL}, v AS (SELECT seq // 2 AS pair, max(CASE WHEN seq % 2 = 0 THEN cost > 0.2 END) AS fwd, max(CASE WHEN seq % 2 = 1 THEN cost > 0.2 END) AS rev FROM ji GROUP BY seq // 2) SELECT pair, CASE WHEN fwd IS NOT NULL AND rev IS NOT NULL AND fwd <> rev THEN CASE WHEN fwd THEN 'first' ELSE 'second' END END AS verdict FROM v")
def tiebreak_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judgements of a pair, the second with sides swapped: accepted only if they name the same mask."""
    v = job_images(spark, sf_dir).select(F.floor(F.col("seq") / 2).alias("pair"), (F.col("seq") % 2).alias("side"), (F.col("cost") > 0.2).alias("says_first"))
    both = v.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("says_first"))).alias("fwd"), F.max(F.when(F.col("side") == 1, F.col("says_first"))).alias("rev"))
    return both.select("pair", F.when(F.col("fwd") != F.col("rev"), F.when(F.col("fwd"), "first").otherwise("second")).alias("verdict"))
