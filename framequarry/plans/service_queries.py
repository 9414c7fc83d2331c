"""Queries over job control, vendor replies, records, names and file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, web
from ..operators import flow, jobs, masks, rules
from .adapters import ENTRIES_SQL, GRID_SQL, JOBS_SQL, PIXELS_SQL, SIDE, entries, grid, job_images, pixels
from .registry import query, table

_CALLS = "c AS (SELECT job, seq, seq * 0.5 AS t, state = 'failed' AS limited, CASE WHEN seq % 3 > 0 THEN retry_after END AS wait, row_number() OVER (PARTITION BY job ORDER BY seq) AS k FROM ji)"
_GOVERNED = f"""{_CALLS}, r AS (SELECT job, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, 8 AS lim, 0 AS good, CAST(NULL AS DOUBLE) AS resume_at, 0 AS events FROM (SELECT DISTINCT job FROM c)
  UNION ALL SELECT c.job, c.seq, c.k, CASE WHEN limited THEN greatest(1, lim // 2) WHEN lim < 8 AND good + 1 >= 12 THEN lim + 1 ELSE lim END, CASE WHEN limited OR lim >= 8 OR good + 1 >= 12 THEN 0 ELSE good + 1 END,
    CASE WHEN limited THEN greatest(COALESCE(resume_at, 0), c.t + greatest(0.0, least(COALESCE(wait, 5.0), 120.0))) ELSE resume_at END, events + CAST(limited AS INTEGER) FROM r JOIN c ON c.job = r.job AND c.k = r.k + 1)"""


def _governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = job_images(spark, sf_dir).select(F.col("job").alias("vendor"), "seq", (F.col("seq") * 0.5).cast("double").alias("at"), (F.col("state") == "failed").alias("limited"), F.when(F.col("seq") % 3 > 0, F.col("retry_after")).alias("retry_after"))
    return jobs.governed_calls(calls)


@query(f"WITH RECURSIVE {JOBS_SQL}, {_GOVERNED} SELECT job AS vendor, seq, lim AS allowed, CAST(resume_at AS DOUBLE) AS resume_at, events FROM r WHERE k > 0")
def aimd_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The governor with its pauses: limit, when calls may start again, and refusals so far."""
    return _governed(spark, sf_dir)


@query(f"WITH RECURSIVE {JOBS_SQL}, {_GOVERNED} SELECT job AS vendor, max(events) AS events, arg_max(lim, seq) AS allowed FROM r WHERE k > 0 GROUP BY job")
def rate_limit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rate_limit_report(_governed(spark, sf_dir))


@query(f"""WITH {JOBS_SQL}, im AS (SELECT job, seq, seq * 1.0 AS started, seq + 40 + seq % 60 * 1.0 AS finished, cost FROM ji),
c AS (SELECT i.job, i.seq, i.started, round(round(COALESCE((SELECT sum(o.cost) FROM im o WHERE o.job = i.job AND o.finished <= i.started), 0), 6) + ((SELECT count(*) FROM im o WHERE o.job = i.job AND o.started < i.started AND o.finished > i.started) + 1) * 0.3, 6) AS committed FROM im i)
SELECT job, seq, CAST(committed AS DOUBLE) AS committed, bool_or(committed > 1.5) OVER (PARTITION BY job ORDER BY started ROWS UNBOUNDED PRECEDING) AS stopped FROM c""")
def budget_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ceiling of 1.5 that binds on what is spent, what is running and the next image."""
    images = job_images(spark, sf_dir).select("job", "seq", F.col("seq").cast("double").alias("started"), (F.col("seq") + 40 + F.col("seq") % 60).cast("double").alias("finished"), "cost")
    return jobs.budget_with_reservations(images, 1.5, 0.3)


@query(f"""WITH {JOBS_SQL}, s AS (SELECT job, min(seq) AS requested FROM ji WHERE state = 'failed' AND job % 3 = 0 GROUP BY job) SELECT ji.job, seq, COALESCE(seq >= requested, false) AS cancelled FROM ji LEFT JOIN s ON s.job = ji.job""")
def cancel_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that begin after their job was asked to stop; requests are rows of their own table."""
    images = job_images(spark, sf_dir)
    control = images.where("state = 'failed' and job % 3 = 0").select("job", F.col("seq").alias("requested_at"))
    return jobs.cancelled(images.select("job", "seq", F.col("seq").alias("started")), control).select("job", "seq", "cancelled")


@query(f"""WITH RECURSIVE {JOBS_SQL}, c AS (SELECT job, seq, seq / 64.0 AS t, row_number() OVER (PARTITION BY job ORDER BY seq) AS k FROM ji),
r AS (SELECT job, seq, k, 0 AS pending, t AS last, true AS flushed FROM c WHERE k = 1
  UNION ALL SELECT c.job, c.seq, c.k, CASE WHEN pending + 1 >= 10 OR c.t - last >= 2 THEN 0 ELSE pending + 1 END, CASE WHEN pending + 1 >= 10 OR c.t - last >= 2 THEN c.t ELSE last END, pending + 1 >= 10 OR c.t - last >= 2 FROM r JOIN c ON c.job = r.job AND c.k = r.k + 1)
SELECT job, seq, flushed FROM r""")
def progress_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which changes write a job's record: every tenth, or two seconds after the last write."""
    return jobs.flushes(job_images(spark, sf_dir).select("job", "seq", (F.col("seq") / 64).alias("at")))


@query(f"""WITH {JOBS_SQL}, l AS (SELECT job, arg_max(state, seq) AS state, arg_max(cost, seq) AS cost, max(seq) AS seq FROM ji GROUP BY job) SELECT job, state, CAST(cost AS DOUBLE) AS cost FROM l WHERE 11000 - seq <= 1200""")
def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each job, written as JSON and read back by its schema, as long as it is kept."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))
    written = job_images(spark, sf_dir).select("job", at.alias("updated_at"), F.to_json(F.struct("state", "cost")).alias("record"))
    last = jobs.upserted(written, "job", "updated_at", F.timestamp_seconds(F.lit(1_700_011_000)), 1200)
    return last.withColumn("r", F.from_json("record", "state string, cost double")).select("job", "r.state", "r.cost")


_CODES = [*rules.ERRORS, "no such code", None]


@query(f"""WITH c AS (SELECT p_partkey, [{', '.join("NULL" if c is None else f"'{c}'" for c in _CODES)}][p_partkey % {len(_CODES)} + 1] AS code, p_partkey % 2 = 0 AS told FROM part)
SELECT p_partkey, CASE WHEN code = 'no such code' THEN 'internal_error' ELSE code END AS code, CASE WHEN code IS NULL THEN NULL WHEN told AND code <> 'no such code' THEN 'says ' || p_partkey ELSE 'An internal error occurred.' END AS message,
  CASE WHEN code IS NOT NULL THEN code IN ('vendor_rate_limited', 'vendor_timeout', 'vendor_error') END AS retryable FROM c""")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as code, message and whether trying again may help."""
    code = F.get(F.array(*(F.lit(c).cast("string") for c in _CODES)), (F.col("p_partkey") % len(_CODES)).cast("int"))
    info = rules.error_info(code, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("says "), F.col("p_partkey").cast("string"))))
    return table(spark, sf_dir, "part").withColumn("e", info).select("p_partkey", "e.code", "e.message", "e.retryable")


_MIMES = ("image/png", "application/octet-stream", "application/postscript", "text/plain", "video/mp4")
_NAMES = (".png", ".nef", ".eps", ".exe", ".CR2", "")


@query(f"""WITH x AS (SELECT p_partkey, [{', '.join(f"'{m}'" for m in _MIMES)}][p_partkey % 5 + 1] AS mime, 'f' || [{', '.join(f"'{n}'" for n in _NAMES)}][p_partkey // 5 % 6 + 1] AS name FROM part)
SELECT p_partkey, starts_with(mime, 'image/') OR (mime IN ('application/postscript', 'application/octet-stream', 'video/quicktime', 'video/mp4', 'application/x-empty') AND lower(regexp_extract(name, '[.]([^.]*)$', 1)) IN ('crw', 'cr2', 'cr3', 'dng', 'nef', 'raw', 'eps')) AS accepted,
  lower(regexp_extract(name, '[.]([^.]*)$', 1)) IN ('nef', 'eps', 'cr2') AS reencode FROM x""")
def type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries taken for images by their bytes, or as camera raw and EPS by bytes and extension; what a vendor needs as PNG."""
    k = F.col("p_partkey")
    mime = F.get(F.array(*map(F.lit, _MIMES)), (k % 5).cast("int"))
    name = F.concat(F.lit("f"), F.get(F.array(*map(F.lit, _NAMES)), (F.floor(k / 5) % 6).cast("int")))
    ext = F.create_map(*(F.lit(x) for pair in formats.EXTENSIONS.items() for x in pair))
    source = F.try_element_at(ext, F.coalesce(formats.extension(name), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", formats.accepted_type(mime, name).alias("accepted"), formats.needs_reencode(source).alias("reencode"))


@query("""WITH x AS (SELECT p_partkey, list_filter([CASE WHEN p_size % 2 = 0 THEN 'jpeg' END, CASE WHEN p_size % 3 = 0 THEN 'tiff' END, CASE WHEN p_size % 4 = 0 THEN 'jpeg' END], lambda f: f IS NOT NULL) AS asked,
  ['png', 'jpeg', 'nef', 'bmp', NULL][p_partkey % 5 + 1] AS source, p_partkey % 3 > 0 AS match, p_partkey % 2 = 0 AS clear FROM part),
o AS (SELECT *, CASE WHEN clear AND source IN ('jpeg', 'bmp') THEN 'png' WHEN source = 'nef' THEN 'tiff' ELSE source END AS own, CASE WHEN len(asked) > 1 AND asked[1] = asked[-1] THEN asked[1:len(asked) - 1] ELSE asked END AS u FROM x),
w AS (SELECT *, CASE WHEN match AND source IS NOT NULL AND NOT list_contains(u, own) THEN list_append(u, own) ELSE u END AS all_ FROM o)
SELECT p_partkey, array_to_string(CASE WHEN len(all_) = 0 THEN ['png'] ELSE all_ END, ',') AS formats, len(all_) = 0 OR (match AND source IS NOT NULL AND (own <> source)) AS substituted FROM w""")
def formats_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested formats in order and without repeats, then the source's own or its stand-in."""
    k, s = F.col("p_partkey"), F.col("p_size")
    asked = F.array_compact(F.array(F.when(s % 2 == 0, "jpeg"), F.when(s % 3 == 0, "tiff"), F.when(s % 4 == 0, "jpeg")))
    source = F.get(F.array(*(F.lit(x).cast("string") for x in ("png", "jpeg", "nef", "bmp", None))), (k % 5).cast("int"))
    d = formats.delivered(asked, source, k % 3 > 0, k % 2 == 0)
    return table(spark, sf_dir, "part").withColumn("d", d).select("p_partkey", F.array_join("d.formats", ",").alias("formats"), F.col("d.substituted").alias("substituted"))


_BODIES = {
    0: '{"image": {"url": "a.png"}}', 1: '{"images": [{"url": "b.png"}, {"url": "c.png"}]}', 2: '{"url": "d.png"}', 3: "not json", 4: '{"images": []}', 5: '{"image": {"size": 3}, "url": "e.png"}',
}


@query("SELECT p_partkey, ['a.png', 'b.png', 'd.png', NULL, NULL, 'e.png'][p_partkey % 6 + 1] AS url, CASE WHEN p_partkey % 7 > 0 AND CAST(p_size AS BIGINT) * 20 * (p_partkey % 7 * 100) <= 250000 THEN 'preview' ELSE 'auto' END AS size FROM part")
def vendor_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture's address out of differing replies, and the size to ask for."""
    k = F.col("p_partkey")
    body = F.get(F.array(*map(F.lit, _BODIES.values())), (k % 6).cast("int"))
    side = F.when(k % 7 > 0, k % 7 * 100)
    return table(spark, sf_dir, "part").select("p_partkey", web.first_image_url(body).alias("url"), web.size_class(F.col("p_size") * 20, side).alias("size"))


def _reply(text: str) -> str:
    import json

    half = len(text) // 2
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text[:half]}, {"text": text[half:]}]}}]})


_ITEMS = '[{"box_2d": [100, 200, 500, 700], "label": " Chair "}, {"box_2d": [1, 2], "label": "cut"}, {"box_2d": [0, 0, 900, 1000.7], "label": "chair"}, {"label": "none"}, {"box_2d": [5, 5, 5, 5]}]'
_REPLIES = (_reply(_ITEMS), _reply('{"box_2d": [1, 2, 3, 4], "label": "Lamp"}'), _reply("no json"), "{}", "not json", _reply("  "))


@query("""WITH b AS (SELECT * FROM (VALUES (0, 0, [100, 200, 500, 700], 'chair'), (0, 1, [0, 0, 900, 1000], 'chair-2'), (1, 0, [1, 2, 3, 4], 'lamp')) AS t(turn, pos, box, label))
SELECT p_partkey, pos, array_to_string(box, ',') AS box, label FROM part JOIN b ON turn = p_partkey % 6""")
def located_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and labels out of a model's replies, at most twelve: empty boxes go, then repeats of a label get a number."""
    body = F.get(F.array(*map(F.lit, _REPLIES)), (F.col("p_partkey") % 6).cast("int"))
    full = F.filter(F.slice(web.located_boxes(body), 1, 12), lambda e: (F.get(e["box"], F.lit(2)) != F.get(e["box"], F.lit(0))) & (F.get(e["box"], F.lit(3)) != F.get(e["box"], F.lit(1))))
    named = F.transform(full, lambda e: F.struct(e["box"].alias("box"), F.when(e["label"] == "", "object").otherwise(e["label"]).alias("label")))
    rows = table(spark, sf_dir, "part").withColumn("all", named).select("p_partkey", "all", F.posexplode("all").alias("pos", "e"))
    same = F.size(F.filter(F.slice("all", 1, F.col("pos") + 1), lambda o: o["label"] == F.col("e.label")))
    return rows.select("p_partkey", "pos", F.array_join(F.col("e.box").cast("array<string>"), ",").alias("box"), F.when(same == 1, F.col("e.label")).otherwise(F.concat("e.label", F.lit("-"), same.cast("string"))).alias("label"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'first' END AS winner FROM part")
def tiebreak_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judgements out of a model's replies, and the mask both name; without agreement the better score stays."""
    turn = (F.col("p_partkey") % 4).cast("int")
    says = [_reply(f'{{"better": "{x}", "reason": "edge"}}') for x in "AB"] + [_reply('{"better": "neither"}')]
    forward, backward = (F.get(F.array(*map(F.lit, order)), turn) for order in ((says[0], says[1], says[0], says[2]), (says[1], says[0], says[0], says[0])))
    return table(spark, sf_dir, "part").select("p_partkey", rules.tiebreak(F.lit("first"), F.lit("second"), web.verdict(forward), web.verdict(backward)).alias("winner"))


@query(f"WITH {GRID_SQL} SELECT vec_id, CAST(COALESCE(min(x) FILTER (abs(r - 1) > 0.02), 0) AS INTEGER) AS x0, CAST(COALESCE(min(y) FILTER (abs(r - 1) > 0.02), 0) AS INTEGER) AS y0, CAST(COALESCE(max(x) FILTER (abs(r - 1) > 0.02) + 1, 0) AS INTEGER) AS x1, CAST(COALESCE(max(y) FILTER (abs(r - 1) > 0.02) + 1, 0) AS INTEGER) AS y1 FROM (SELECT *, CASE WHEN vec_id % 5 = 0 THEN 1.0 ELSE 1.0 - 0.3 * a * a END AS r FROM m) GROUP BY vec_id")
def shadow_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of what a shadow map darkens or brightens by more than its dead band."""
    off = F.transform("alpha", lambda a: F.when(F.col("vec_id") % 5 == 0, F.lit(0.0)).otherwise(F.abs((1.0 - 0.3 * a * a) - 1)))
    b = grid(spark, sf_dir).select("vec_id", masks.bbox(off, SIDE, 0.02).alias("b"))
    return b.select("vec_id", *(F.col(f"b.{n}").cast("int").alias(n) for n in ("x0", "y0", "x1", "y1")))


_LEVEL = "round_even((CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END) * 255, 0)"


@query(f"WITH {PIXELS_SQL} SELECT img, i, '#' || " + " || ".join(f"printf('%02X', CAST({_LEVEL.format(c=c)} AS INTEGER))" for c in "rgb") + " AS colour FROM px")
def hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear colours as hex, levels rounded half to even."""
    return pixels(spark, sf_dir).select("img", "i", flow.hex_of((F.col("r"), F.col("g"), F.col("b"))).alias("colour"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n, '/objects/jobs/j' || doc_id % 7 || '/out/' || doc_id || '.png' AS url FROM documents")
def object_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a local store serves an object: its key behind the store's path."""
    key = rules.output_key(F.concat(F.lit("j"), (F.col("doc_id") % 7).cast("string")), F.concat(F.col("doc_id").cast("string"), F.lit(".tif")), F.lit("png"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"), rules.object_url(key).alias("url"))


@query(f"""WITH {ENTRIES_SQL}, p AS (SELECT archive_id, page_id, CASE WHEN page_id % 8 = 0 THEN 'malicious_archive' END AS code FROM en WHERE archive_id <> 3) SELECT archive_id AS archive, row_number() OVER (PARTITION BY archive_id ORDER BY page_id) - 1 AS pos, page_id, code IS NULL AS planned, code FROM p""")
def plan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of all archives that exist, planned ones and refusals, in upload order."""
    e = entries(spark, sf_dir).withColumn("code", F.when(F.col("page_id") % 8 == 0, "malicious_archive"))
    existing = spark.range(7).where("id <> 3").select(F.col("id").alias("archive_id"))
    return rules.planned(e, existing, "archive_id", "page_id").select(F.col("archive_id").alias("archive"), "pos", "page_id", "planned", "code")


@query("""WITH f AS (SELECT doc_id, 's' || doc_id || ['.png', '.txt', '.JPG', '', '.cr2', '.gif'][doc_id % 6 + 1] AS name, n_chars AS size FROM documents)
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (contains(lower(name), 'jp')) AS found, count(*) FILTER (size > 2000) AS oversize, CAST(sum(size) FILTER (lower(regexp_extract(name, '[.]([^.]*)$', 1)) IN ('png', 'jpg', 'cr2')) AS BIGINT) AS readable_bytes FROM f""")
def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of files: how many, how large, how many match a search whatever their case, are too large, or can be read."""
    ends = F.array(*map(F.lit, (".png", ".txt", ".JPG", "", ".cr2", ".gif")))
    name = F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 6).cast("int")))
    return rules.file_totals(table(spark, sf_dir, "documents").select(name.alias("name"), F.col("n_chars").alias("size")), "JP", 2000)


@query(f"""WITH {JOBS_SQL}, o AS (SELECT job, seq, state = 'done' AS done, unnest(['png', 'tiff', 'preview']) AS f FROM ji) SELECT job, count(DISTINCT seq) FILTER (done) AS finished, count(DISTINCT seq) FILTER (NOT done) AS unfinished, count(*) FILTER (done AND f <> 'preview') AS deliverables FROM o GROUP BY job""")
def results_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job's results page shows: finished and unfinished images, and files to download (previews are none)."""
    images = job_images(spark, sf_dir).select("job", "state", F.array(F.lit("png"), F.lit("tiff"), F.lit("preview")).alias("formats"))
    return rules.results_page(images, "preview")


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages")
def entry_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of entries whose CRC-32 in the archive's index is that of the bytes (all of them)."""
    from ..functions.session import python_ready

    python_ready(spark)
    files = entries(spark, sf_dir).select("page_id", "file_size", "payload", F.crc32("payload").alias("crc"))
    return files.where(rules.checksum_holds(F.col("payload"), F.col("crc"))).select("page_id", F.col("file_size").alias("size"))


_DEMOS = (("white", "#FFFFFF", True), ("brand", "#F5F5F5", True), ("clear", None, True), ("flat", "#FFFFFF", False))


@query("WITH d AS (SELECT * FROM (VALUES ('white', '#FFFFFF', true), ('brand', '#F5F5F5', true), ('clear', NULL, true), ('flat', '#FFFFFF', false)) AS t(config, background, shadow)) SELECT p_partkey, config, COALESCE(background, 'transparent') AS background, shadow AND background IS NOT NULL AS shadow FROM part, d")
def demo_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scene under every demonstration configuration; a clear background drops the shadow."""
    configs = F.array(*(F.struct(F.lit(n).alias("config"), F.lit(b).cast("string").alias("background"), F.lit(s).alias("shadow")) for n, b, s in _DEMOS))
    each = table(spark, sf_dir, "part").select("p_partkey", F.explode(configs).alias("c"))
    return each.select("p_partkey", "c.config", F.coalesce("c.background", F.lit("transparent")).alias("background"), (F.col("c.shadow") & F.col("c.background").isNotNull()).alias("shadow"))


@query("""WITH s AS (SELECT p_partkey, p_size * 40 + 1 AS w, p_partkey % 37 * 30 + 1 AS h, p_partkey % 10 AS margin, p_partkey % 2 = 0 AS up FROM part),
r AS (SELECT *, least(900.0 / w, 600.0 / h) * greatest(1 - margin / 100.0 * 2, 0.05) AS raw FROM s), f AS (SELECT *, CASE WHEN raw > 1 AND NOT up THEN 1.0 ELSE raw END AS scale FROM r),
n AS (SELECT *, greatest(1, CAST(round_even(w * scale, 0) AS INTEGER)) AS nw, greatest(1, CAST(round_even(h * scale, 0) AS INTEGER)) AS nh FROM f)
SELECT p_partkey, round(scale, 6) AS scale, nw AS width, nh AS height, CAST(floor((900 - nw) / 2.0) AS INTEGER) AS x0, CAST(floor((600 - nh) / 2.0) AS INTEGER) AS y0 FROM n""")
def layers_on_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a frame with all its layers goes on a 900x600 canvas: scaled as one, centred as one."""
    from ..functions import boxes

    k = F.col("p_partkey")
    f = boxes.frame_on_canvas(F.col("p_size") * 40 + 1, k % 37 * 30 + 1, 900, 600, k % 10, k % 2 == 0)
    return table(spark, sf_dir, "part").withColumn("f", f).select("p_partkey", F.round("f.scale", 6).alias("scale"), *(F.col(f"f.{n}").alias(n) for n in ("width", "height", "x0", "y0")))
