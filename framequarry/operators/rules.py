"""Rules over configurations, results and keys as Column expressions; folds over uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions import formats
from .folds import ordered_fold

# When a picture looks like a scene, types by extension, how long a probe's answer is trusted, how many samples are offered.
SCENE_UNIFORMITY, SCENE_SCORE, PROBE_SECONDS, MOST_SAMPLES = 0.05, 0.60, 5, 8
CONTENT_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff", "zip": "application/zip"}


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def violations(strategy: Column, engine: Column, transparent: Column, color: Column, formats: Column, match_source: Column, psd: Column) -> Column:
    """All rules a configuration breaks, in order, as names; empty if it is valid."""
    rules = (
        ((strategy == "single") & engine.isNull(), "engine_required"),
        (~transparent & color.isNull(), "color_required"),
        ((F.size(formats) == 0) & ~match_source, "nothing_delivered"),
        (transparent & F.array_contains(formats, "jpeg"), "transparent_jpeg"),
        (psd & ~F.array_contains(formats, "psd"), "psd_missing"),
        (~psd & F.array_contains(formats, "psd"), "psd_disabled"),
    )
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in rules)))


def looks_like_a_scene(uniformity: Column, best_score: Column, located: Column) -> Column:
    """An uneven backdrop together with a middling best mask, unless the subject was named."""
    return F.coalesce(~located & (uniformity <= SCENE_UNIFORMITY) & (best_score < SCENE_SCORE), F.lit(False))


def rejection_text(candidates: Column) -> Column:
    """'engine: reason' of every refused candidate, joined; candidates are structs of engine and reason."""
    refused = F.filter(candidates, lambda c: c["reason"].isNotNull())
    return F.array_join(F.transform(refused, lambda c: F.concat(c["engine"], F.lit(": "), c["reason"])), "; ")


def content_type(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(name, ".", -1))), F.lit("application/octet-stream"))


def output_key(job: Column, name: Column, fmt: Column) -> Column:
    stem = F.regexp_replace(name, r"(?s)^(.*)\.[^.]*$", "$1")
    return F.concat_ws("/", F.lit("jobs"), job, F.lit("out"), F.concat(F.when(stem == "", name).otherwise(stem), F.lit("."), fmt))


def source_key(index: Column) -> Column:
    return F.when(index == 0, "source.zip").otherwise(F.concat(F.lit("source-"), F.lpad(index.cast("string"), 3, "0"), F.lit(".zip")))


def accepted(uploads: DataFrame, most_images: int, most_bytes: int) -> DataFrame:
    """Which uploads (job, pos, images, bytes) a job takes: one that would pass a cap is refused and counts for nothing.

    What is taken depends on what was taken before, so it is a fold over a job's uploads in order.
    """

    def step(state: tuple, images: int, size: int) -> tuple:
        n, held, taken = state
        error = "too_many_images" if n + images > most_images else "too_many_bytes" if held + size > most_bytes else None
        return ((n, held, taken), (error, None)) if error else ((n + images, held + size, taken + 1), (None, taken))

    taken = ordered_fold(uploads, "job", ("pos",), ("images", "bytes"), (0, 0, 0), step, "error string, k int")
    return taken.select("job", "pos", "error", source_key(F.col("k")).alias("key"))


def trusted_probe(probes: DataFrame, by: str) -> DataFrame:
    """A probe's answer (by, seq, at in seconds, ok) holds for five seconds from when it was asked; then it is asked again."""

    def ask(state: tuple | None, at: float, ok: bool) -> tuple:
        if state is None or at - state[0] >= PROBE_SECONDS:
            state = (at, ok)
        return state, (state[1],)

    return ordered_fold(probes, by, ("seq",), ("at", "ok"), None, ask, "trusted boolean")


# What each error tells its user, and whether trying again may help.
ERRORS = {
    "vendor_rate_limited": True, "vendor_timeout": True, "vendor_unauthorized": False, "vendor_out_of_credits": False, "vendor_payload_too_large": False, "no_foreground_found": False, "vendor_error": True,
    "unsupported_file": False, "file_too_large": False, "malicious_archive": False, "image_decode_failed": False, "output_too_large": False, "batch_too_large": False, "bulk_requires_worker": False,
    "budget_exceeded": False, "job_cancelled": False, "psd_unavailable": False, "internal_error": False,
}


def error_info(code: Column, message: Column) -> Column:
    """An error as (code, message, retryable); an unknown code is an internal error, and null stays null."""
    retryable = F.create_map(*(F.lit(x) for pair in ERRORS.items() for x in pair))
    known = F.when(code.isin(*ERRORS), code).otherwise(F.lit("internal_error"))
    text = F.when(known == code, F.coalesce(message, F.lit("An internal error occurred."))).otherwise(F.lit("An internal error occurred."))
    return F.when(code.isNotNull(), F.struct(known.alias("code"), text.alias("message"), F.try_element_at(retryable, known).alias("retryable")))


def tiebreak(first: Column, second: Column, forward: Column, backward: Column) -> Column:
    """The winner of a pair judged twice, the second time with sides swapped: the agreed one, else the first by score."""
    agreed = F.when((forward == "A") & (backward == "B"), first).when((forward == "B") & (backward == "A"), second)
    return F.coalesce(agreed, first)


def fan_out(images: DataFrame, engines: DataFrame, cache: DataFrame) -> DataFrame:
    """Every image with every engine of a pool; what the cache has is a hit that costs nothing, the rest is to be computed.

    The pool is a job's configuration: it becomes one row, which every task gets, and an image's row fans out where it is.
    """
    pool = engines.agg(F.collect_list(F.struct("engine", "price")).alias("pool"))  # one row
    asked = images.crossJoin(F.broadcast(pool)).withColumn("e", F.explode("pool")).select(*images.columns, "e.engine", "e.price")
    hit = asked.join(cache.select("key", "engine", F.lit(True).alias("hit")), ["key", "engine"], "left")
    cached = F.coalesce("hit", F.lit(False))
    return hit.select("image_id", "engine", cached.alias("cache_hit"), F.when(cached, F.lit(0.0)).otherwise(F.col("price")).alias("cost"))


def in_order(value: Column, kind: DataType) -> Column:
    """A value with the fields of all its structs in order of their names."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(in_order(value[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(value, lambda v: in_order(v, kind.elementType))
    return value


def with_config_hash(configs: DataFrame, column: str = "config", leave_out: tuple[str, ...] = ("preset_name",)) -> DataFrame:
    """Adds config_hash: the first sixteen digits of the SHA-256 of a configuration (a struct) as canonical JSON.

    Canonical: keys in order at every depth, no blanks, nulls kept; names of presets do not count.
    """
    kind = configs.schema[column].dataType
    kept = StructType([f for f in kind.fields if f.name not in leave_out])
    text = F.to_json(in_order(F.col(column), kept), {"ignoreNullFields": "false"})
    return configs.withColumn("config_hash", F.substring(F.sha2(text, 256), 1, 16))


def samples(files: DataFrame, names: DataFrame | None = None, most: int = MOST_SAMPLES) -> DataFrame:
    """The samples on offer (name and other columns): readable by their names, the first so many in order of name.

    names: those asked for, which only choose among what is on offer and are never made a path of; None is all.
    """
    offered = files.where(formats.extension(F.col("name")).isin(*formats.EXTENSIONS)).orderBy("name").limit(most)
    return offered if names is None else offered.join(names.select("name").distinct(), "name", "left_semi")


def pasted(alpha: Column, x0: Column, y0: Column, side: int, frame: int) -> Column:
    """A square mask at (x0, y0) of an empty square frame, clipped; row-major arrays."""

    def cell(i: Column) -> Column:
        x, y = i % frame - x0, F.floor(i / frame) - y0
        inside = (x >= 0) & (x < side) & (y >= 0) & (y < side)
        return F.when(inside, F.get(alpha, (y * side + x).cast("int"))).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(frame * frame - 1)), cell)


def object_url(key: Column) -> Column:
    """Where a local store serves an object."""
    return F.concat(F.lit("/objects/"), key)


def planned(entries: DataFrame, existing: DataFrame, archive: str, order: str) -> DataFrame:
    """Entries and refusals (column code) of the archives that exist, each with its place in its archive."""
    here = entries.join(existing, archive, "left_semi")
    pos = F.row_number().over(Window.partitionBy(archive).orderBy(order)) - 1
    return here.withColumns({"pos": pos.cast("long"), "planned": F.col("code").isNull()})


def file_totals(files: DataFrame, search: str, most_bytes: int) -> DataFrame:
    """One row over a list of files (name, size): number, bytes, matches of a search in any case, too large ones, bytes that can be read."""
    size, readable = F.col("size"), formats.extension(F.col("name")).isin(*formats.EXTENSIONS)
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.count(F.when(F.lower("name").contains(search.lower()), 1)).alias("found"), F.count(F.when(size > most_bytes, 1)).alias("oversize"), F.sum(F.when(readable, size)).alias("readable_bytes"))


def results_page(images: DataFrame, preview: str) -> DataFrame:
    """Finished and unfinished images of each job (state, formats), and its files to download."""
    done = F.col("state") == "done"
    files = F.size(F.filter("formats", lambda f: f != preview))
    return images.groupBy("job").agg(F.count(F.when(done, 1)).alias("finished"), F.count(F.when(~done, 1)).alias("unfinished"), F.sum(F.when(done, files).otherwise(0)).alias("deliverables"))


def checksum_holds(payload: Column, crc: Column) -> Column:
    """Whether an entry's bytes are those its archive's index was written for."""
    return F.crc32(payload) == crc
