"""Image formats: the dimension, and rules over names, first bytes and archive entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension -> source format; what each set holds.
EXTENSIONS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "webp": "webp", "eps": "eps", "psd": "psd", "crw": "crw", "cr2": "cr2", "cr3": "cr3", "dng": "dng", "nef": "nef", "raw": "raw"}
RAW = ("crw", "cr2", "cr3", "dng", "nef", "raw")
RENDERABLE = ("png", "jpeg", "webp", "bmp")
NO_ALPHA = ("jpeg", "bmp", "eps")
RAW_SUBSTITUTE, ALPHA_SUBSTITUTE, PREVIEW = "tiff", "png", "png"
JUNK_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
JUNK_BEGINNINGS = ("__MACOSX/", "._")  # of any part of a path
VENDOR_SAFE = ("png", "jpeg", "bmp", "tiff", "webp")
GATED_TYPES = ("application/postscript", "application/octet-stream", "video/quicktime", "video/mp4", "application/x-empty")
MOST_RATIO = 200.0
# First bytes in hexadecimal -> type, tried in this order.
SIGNATURES = (("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))
LATER_SIGNATURES = (("424D", "image/bmp"), ("38425053", "image/vnd.adobe.photoshop"))


def dim_format(spark: SparkSession) -> DataFrame:
    """One row an extension: fifteen rows, so a broadcast is safe."""
    rows = [(ext, src, src in RAW, RAW_SUBSTITUTE if src in RAW else src, src in RENDERABLE, src not in NO_ALPHA and src not in RAW) for ext, src in EXTENSIONS.items()]
    return spark.createDataFrame(rows, "ext string, source string, is_raw boolean, output string, renderable boolean, carries_alpha boolean")


def extension(name: Column) -> Column:
    """What follows the last dot, trimmed, in lower case; null without a dot."""
    ext = F.lower(F.trim(F.substring_index(name, ".", -1)))
    return F.when(name.contains(".") & (ext != ""), ext)


def basename(path: Column) -> Column:
    last = F.substring_index(F.rtrim(F.regexp_replace(path, r"\\", "/"), F.lit("/")), "/", -1)
    return F.when(last == "", F.lit("unnamed")).otherwise(last)


def is_junk(path: Column) -> Column:
    """Folders, resource forks (at any depth) and desktop litter (by exact name)."""
    parts = F.concat(F.lit("/"), path)
    forks = F.lit(False)
    for start in JUNK_BEGINNINGS:
        forks = forks | parts.contains(f"/{start}")
    return path.endswith("/") | forks | basename(path).isin(*JUNK_NAMES)


def is_gated(mime: Column, name: Column) -> Column:
    """Whether an entry that is no image by its bytes is a camera raw or EPS file: its type and its extension must both say so."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    source = F.try_element_at(known, F.coalesce(extension(name), F.lit("")))
    return F.coalesce(mime.isin(*GATED_TYPES) & source.isin(*RAW, "eps"), F.lit(False))


def accepted_type(mime: Column, name: Column) -> Column:
    return mime.startswith("image/") | is_gated(mime, name)


def needs_reencode(source: Column) -> Column:
    """Whether a vendor must be sent a PNG instead of the file; what is unknown goes as it is."""
    return F.coalesce(~source.isin(*VENDOR_SAFE), F.lit(False))


def delivered(requested: Column, source: Column, match_source: Column, transparent: Column) -> Column:
    """A struct of the formats to deliver, in order of request and without repeats, and whether one stands in for another."""
    raw, clear = source.isin(*RAW), transparent & F.coalesce(source, F.lit("")).isin(*NO_ALPHA)
    own = F.when(clear, ALPHA_SUBSTITUTE).when(raw, RAW_SUBSTITUTE).otherwise(source)
    also = F.when(match_source & source.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>"))
    wanted = F.array_distinct(F.concat(F.array_distinct(requested), also))
    empty = F.size(wanted) == 0
    substituted = empty | (match_source & source.isNotNull() & (clear | raw))
    return F.struct(F.when(empty, F.array(F.lit(PREVIEW))).otherwise(wanted).alias("formats"), substituted.alias("substituted"))


def is_unsafe_path(path: Column) -> Column:
    slashed = F.regexp_replace(path, r"\\", "/")
    return (path == "") | path.contains("\0") | slashed.startswith("/") | (F.substring(slashed, 2, 1) == ":") | F.exists(F.split(slashed, "/"), lambda part: part == "..")


def screen(path: Column, size: Column, packed: Column, most_bytes: int) -> Column:
    """The first reason to refuse an archive entry, as an error code; null if there is none. 0 bytes: no limit."""
    too_large = size > most_bytes if most_bytes else F.lit(False)
    return F.when(is_unsafe_path(path), F.lit("malicious_archive")).when(too_large, F.lit("file_too_large")).when((packed > 0) & (size / packed > MOST_RATIO), F.lit("malicious_archive"))


def sniff(payload: Column) -> Column:
    """MIME type by first bytes."""
    head = F.hex(F.substring(payload, 1, 16))
    out = None
    for digits, kind in SIGNATURES:
        out = F.when(head.startswith(digits), kind) if out is None else out.when(head.startswith(digits), kind)
    out = out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for digits, kind in LATER_SIGNATURES:
        out = out.when(head.startswith(digits), kind)
    text = F.lower(F.substring(F.regexp_replace(F.decode(F.substring(payload, 1, 16), "ISO-8859-1"), r"^[\x09-\x0D\x20]+", ""), 1, 5))
    return out.when(text.isin("<?xml", "<svg"), "image/svg+xml").otherwise("application/octet-stream")


def preview_format(delivered: Column) -> Column:
    """The extra format to render when nothing delivered can be shown; null if something can."""
    return F.when(~F.exists(delivered, lambda f: f.isin(*RENDERABLE)), F.lit(PREVIEW))
