"""Vendor replies, retries, download names and tolerant JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The error taxonomy by HTTP status, retry and polling schedules.
NO_FOREGROUND = ("unknown_foreground", "no_foreground", "foreground_not_found")
PREVIEW_PIXELS = 250_000
LONGEST_WAIT, FIRST_WAIT = 30.0, 0.5
POLL_FIRST_MS, POLL_GROWTH, POLL_MOST_MS = 1200, 1.25, 5000


def classify(status: Column, code: Column) -> Column:
    """The error a status stands for; null for 200."""
    return (
        F.when(status == 200, F.lit(None).cast("string"))
        .when(status == 429, "vendor_rate_limited")
        .when(status == 402, "vendor_out_of_credits")
        .when(status.isin(401, 403), "vendor_unauthorized")
        .when(status == 413, "vendor_payload_too_large")
        .when(status >= 500, "vendor_error")
        .when(code.isin(*NO_FOREGROUND), "no_foreground_found")
        .otherwise("vendor_error")
    )


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait: a number, or an HTTP date less now; never negative; null if it is neither."""
    number = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    wait = F.coalesce(number, date.cast("double") - now.cast("double"))
    return F.when(wait.isNotNull() & ~F.isnan(wait), F.greatest(wait, F.lit(0.0)))


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Wait before the next attempt (0 first): what the vendor asks, at most half a minute, or doubling."""
    return F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(LONGEST_WAIT))).otherwise(FIRST_WAIT * F.pow(F.lit(2.0), attempt))


def poll_interval_ms(turn: Column) -> Column:
    return F.least(F.lit(float(POLL_MOST_MS)), POLL_FIRST_MS * F.pow(F.lit(POLL_GROWTH), turn))


def error_code(body: Column) -> Column:
    """The first error's code in a JSON body; empty on any mismatch."""
    return F.coalesce(F.get_json_object(body, "$.errors[0].code"), F.lit(""))


def content_disposition(name: Column) -> Column:
    """Attachment header: an ASCII fallback, ? for every other sign, and the percent-encoded name.

    Control signs, quotes and backslashes would end the quoted form: _ stands in for them there.
    """
    plain = F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1F\x7F\"\\]", "_"), r"[^\x00-\x7F]", "?")
    # form encoding differs from the header's in four signs
    encoded = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(name), r"\+", "%20"), r"\*", "%2A"), "%7E", "~"), "%2F", "/")
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), encoded)


def safe_stem(name: Column) -> Column:
    """A file's name without its extension and without signs that a path or a header gives a meaning; `order` if nothing is left."""
    stem = F.regexp_replace(name, r"(?s)^(.*)\.[^.]*$", "$1")
    kept = F.trim(F.regexp_replace(F.when(stem == "", name).otherwise(stem), r'["\\/:*?<>|\x00-\x1F\x7F]', ""))
    return F.when(kept == "", F.lit("order")).otherwise(kept)


def size_class(width: Column, height: Column) -> Column:
    """The smallest size a vendor returns in full: preview up to a quarter of a megapixel; auto above, or if the size is unknown."""
    return F.when(width.cast("long") * height <= PREVIEW_PIXELS, F.lit("preview")).otherwise(F.lit("auto"))


def first_image_url(body: Column) -> Column:
    """A reply's image: image.url, else images[0].url, else url; null on any mismatch."""
    return F.coalesce(*(F.get_json_object(body, path) for path in ("$.image.url", "$.images[0].url", "$.url")))


def model_text(body: Column) -> Column:
    """The text that a model's reply holds, its parts joined; null if there is none."""
    parts = F.from_json(body, "struct<candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>>")
    texts = F.transform(F.get(parts["candidates"], F.lit(0))["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit("")))
    joined = F.array_join(texts, "")
    return F.when(F.trim(joined) != "", joined)


def located_boxes(body: Column) -> Column:
    """Boxes (y0, x0, y1, x1 in thousandths) with labels from a model's reply: a list or one object; entries without four numbers go."""
    text = F.trim(model_text(body))
    listed = F.when(text.startswith("["), text).when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))
    items = F.from_json(listed, "array<struct<box_2d: array<double>, label: string>>")
    good = F.filter(items, lambda e: (F.size(e["box_2d"]) >= 4) & F.forall(F.slice(e["box_2d"], 1, 4), lambda v: v.isNotNull()))
    shaped = F.transform(good, lambda e: F.struct(F.transform(F.slice(e["box_2d"], 1, 4), lambda v: v.cast("int")).alias("box"), F.substring(F.lower(F.trim(F.coalesce(e["label"], F.lit("")))), 1, 40).alias("label")))
    return F.coalesce(shaped, F.array().cast("array<struct<box: array<int>, label: string>>"))


def verdict(body: Column) -> Column:
    """Which of two masks a model prefers (A, B or equivalent); null if its reply names none."""
    better = F.get_json_object(model_text(body), "$.better")
    return F.when(better.isin("A", "B", "equivalent"), better)
