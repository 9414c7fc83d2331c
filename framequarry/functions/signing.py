"""Addresses that are good for a while: keyed hashes and the canonical form of a request, as Column expressions.

The secret never stands in a plan: the day's key is derived on the driver, as the scheme has it, and travels as a row.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scheme.
ALGORITHM, SERVICE, PAYLOAD, BLOCK, LONGEST = "AWS4-HMAC-SHA256", "s3", "UNSIGNED-PAYLOAD", 64, 604_800
_HEX = "0123456789ABCDEF"


def _padded(key: Column, pad: int) -> Column:
    """A key filled up to a block with every byte crossed with a pad, digit by digit."""
    digits = F.rpad(F.hex(F.when(F.octet_length(key) > BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)), 2 * BLOCK, "0")

    def crossed(nibble: int) -> str:
        return "".join(f"{k ^ nibble:X}" for k in range(16))

    even, odd = crossed(pad >> 4), crossed(pad & 15)
    each = F.transform(F.sequence(F.lit(0), F.lit(2 * BLOCK - 1)), lambda k: F.when(k % 2 == 0, F.translate(F.substring(digits, k + 1, F.lit(1)), _HEX, even)).otherwise(F.translate(F.substring(digits, k + 1, F.lit(1)), _HEX, odd)))
    return F.unhex(F.array_join(each, ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """The keyed hash of a message (binary or text) as bytes: the key crossed with the inner pad, then with the outer one."""
    inner = F.unhex(F.sha2(F.concat(_padded(key, 0x36), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(_padded(key, 0x5C), inner), 256))


def uri_encoded(text: Column, keep_slashes: bool = False) -> Column:
    """Everything but letters, digits and -._~ as %XX of its UTF-8 bytes; slashes may stay."""
    out = F.url_encode(text)  # the form encoding differs in three signs
    for given, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *([("%2F", "/")] if keep_slashes else [])):
        out = F.replace(out, F.lit(given), F.lit(wanted))
    return out


def day_key(secret: str, day: str, region: str) -> bytes:
    """The key for a day, a region and the service."""
    key = ("AWS4" + secret).encode()
    for part in (day, region, SERVICE, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def canonical_query(access: Column, scope: str, stamp: str, seconds: int) -> Column:
    credential = uri_encoded(F.concat(access, F.lit(f"/{scope}")))
    return F.concat(F.lit(f"X-Amz-Algorithm={ALGORITHM}&X-Amz-Credential="), credential, F.lit(f"&X-Amz-Date={stamp}&X-Amz-Expires={seconds}&X-Amz-SignedHeaders=host"))


def with_signed_urls(objects: DataFrame, host: str, access: str, secret: str, region: str, at: datetime.datetime, seconds: int, key: str = "key", prefix: str = "") -> DataFrame:
    """Adds url: a GET address of each object (column `key`) at a host that is good for so many seconds (at most a week) from `at` on (UTC).

    prefix: what stands before the key in the path, a bucket for hosts that want one. A null or empty key has no address.
    """
    seconds = max(1, min(seconds, LONGEST))
    stamp, day = at.strftime("%Y%m%dT%H%M%SZ"), at.strftime("%Y%m%d")
    scope = f"{day}/{region}/{SERVICE}/aws4_request"
    spark = objects.sparkSession
    held = spark.createDataFrame([(bytearray(day_key(secret, day, region)), access)], "day_key binary, access string")  # one row
    path = F.concat(F.lit(f"/{prefix.strip('/')}/" if prefix else "/"), uri_encoded(F.col(key), True))
    query = canonical_query(F.col("access"), scope, stamp, seconds)
    request = F.concat(F.lit("GET\n"), path, F.lit("\n"), query, F.lit(f"\nhost:{host}\n\nhost\n{PAYLOAD}"))
    to_sign = F.concat(F.lit(f"{ALGORITHM}\n{stamp}\n{scope}\n"), F.sha2(request, 256))
    signature = F.lower(F.hex(hmac_sha256(F.col("day_key"), to_sign)))
    url = F.when(F.col(key) != "", F.concat(F.lit(f"https://{host}"), path, F.lit("?"), query, F.lit("&X-Amz-Signature="), signature))
    return objects.crossJoin(F.broadcast(held)).withColumn("url", url).select(*objects.columns, "url")
