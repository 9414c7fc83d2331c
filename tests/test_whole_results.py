"""Queries whose SQL keeps fewer rows than there are: held against all of the rows, one by one."""

from __future__ import annotations

import re
from urllib.parse import quote

from framequarry.plans import catalogue
from framequarry.plans.adapters import job_images

ORDER = ("vendor_out_of_credits", "vendor_unauthorized", "vendor_rate_limited", "vendor_timeout", "vendor_error", "internal_error")
CODES = ("vendor_timeout", "vendor_rate_limited", "vendor_error", "internal_error", "vendor_unauthorized", "vendor_out_of_credits")


def test_every_failed_image_is_ranked(spark, small):
    failed = {}
    for r in job_images(spark, small).where("state = 'failed'").collect():
        failed.setdefault(r.job, []).append((ORDER.index(CODES[r.seq % 6]), r.seq))
    assert any(min(f)[1] % 11 >= 4 for f in failed.values())
    assert {(r.job, r.code) for r in catalogue.QUERIES["failure_rank"](spark, small).collect()} == {(job, ORDER[min(f)[0]]) for job, f in failed.items()}


def header(name: str) -> str:
    plain = re.sub(r'[\x00-\x1f\x7f"\\]', "_", name).encode("ascii", "replace").decode()
    return f"attachment; filename=\"{plain}\"; filename*=UTF-8''{quote(name)}"


def test_every_document_has_a_header(spark, small, tmp_path):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    signs = ['say "hi"\\now', "a:b|c[d]{e}<f>", "line\nend\r\n\ttab", "a+b c*d~e/f?g#h%i", "it's (1) $&;=@!^`,", "\u00e9\u4e2d\U0001f600\x00\x7f", "", " "]
    rows = given + [(10**9 + k, t) for k, t in enumerate(signs)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.header for r in catalogue.QUERIES["content_disposition"](spark, str(tmp_path)).collect()}
    assert got == {d: header(t[:24] + ".zip") for d, t in rows}
