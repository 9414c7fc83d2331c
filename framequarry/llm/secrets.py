"""Secret scans with multipart credential linking.

Three strong kinds stand alone: assignments, access identifiers and long hexadecimal strings. Three
weak kinds are too common to report by themselves: account identifiers, secret-shaped strings and
endpoints. Each document is cut into scopes, the paragraphs between empty lines; the weak parts are
interval-joined within their scope, however far apart they stand, and one is reported only where
complementary parts - something that names an account or an endpoint, and something secret - meet
there without lying in one another.

The join is an ordered sweep inside one document, so no row ever leaves its partition. Null texts
scan like empty ones; texts of any length are scanned whole. Offsets are code points, end exclusive.
An empty table gives an empty one; rows that repeat are answered one by one; other columns, whatever
their names, are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, batches_of, kept_ddl, record, with_kept

#: Fixed values of the scan's contract: the strong kinds, in the order ties are listed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "identifier", "candidate", "endpoint")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Weak kinds, and what parts scopes.
IDENTIFIER = re.compile(r"""(?i:user(?:_?name)?|login|account|client_?id|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.ASCII)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""(?:https?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|s3)://[^\s"'<>]+""")
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")
#: A cheap test that decides whether a pattern can match at all.
HINT_ASSIGN = re.compile(r"[:=]")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The strong kinds, leftmost and non-overlapping within each kind, by start and then kind."""
    out: list[Span] = []
    if HINT_ASSIGN.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return _listed(out)


def _listed(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _looks_secret(value: str) -> bool:
    """Mixed letters and digits: words, numbers and identifiers in one case are not candidates."""
    return bool(re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value))


def weak_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if HINT_ASSIGN.search(text):
        out += [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
        if "://" in text:
            out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    out += [("candidate", m.start(), m.end()) for m in CANDIDATE.finditer(text) if _looks_secret(m.group())]
    return out


def link(text: str, base: list[Span], weak: list[Span]) -> list[Span]:
    """The weak spans that have a complementary part in their scope, and are no part of a strong span."""
    if not weak:
        return []
    cuts = [m.start() for m in PARAGRAPH.finditer(text)]
    names = _reaches(cuts, [(s, e) for k, s, e in base if k == "access"] + [(s, e) for k, s, e in weak if k in ("identifier", "endpoint")])
    secrets = _reaches(cuts, [(s, e) for k, s, e in base if k in ("assign", "hex")] + [(s, e) for k, s, e in weak if k == "candidate"])
    taken = sorted((s, e) for _, s, e in base)
    furthest = [*accumulate((e for _, e in taken), max)]  # how far the strong spans up to each one go
    out = []
    for kind, start, end in weak:
        if kind == "candidate":
            before = bisect_left(taken, (end, -1))
            if before and furthest[before - 1] > start:
                continue
        first_end, last_start = (names if kind == "candidate" else secrets).get(bisect_right(cuts, start), (end, start))
        if first_end <= start or last_start >= end:
            out.append((kind, start, end))
    return out


def _reaches(cuts: list[int], parts: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """For each scope that holds any of the parts: where the first of them ends and the last begins."""
    out: dict[int, tuple[int, int]] = {}
    for start, end in parts:
        scope = bisect_right(cuts, start)
        first_end, last_start = out.get(scope, (end, start))
        out[scope] = min(first_end, end), max(last_start, start)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The strong spans, and all spans with the linked weak ones."""
    base = base_spans(text)
    linked = link(text, base, weak_spans(text))
    return base, _listed(base + linked) if linked else base


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every span, or union of overlapping spans, replaced by a mask."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, the redacted text if asked for, and columns to keep.

    A narrow map: no shuffle, whole texts, one row for each row.
    """
    arrow_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
    schema = pa.schema(fields + [("redacted", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                texts = batch.column("text").to_pylist()
                found = [scan(text or "") for text in texts]
                columns = {"doc_id": batch.column("doc_id")}
                columns |= {f"n_{kind}": [sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS[:3]}
                columns |= {"base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], "spans": [written(spans) for _, spans in found]}
                if with_text:
                    columns["redacted"] = [redact(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
                yield with_kept(record(schema, **columns), batch, keep)

    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * with_text
    return docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text"))).mapInArrow(run, kinds + kept_ddl(docs, keep))
