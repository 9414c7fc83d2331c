"""What a file is by what is in it: containers of camera files and photographs are told apart by their directories and boxes.

First bytes settle the plain formats. A TIFF is a Canon, Nikon or Adobe raw file if its directories say so; a file of boxes
is what its brands and the handler inside say. A name counts for nothing here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.session import python_ready
from . import tiff

UNKNOWN = "application/octet-stream"
# First bytes and types, brands and types in the order they are looked for, and boxes that hold boxes.
PLAIN = (
    (b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"), (b"8BPS", "image/vnd.adobe.photoshop"),
    (b"%!PS-Adobe", "application/postscript"), (b"\xc5\xd0\xd3\xc6", "application/postscript"), (b"II\x1a\0\0\0HEAPCCDR", "image/x-canon-crw"),
)
BRANDS = ((b"crx ", "image/x-canon-cr3"), (b"avif", "image/avif"), (b"avis", "image/avif"), (b"heic", "image/heic"), (b"heix", "image/heic"), (b"mif1", "image/heif"), (b"msf1", "image/heif"), (b"qt  ", "video/quicktime"), (b"isom", "video/mp4"), (b"mp42", "video/mp4"))
HOLDERS, MOST_BOXES = (b"moov", b"meta", b"trak", b"mdia", b"iprp", b"ipco"), 10_000


def boxes(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, bytes, bytes]]:
    """Depth, kind and body of boxes, and of those inside. A body that is cut off ends what is read; nothing raises."""
    end, count = len(data) if end is None else end, 0
    while at + 8 <= end and count < MOST_BOXES:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head:
            return
        stop = min(at + size, end)
        yield depth, kind, data[at + head : stop]
        if kind in HOLDERS and depth < 6:
            yield from boxes(data, at + head + (4 if kind == b"meta" else 0), stop, depth + 1)
        at, count = at + size, count + 1


def _of_boxes(data: bytes) -> str:
    brands, handlers = [], set()
    for _, kind, body in boxes(data):
        if kind == b"ftyp":
            brands = [body[:4], *(body[k : k + 4] for k in range(8, len(body) - 3, 4))]
        elif kind == b"hdlr":
            handlers.add(body[8:12])
    named = next((kind for brand, kind in BRANDS if brand in brands[:1]), None) or next((kind for brand, kind in BRANDS if brand in brands), None)
    if named is None:
        return UNKNOWN
    stills = named.startswith("image/")
    # pictures have a picture handler, unless the file is cut before it
    return named if not handlers or stills == (b"pict" in handlers) or named == "image/x-canon-cr3" else UNKNOWN


def _of_tiff(data: bytes) -> str:
    if data[8:10] == b"CR" and len(data) > 10 and data[10] == 2:
        return "image/x-canon-cr2"
    try:
        found = tiff.directories(data)
    except (tiff.BadTiff, struct.error):
        return "image/tiff"
    if any(tiff.DNG_VERSION in tags for tags in found):
        return "image/x-adobe-dng"
    makers = [bytes(b"".join(tags[tiff.MAKER])).rstrip(b"\0 ").upper() for tags in found if tiff.MAKER in tags]
    raw = any(tags.get(tiff.INK, (0,))[0] in (32803, 34892) or tags.get(tiff.PACKING, (0,))[0] == 34713 for tags in found)
    if raw and any(m.startswith(b"NIKON") for m in makers):
        return "image/x-nikon-nef"
    if any(tiff.CR2_SLICES in tags for tags in found) and any(m.startswith(b"CANON") for m in makers):
        return "image/x-canon-cr2"
    return "image/tiff"


def kind_of(data: bytes | None) -> str:
    """The type of a file's bytes; unknown for none."""
    data = data or b""
    for first, kind in PLAIN:
        if data.startswith(first):
            return kind
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _of_tiff(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    if data[4:8] == b"ftyp":
        return _of_boxes(data)
    return "image/svg+xml" if data[:64].lstrip()[:5].lower() in (b"<?xml", b"<svg ", b"<svg>") else UNKNOWN


def with_kinds(files: DataFrame, payload: str = "payload", name: str = "mime") -> DataFrame:
    """Adds the type of each file's bytes. A narrow map; the payload may be a file's beginning."""
    python_ready(files.sparkSession, 64)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields), f"`{name}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.array([kind_of(body.as_py()) for body in batch.column(payload)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, kinds], names=[*batch.schema.names, name])

    return files.mapInArrow(run, ddl)
