"""Token ids in files of compressed bit planes.

A file holds the ids of a range of documents, ascending by doc_id. Ids are cut into blocks of `BLOCK`;
a block is transposed so that all lowest bits lie together, then all next bits, and so on (or bytes
instead of bits), and each plane is compressed by itself with zstandard: high planes are all zeros and
cost nothing, low planes hold the entropy. At a file's end stand the chunk index (offset, ids and
compressed plane sizes of every block), the documents (ids and lengths) and a footer.

    magic "FQBP" | blocks ... | index (zstd of JSON-free int64 rows) | footer: 5 x int64, magic

Files are written to the shared folder under a passing name and then moved, so a task that is repeated
leaves the same file. A task streams: it holds one block and the file's index, whatever a document's
length. Where a file's ids begin among all ids comes from sums of file totals in two levels.

Null texts encode like empty ones and still get the end id. Rows that repeat a doc_id are separate
documents, in the order of their texts' hashes. A null doc_id comes first. An empty table writes no file
and gives an empty one; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, batches_of, fresh_folder, input_bytes, record, shuffle_partitions, stored, text_bytes

BLOCK = 1 << 16
MAGIC = b"FQBP\x01\x00\x00\x00"
END_ID = 2
#: How much text a range holds, ids in a file, and files that a range may have (its numbers leave room for them).
RANGE_BYTES, FILE_IDS, TURNS = 32 << 20, 16 << 20, 1 << 20
#: How many words and pieces a worker remembers, and ids of words; no longer ones (characters).
MEMO, PIECES, MEMO_IDS, LONGEST = 350_000, 100_000, 4_000_000, 64
LEVEL = 3


def to_planes(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """The planes of a block, lowest first: 32 of bits or 4 of bytes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    out = []
    for k in range(4):
        column = np.ascontiguousarray(raw[:, k])
        out += [np.packbits(column >> b & 1, bitorder="little").tobytes() if column.any() else b"" for b in range(8)]
    return out


def from_planes(planes: list[bytes], n: int, bits: bool = True) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if plane and bits:
            out[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << (k % 8)
        elif plane:
            out[:, k] = np.frombuffer(plane, np.uint8)
    return out.reshape(-1).view("<u4")


class Writer:
    """Streams documents into one file."""

    def __init__(self, sink, bits: bool = True):
        from zstandard import ZstdCompressor

        self.sink, self.bits, self.compress = sink, bits, ZstdCompressor(level=LEVEL).compress
        self.held, self.size, self.at = [], 0, len(MAGIC)
        self.blocks: list[list[int]] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.total = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(-(1 << 63) if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            joined = np.concatenate(self.held)
            whole = len(joined) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(joined[k : k + BLOCK])
            self.held, self.size = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.compress(p) if p and p.strip(b"\0") else b"" for p in to_planes(ids, self.bits)]
        self.blocks.append([self.at, len(ids), *map(len, planes)])
        for p in planes:
            self.sink.write(p)
        self.at += sum(map(len, planes))

    def close(self) -> None:
        if self.size:
            self._block(np.concatenate(self.held))
        width = 34 if self.bits else 6
        index = self.compress(np.array(self.blocks, "<i8").reshape(-1, width).tobytes())
        docs = self.compress(np.array([self.docs, self.lengths], "<i8").tobytes())
        self.sink.write(index)
        self.sink.write(docs)
        self.sink.write(np.array([self.at, len(index), len(docs), int(self.bits), self.total], "<i8").tobytes() + MAGIC)


class Reader:
    """Reads a file's index, any block, or all documents in order."""

    def __init__(self, source):
        from zstandard import ZstdDecompressor

        self.source, self.expand = source, ZstdDecompressor().decompress
        size = source.size()
        source.seek(size - 48)
        footer = source.read(48)
        if footer[40:] != MAGIC:
            raise ValueError("not a bit-plane file, or cut short")
        start, n_index, n_docs, bits, self.total = np.frombuffer(footer[:40], "<i8").tolist()
        self.bits = bool(bits)
        source.seek(start)
        self.blocks = np.frombuffer(self.expand(source.read(n_index)), "<i8").reshape(-1, 34 if self.bits else 6)
        self.docs, self.lengths = np.frombuffer(self.expand(source.read(n_docs)), "<i8").reshape(2, -1)

    def block(self, k: int) -> np.ndarray:
        start, n, *sizes = self.blocks[k].tolist()
        self.source.seek(start)
        raw, at, planes = self.source.read(sum(sizes)), 0, []
        plane = -(-n // 8) if self.bits else n
        for size in sizes:
            planes.append(self.expand(raw[at : at + size], max_output_size=plane) if size else b"")
            at += size
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        now, at, k = np.zeros(0, "<u4"), 0, 0
        for doc, length in zip(self.docs.tolist(), self.lengths.tolist(), strict=True):
            if len(now) - at < length:  # goes on in the next blocks: the rest of this one moves once
                held, have = [now[at:]], len(now) - at
                while have < length:
                    held.append(self.block(k))
                    have += len(held[-1])
                    k += 1
                now, at = np.concatenate(held), 0
            yield (None if doc == -(1 << 63) else doc), now[at : at + length]
            at += length


#: The steps before merging that are done here (fixed values: those of the tokenizer's file); a file with any others
#: goes through the library whole.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
}


#: In Arrow's syntax: what a text must not hold to be lower-cased and cut before the tokenizer's own steps; a letter and
#: a mark that always parts from it (an apostrophe need not).
_RARE, _LETTER_MARK = r"[^\x00-\x{24f}]|<", r"([a-z])([!-&(-/:-@\[-`{-~])"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def _with(known: dict, learnt: dict) -> dict:
    """What is known together with what was learnt, which is remembered where it is short."""
    if max(map(len, learnt), default=0) <= LONGEST:
        known.update(learnt)
        return known
    known.update((p, ids) for p, ids in learnt.items() if len(p) <= LONGEST)
    return known | learnt


def _stretches(ids: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids that rows name, end to end, and where each ends (0 before the first)."""
    stops = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(np.diff(ends)[rows], out=stops[1:])
    out = np.empty(stops[-1], "<u4")
    for k in range(0, len(rows), BLOCK):
        at = stops[k : k + BLOCK + 1]
        out[at[0] : at[-1]] = ids[np.repeat(ends[rows[k : k + BLOCK]] - at[:-1], np.diff(at)) + np.arange(at[0], at[-1])]
    return out, stops


class Memo:
    """Ids of words that were met, word after word in one array. When it is full, the half that was met last stays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}  # in the order of the rows
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.met, self.turn = np.zeros(0, np.int64), 0

    def values(self) -> list[bytes]:
        return [self.ids[a:b].tobytes() for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True)]

    def encode(self, words: pa.DictionaryArray, learn: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and where each word's end; `learn` gives those of new words."""
        names, known = words.dictionary.to_numpy(zero_copy_only=False).tolist(), len(self.rows)
        row = np.fromiter(map(self.rows.get, names, repeat(-1)), np.int32, len(names))
        fresh = np.flatnonzero(row < 0).tolist()
        ids, ends = self.ids, self.ends
        if fresh:
            short = [k for k in fresh if len(names[k]) <= LONGEST]
            if len(short) < len(fresh):  # what is not remembered comes last
                fresh = short + [k for k in fresh if len(names[k]) > LONGEST]
            learnt = learn([names[k] for k in fresh])
            row[fresh] = np.arange(known, known + len(fresh))
            ids = np.concatenate([ids, np.frombuffer(b"".join(learnt), "<u4")])
            ends = np.concatenate([ends, ends[-1] + np.cumsum([len(x) // 4 for x in learnt])])
            self.rows.update(zip([names[k] for k in short], range(known, known + len(short)), strict=True))
            known += len(short)
            self.ids, self.ends, self.met = ids[: ends[known]], ends[: known + 1], np.concatenate([self.met, np.zeros(len(short), np.int64)])
        self.turn += 1
        self.met[row[row < known]] = self.turn
        out = _stretches(ids, ends, row[words.indices.to_numpy()])
        if known > MEMO or len(self.ids) > MEMO_IDS:
            self._halve()
        return out

    def _halve(self) -> None:
        stay, names = np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2 :]), list(self.rows)
        self.rows = {names[k]: n for n, k in enumerate(stay.tolist())}
        self.ids, self.ends = _stretches(self.ids, self.ends, stay)
        self.met = self.met[stay]


class WordEncoder:
    """Encodes texts as the library does with the tokenizer's file; remembers what it has met.

    Where no token spans ASCII white space, Arrow cuts texts there and numbers the different parts of a
    batch; a part is encoded once, and the ids of all texts are taken from those of their parts together.
    Texts of plain characters are lower-cased before, and letters cut from marks after them. Most new
    parts (no character from U+0250 on, where normal forms and cases are plain, and no special token)
    are lower-cased and split here, and only their pieces, all in one text, go to a copy of the
    tokenizer without those steps; the ends of words in the ids part them again. All other parts go
    through the whole tokenizer one by one. A file whose steps are not those goes through it text by text.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        special = [t for t in steps.get("added_tokens") or []]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(c.isspace() for c in t["content"]) for t in special)
        model = steps["model"]
        self.by_parts = plain and all(steps.get(k) == v for k, v in _STEPS.items()) and not steps.get("post_processor") and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not self.by_parts:
            return
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        hard = "|".join([r"[^\x00-\u024f]", *(regex.escape(t["content"]) for t in special)])
        self.split, self.hard, self.letters = regex.compile(_SPLIT + r"|\n").findall, regex.compile(hard).search, _byte_letters()
        self.marks = all("<" in t["content"] for t in special)  # then ASCII parts without it hold none
        self.known = Memo()
        self.pieces: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        spelt = [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        parts = self.bare.encode_batch_fast([" ".join(spelt[k : k + 256]) for k in range(0, len(spelt), 256)], add_special_tokens=False)
        ids = np.array([i for x in parts for i in x.ids], "<u4")
        cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cut) != len(pieces):
            raise ValueError("the tokenizer joins parts across white space")
        raw, at, out = ids.tobytes(), 0, {}
        for piece, end in zip(pieces, cut, strict=True):
            out[piece] = raw[4 * at : 4 * end]
            at = end
        return out

    def _learn(self, texts: list[str]) -> list[bytes]:
        """Ids of new parts."""
        out = [b""] * len(texts)
        hard = [k for k, t in enumerate(texts) if (not t.isascii() or "<" in t or not self.marks) and self.hard(t)]
        for k, ids in zip(hard, self._ids([texts[k] for k in hard]), strict=True):
            out[k] = ids
        skip = set(hard)
        plain = [k for k in range(len(texts)) if k not in skip]
        found = self.split("\n".join([texts[k] for k in plain]).lower())
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        known = self.pieces
        fresh = list(set(found).difference(known, "\n"))
        known = _with(known, self._pieces(fresh) if fresh else {})
        held, turn = [], iter(plain)
        for piece in [*found, "\n"] if plain else []:
            if piece == "\n":
                out[next(turn)] = held[0] if len(held) == 1 else b"".join(held)
                held = []
            else:
                held.append(known[piece])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's end (0 before the first)."""
        if not self.by_parts:
            each = self._ids([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *(len(x) // 4 for x in each)])
        raw, at = text_bytes(texts)
        raw = raw.tobytes()
        whole, small = (pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(x)]) for x in (raw, raw.lower()))
        if self.marks:  # small letters, and letters cut from the marks after them, are fewer words with the same ids
            whole = pc.if_else(pc.match_substring_regex(whole, _RARE), whole, pc.replace_substring_regex(small, _LETTER_MARK, r"\1 \2"))
        parts = pc.ascii_split_whitespace(whole)
        ids, ends = self.known.encode(parts.flatten().dictionary_encode(), self._learn)
        return ids, ends[parts.offsets.to_numpy()]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, bits: bool = True) -> DataFrame:
    """Encode all documents and write their ids, ascending by doc_id; returns (bucket, path, n_docs, n_ids) of each file.

    Documents are dealt to ranges of doc_id by Spark's range partitioner (rows of one doc_id by their
    text's hash, so a doc_id that many rows share is no hot range); a range is encoded and written by
    one task, in files of `FILE_IDS` ids. A file's bucket is its range and its turn in it.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    arrow_batches(spark)
    parts = max(shuffle_partitions(spark), -(-input_bytes(docs) // RANGE_BYTES))
    files = pa.schema([("bucket", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, own, turn = word_encoder(path), TaskContext.get().partitionId(), 0
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        writer = sink = None
        passing = final = ""

        def finish() -> pa.RecordBatch:
            writer.close()
            sink.close()
            fs.move(passing, final)
            return record(files, bucket=[own * TURNS + turn], path=[final], n_docs=[len(writer.docs)], n_ids=[writer.total])

        for whole in batches:
            for batch in batches_of(whole):
                ids, ends = encoder.encode(batch.column("text"))
                ids, ends = np.insert(ids, ends[1:], END_ID), (ends + np.arange(len(ends))).tolist()
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                    if writer is None:
                        final = f"{base}/part-{own:08d}-{turn:06d}.fqbp"
                        passing = f"{final}.{uuid.uuid4().hex}"
                        sink = fs.open_output_stream(passing)
                        writer = Writer(sink, bits)
                    writer.add(doc_id, ids[a:b])
                    if writer.total >= FILE_IDS:
                        yield finish()
                        writer, turn = None, turn + 1
        if writer is not None:
            yield finish()

    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"))
    ranged = keyed.repartitionByRange(parts, "doc_id", "tk").sortWithinPartitions("doc_id", "tk")
    return ranged.select("doc_id", "text").mapInArrow(write, "bucket long, path string, n_docs long, n_ids long")


def with_starts(files: DataFrame) -> DataFrame:
    """Adds to each file how many ids all files before it hold: sums in groups of files, then over groups."""
    group = F.floor(F.col("bucket") / (1024 * TURNS))
    before = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row a group of 1,024 ranges
    groups = files.groupBy(group.alias("g")).agg(F.sum("n_ids").alias("n")).select("g", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    return files.withColumn("g", group).withColumn("within", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(groups, "g").withColumn("first", F.col("base") + F.col("within")).drop("g", "within", "base")


def read_ids(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Read files back: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, the ids."""
    arrow_batches(files.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    rows, held = [], 0
                    for doc_id, ids in Reader(source).documents():
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(raw), *([raw] * with_ids)))
                        start, held = start + len(ids), held + len(raw)
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield record(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
                            rows, held = [], 0
                    if rows:
                        yield record(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.select("path", "first").mapInArrow(run, kinds)


def round_trip(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write all documents' ids and return what the files say."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "ids")
    files = stored(write_ids(docs, folder, tokenizer), "id-files")
    started = with_starts(files)
    # one file or a few neighbours a task
    return read_ids(started.repartitionByRange(max(shuffle_partitions(spark), -(-input_bytes(docs) // RANGE_BYTES)), "bucket"), folder, with_ids)
