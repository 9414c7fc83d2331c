"""Substring dedup by recompression.

Every text's words are compressed in rounds: first runs of one word, then pairs, get names of their
own, again and again. A name is a keyed hash of what it stands for, so the same run or pair has the
same name in every document and task, and a round needs no exchange to name things globally; which
pairs merge depends only on the names that meet (a hash puts each name on the left or the right side).
With each symbol goes its context, the words that decided how it came about. Hence equal stretches
have equal symbols wherever the context lies inside them, and every window of `WINDOW` words can be
tied to one such interior symbol - the one with the least hash of the highest round that has any;
single words always have. Higher rounds than the fourth seldom fit a window with their context.

Windows next to each other that are tied to one symbol form a chunk. Chunks meet by that interior symbol
and are verified by a name of all their words, however many they are: a second series of rounds names the
pairs of neighbouring stretches of 1, 2, 4, ... words at every place, until they exceed the window and the
chunk, which the pair of its first and its last such stretch then names.

1.  Chunks with the same name: all but the first in document order repeat it. Each task first
    settles this among its own chunks, so a passage that a third of all documents share reaches the
    exchange once a task.
2.  Interior symbols whose first chunks still differ (the edges of a repeat): the windows of those chunks
    are named one by one and settled in the same way.

So equality is that of names. A verifying name is two 64-bit numbers, each made by a non-linear mix of the two
names below it; the lowest are the halves of a 128-bit hash of the word's bytes. Unequal stretches share a
name with probability 2^-128. Rows meet packed in buckets by interior symbol; their number follows the input.

A window is judged on the input: earlier means a smaller doc_id, or the same document and an earlier
start. A null doc_id counts as smallest. Rows that repeat a doc_id with the same text are copies of
one document, none earlier than the other; with other texts they are documents of their own, in the order of
their texts' hashes (64 bits). Null and empty texts have no words; texts of any length are
read whole. An empty table gives an empty one; columns other than doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, batches_of, buckets_for, record, stored, text_key

WINDOW = 20
ROUNDS = ("run", "pair", "pair", "pair")
FLUSH = 400_000
NO_ID = -(1 << 63)
#: Words that a worker remembers the hashes of.
MEMO = 500_000
_ODD = np.array([[0xD6E8FEB86659FD93], [0xA0761D6478BD642F]], np.uint64)
_ENTRY = [("key", "<u8"), ("name", "<u8"), ("name2", "<u8"), ("doc", "<i8"), ("tk", "<i8"), ("start", "<i4"), ("n", "<i4")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _joined(left: np.ndarray, right: np.ndarray, odd: np.ndarray = _ODD[0]) -> np.ndarray:
    """The name of a pair of names; the order counts."""
    return _mix((left ^ (left >> np.uint64(32))) * odd + right)


def _run_name(name: np.ndarray, size: np.ndarray) -> np.ndarray:
    return _mix(name + size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _side(name: np.ndarray, turn: int) -> np.ndarray:
    """Whether a name stands on the right in a round's pairs."""
    return _mix(name + np.uint64(turn)) >> np.uint64(40) & np.uint64(1) == 1


class _Hashes(dict):
    """128-bit hashes of words, kept for those that are met again and again."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh3_128_digest

        digest = xxh3_128_digest(word, 20)
        if len(word) <= 64:
            self[word] = digest
        return digest


_known = _Hashes()


class Words:
    """The words of some texts end to end: their names (two rows), and where each document begins."""

    def __init__(self, texts: list[bytes | None]):
        parts = [t.split() if t else [] for t in texts]
        if len(_known) > MEMO:
            _known.clear()
        self.first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        raw = b"".join(map(_known.__getitem__, chain.from_iterable(parts)))
        self.names = np.ascontiguousarray(np.frombuffer(raw, "<u8").reshape(-1, 2).T)

    def window_starts(self) -> np.ndarray:
        count = np.maximum(np.diff(self.first) - WINDOW + 1, 0)
        return np.repeat(self.first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Symbols:
    """One round's symbols: name, context (first and last word, beyond the document if open, and its hash), document."""

    def __init__(self, name, low, high, context, doc, first):
        self.name, self.low, self.high, self.context, self.doc, self.first = name, low, high, context, doc, first

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the context of the symbol before begins and of that behind ends; a document's edge leaves it open."""
        before, behind = np.empty_like(self.low), np.empty_like(self.high)
        joined = self.doc[1:] == self.doc[:-1]
        before[1:] = np.where(joined, self.low[:-1], self.first[self.doc[1:]] - 1)
        behind[:-1] = np.where(joined, self.high[1:], self.first[self.doc[:-1] + 1])
        if len(before):
            before[0], behind[-1] = self.first[self.doc[0]] - 1, self.first[self.doc[-1] + 1]
        return before, behind

    def runs(self) -> "Symbols":
        before, behind = self._neighbours()
        head = np.flatnonzero(np.concatenate([[True], (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])])[: len(self.name)])
        tail = np.concatenate([head[1:], [len(self.name)]])[: len(head)] - 1
        name = np.where(tail > head, _run_name(self.name[head], tail - head + 1), self.name[head])
        last = len(self.name) - 1
        context = _joined(_joined(self.context[np.maximum(head - 1, 0)], name), self.context[np.minimum(tail + 1, last)])
        return Symbols(name, before[head], behind[tail], context, self.doc[head], self.first)

    def pairs(self, turn: int) -> "Symbols":
        before, behind = self._neighbours()
        right, n = _side(self.name, turn), len(self.name)
        merge = np.zeros(n, bool)
        merge[:-1] = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        low, high = np.where(right, before, self.low), np.where(right, self.high, behind)
        beside = _joined(self.context[:-1], self.context[1:])
        context = np.where(right, np.concatenate([[0], beside]).astype(np.uint64), np.concatenate([beside, [0]]).astype(np.uint64)) if n else self.context
        at = np.flatnonzero(merge)
        name = self.name.copy()
        name[at] = _joined(self.name[at], self.name[at + 1])
        low[at], high[at] = self.low[at], self.high[at + 1]
        keep = np.ones(n, bool)
        keep[at + 1] = False
        return Symbols(name[keep], low[keep], high[keep], context[keep], self.doc[keep], self.first)


def stretch_names(names: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A name (two rows) for each stretch of words: rounds name pairs of stretches of 1, 2, 4, ... words, two of which cover it."""
    out = np.empty((2, len(start)), np.uint64)
    turns = np.frexp(size)[1] - 1
    now, step = names, 1
    for turn in range(int(turns.max(initial=-1)) + 1):
        mine = np.flatnonzero(turns == turn)
        if len(mine):
            ends = _joined(now[:, start[mine]], now[:, start[mine] + size[mine] - step], _ODD)
            out[:, mine] = _joined(ends, size[mine].astype(np.uint64), _ODD)
        now = _joined(now[:, :-step], now[:, step:], _ODD)
        step *= 2
    return out


def _least(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the least key of each range [low, high) stands, leftmost first; ranges are short."""
    size = high - low
    out = low.copy()
    table, step, k = np.arange(len(key)), 1, 0
    most = int(size.max(initial=0))
    while step <= most:
        mine = np.flatnonzero((size >= step) & (size < 2 * step))
        a, b = table[low[mine]], table[high[mine] - step]
        out[mine] = np.where(key[b] < key[a], b, a)
        a, b = table[: max(0, len(key) - 2 * step + 1)], table[step : max(step, len(key) - step + 1)]
        table = np.where(key[b] < key[a], b, a)
        step, k = 2 * step, k + 1
    return out


def chunks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all windows: interior symbol's key, first window, number of windows, document."""
    starts = words.window_starts()
    n = words.names.shape[1]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, starts
    place = np.arange(n)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    now = Symbols(words.names[0], place, place, words.names[0], doc, words.first)
    rounds = [now]
    for k, kind in enumerate(ROUNDS):
        now = now.runs() if kind == "run" else now.pairs(k)
        rounds.append(now)
    key, low_word = np.zeros(len(starts), np.uint64), np.full(len(starts), -1, np.int64)
    open_ = np.arange(len(starts))
    for symbols in (rounds[4], rounds[3], rounds[2], rounds[0]):
        p = starts[open_]
        low = np.searchsorted(symbols.low, np.arange(n + 1))[p]
        high = np.searchsorted(symbols.high, np.arange(n + 1), side="right")[p + WINDOW - 1]
        some = high > low
        if some.any():
            best = _least(symbols.context, low[some], high[some])
            key[open_[some]] = symbols.context[best]
            low_word[open_[some]] = symbols.low[best]
        open_ = open_[~some]
        if not len(open_):
            break
    change = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(low_word) != 0) | (key[1:] != key[:-1])])
    head = np.flatnonzero(change)
    size = np.diff(np.concatenate([head, [len(starts)]]))
    return key[head], starts[head], size, doc[starts[head]]


def _entries(words: Words, key, start, n, doc, ids: np.ndarray, tk: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), _ENTRY)
    out["name"], out["name2"] = stretch_names(words.names, start, n + WINDOW - 1)
    out["key"] = out["name"] if key is None else key
    out["doc"], out["tk"], out["start"], out["n"] = ids[doc], tk[doc], start - words.first[doc], n
    return out


def chunk_entries(words: Words, ids: np.ndarray, tk: np.ndarray) -> np.ndarray:
    return _entries(words, *chunks(words), ids, tk)


def window_entries(words: Words, ids: np.ndarray, tk: np.ndarray, ranges: list[list[dict]]) -> np.ndarray:
    """Single windows of the given ranges of each document, each by the name of its words."""
    pairs = [(d, r["start"], r["n"]) for d, rows in enumerate(ranges) for r in rows]
    if not pairs:
        return np.zeros(0, _ENTRY)
    doc, start, n = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    first = np.repeat(words.first[doc] + start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return _entries(words, None, first, np.ones(len(first), np.int64), np.repeat(doc, n), ids, tk)


def settle(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(not met again, first of its like, repeats an earlier one), as entries. Copies of a row of one id stay together."""
    order = np.argsort(entries["key"])
    keys = entries["key"][order]
    same = keys[1:] == keys[:-1]
    met = np.zeros(len(order), bool)
    met[1:] |= same
    met[:-1] |= same
    alone, entries = entries[order[~met]], entries[order[met]]
    entries = entries[np.lexsort([entries[c] for c in ("start", "tk", "doc", "name2", "name", "key")])]
    if not len(entries):
        return alone, entries, entries
    fresh = np.concatenate([[True], (entries["key"][1:] != entries["key"][:-1]) | _differ(entries)])
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    first = np.logical_and.reduce([entries[c] == entries[c][lead] for c in ("doc", "tk", "start")])
    return alone, entries[first], entries[~first]


def _differ(entries: np.ndarray) -> np.ndarray:
    return (entries["name"][1:] != entries["name"][:-1]) | (entries["name2"][1:] != entries["name2"][:-1])


def _pack(entries: np.ndarray) -> bytes:
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(entries[c]).tobytes() for c, _ in _ENTRY))


def _unpack(blob: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(blob)
    n, at = len(raw) // sum(int(t[2]) for _, t in _ENTRY), 0
    out = np.empty(n, _ENTRY)
    for c, t in _ENTRY:
        out[c] = np.frombuffer(raw, t, n, at)
        at += n * int(t[2])
    return out


_PACKED = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("blob", pa.binary())])
_FLAGS = pa.schema([("did", pa.int64()), ("tk", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("repeats", pa.bool_())])


def _dealt(entries: list[np.ndarray], buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """A task's entries by bucket: what repeats within the task is settled here and only passes through."""
    alone, first, repeats = settle(np.concatenate(entries))
    send = np.concatenate([alone, first])
    bucket = ((send["key"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    send, bucket = send[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    rows = [(int(bucket[a]), False, _pack(send[a:b])) for a, b in zip([0, *cut], [*cut, len(send)], strict=True) if b > a]
    for k in range(0, len(repeats), 20_000):
        rows.append(((turn + k // 20_000) % buckets, True, _pack(repeats[k : k + 20_000])))
    for k in range(0, len(rows), 512):
        some = list(zip(*rows[k : k + 512], strict=True))
        yield record(_PACKED, bucket=some[0], settled=some[1], blob=some[2])


def _met(rows: DataFrame, of_batch, buckets: int, edges: bool) -> DataFrame:
    """Deal entries made by `of_batch` to buckets and settle each: did, tk, start, n, repeats.

    With `edges`, first chunks whose symbol has other chunks too come out as well, not `repeats`.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, turn = [], 0, TaskContext.get().partitionId() * 7919
        for whole in batches:
            for batch in batches_of(whole, most=1 << 20):
                held.append(of_batch(batch))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from _dealt(held, buckets, turn)
                    held, size, turn = [], 0, turn + 1
        if size:
            yield from _dealt(held, buckets, turn)

    def meet(group: pa.Table) -> pa.Table:
        settled = group.column("settled").to_pylist()
        blobs = group.column("blob").to_pylist()
        over = [_unpack(b) for b, s in zip(blobs, settled, strict=True) if s]
        here = [_unpack(b) for b, s in zip(blobs, settled, strict=True) if not s]
        _, first, repeats = settle(np.concatenate(here) if here else np.zeros(0, _ENTRY))
        edge = first[:0]
        if edges and len(first):
            fresh = np.flatnonzero(np.concatenate([[True], first["key"][1:] != first["key"][:-1]]))
            group_of = np.repeat(np.arange(len(fresh)), np.diff(np.concatenate([fresh, [len(first)]])))
            several = np.zeros(len(fresh), bool)
            differ = np.flatnonzero((first["key"][1:] == first["key"][:-1]) & _differ(first))
            several[group_of[differ]] = True
            edge = first[several[group_of]]
        cut = np.concatenate([*over, repeats])
        both = np.concatenate([cut, edge])
        return pa.table({"did": both["doc"], "tk": both["tk"], "start": both["start"], "n": both["n"], "repeats": np.arange(len(both)) < len(cut)}, schema=_FLAGS)

    packed = rows.mapInArrow(deal, "bucket int, settled boolean, blob binary")
    return packed.groupBy("bucket").applyInArrow(meet, "did long, tk long, start int, n int, repeats boolean")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("did").to_numpy(zero_copy_only=False), batch.column("tk").to_numpy(zero_copy_only=False)


def _words(batch: pa.RecordBatch) -> Words:
    return Words(batch.column("text").cast(pa.binary()).to_pylist())


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(did, tk, start, n): runs of n windows from word `start` that also start earlier somewhere.

    rows: did (doc_id, null replaced), tk (hash of the text), text.
    """
    buckets = buckets_for(rows)

    def all_chunks(batch: pa.RecordBatch) -> np.ndarray:
        return chunk_entries(_words(batch), *_ids(batch))

    def single_windows(batch: pa.RecordBatch) -> np.ndarray:
        return window_entries(_words(batch), *_ids(batch), batch.column("ranges").to_pylist())

    met = stored(_met(rows, all_chunks, buckets, edges=True), "substrings")
    open_ = met.where("not repeats").groupBy("did", "tk").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    again = _met(rows.join(open_.hint("shuffle_hash"), ["did", "tk"]), single_windows, buckets, edges=False)
    return met.where("repeats").drop("repeats").unionAll(again.drop("repeats"))


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text), one row for each row of docs."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), text_key(F.col("text")).alias("tk"), "text")
    cuts = repeated_windows(rows).groupBy("did", "tk").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                ids = [None if d == NO_ID else d for d in batch.column("did").to_pylist()]
                counts, removed, kept = [], [], []
                for text, starts, ns in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ns")), strict=True):
                    words = text.encode().split() if text else []
                    counts.append(len(words))
                    if starts:
                        change = np.zeros(len(words) + 1, np.int32)
                        np.add.at(change, starts, 1)
                        np.add.at(change, np.array(starts) + np.array(ns) + WINDOW - 1, -1)
                        stay = np.cumsum(change[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words))
                columns = {"doc_id": ids, "n_words": counts, "n_removed": removed, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
                yield record(schema, **columns, **({"kept": [k.decode() for k in kept]} if with_text else {}))

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return rows.join(cuts.hint("shuffle_hash"), ["did", "tk"], "left").mapInArrow(run, kinds)
