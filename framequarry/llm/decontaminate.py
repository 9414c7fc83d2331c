"""Benchmark decontamination by an FM-index per training shard.

Each shard of training texts becomes one integer text over the benchmark's vocabulary; a word the
benchmark lacks, and a document's end, is a separator, and stretches between separators too short to
hold a test phrase are left out before indexing (they cannot match). The shard's suffix array gives
its Burrows-Wheeler transform, held as a wavelet tree; all test phrases are searched backward at
once through its ranks, occurrences are located by walking to sampled suffix positions, and their
spans are merged into the words to remove.

The test phrases are the one broadcast: they are read in blocks of at most `BLOCK_WORDS` words (one item
may be longer), whatever the benchmark's size, and held as arrays of word numbers; every block is searched in
all shards, and spans of several blocks are united per document. A text longer than a shard is a shard of its
own. An empty table gives an empty one, an empty benchmark no hits; other columns, whatever their names,
are ignored unless asked for. Null texts and items have no words; an item without words has no phrase; rows
that share an item_id are one item with the phrases of each. The phrases of items with a null id are
found like any other; only among a document's items such an item has no place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, batches_of, kept_ddl, record, text_key, with_kept

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 400_000
SAMPLE = 8
#: Bytes of the contract's words: digits, letters (upper case falls to lower) and all beyond ASCII; others part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class WaveletMatrix:
    """A sequence of small integers by bit levels, with access and rank for arrays of positions.

    A level is one bit an entry and one count a word of 64 bits.
    """

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.words, self.counts, now = bits, [], [], [], values
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, bool)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.counts[-1][-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def _ones(self, k: int, upto: np.ndarray) -> np.ndarray:
        """Set bits of level k before each position."""
        word = upto >> 6
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][word] + np.bitwise_count(self.words[k][word] & mask)

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(upto), upto
        for k in range(self.bits):
            bit, zeros = symbols >> (self.bits - 1 - k) & 1 == 1, self.zeros[k]
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k, zeros in enumerate(self.zeros):
            bit = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            a = self._ones(k, at)
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + a, at - a)
        return out


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling over the ranks of single symbols."""
    n, step = len(ranks), 1
    ranks = ranks.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = ranks[step:] + 1
        key = ranks * (int(ranks.max(initial=0)) + 2 + n) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        ranks[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over one shard; symbol 0 parts stretches and never matches."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        parts = symbols == 0
        count = int(parts.sum())
        ranks = np.where(parts, np.cumsum(parts) - 1, symbols.astype(np.int64) + count)  # each separator differs, so no tie crosses one
        order = suffix_array(ranks)
        transformed = symbols[order - 1]  # the first suffix takes the last symbol, a separator
        self.size, self.present = len(symbols), np.unique(symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))]).astype(np.int64)
        self.tree = WaveletMatrix(transformed, max(1, int(alphabet).bit_length()))
        # a walk never has to pass a separator; rows are ascending, so their positions are found by bisection
        self.rows = np.flatnonzero((order % SAMPLE == 0) | (transformed == 0)).astype(np.int32)
        self.places = order[self.rows].astype(np.int32)

    def search(self, words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases words[start : start + length] that occur: their numbers, and the range of rows whose suffixes begin with each."""
        found = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        for k in range(length - 1, -1, -1):
            symbol = words[starts[found] + k].astype(np.int64)
            low, high = self.starts[symbol] + self.tree.rank(symbol, low), self.starts[symbol] + self.tree.rank(symbol, high)
            live = high > low
            found, low, high = found[live], low[live], high[live]
        return found, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to sampled ones."""
        out, rows, todo, steps = np.empty(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows)), 0
        while len(todo):
            at = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
            done = self.rows[at] == rows
            out[todo[done]] = self.places[at[done]] + steps
            todo, rows = todo[~done], rows[~done]
            symbol = self.tree.access(rows).astype(np.int64)
            rows = self.starts[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return out


class Phrases:
    """A block of the benchmark: its vocabulary, its words as numbers end to end, and where phrases of each length begin.

    Equal windows are one phrase with all their items as owners, so the phrases of a length occur at different
    places of a shard, and what is found of them is never more than the shard holds.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.words = np.array([number(w, len(self.vocabulary) + 1) for _, words in items for w in words], np.int32)
        first = np.concatenate([[0], np.cumsum([len(words) for _, words in items], dtype=np.int64)])
        size = np.diff(first)
        length = np.minimum(size, WINDOW)
        self.names = sorted({item for item, words in items if words and item is not None})
        place = {item: k for k, item in enumerate(self.names)}
        owner = np.array([place.get(item, -1) for item, _ in items], np.int64)
        self.groups = []
        for n in np.unique(length[length > 0]).tolist():
            of = np.flatnonzero(length == n)
            count = size[of] - n + 1
            starts = np.repeat(first[of] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            rows = np.ascontiguousarray(self.words[starts[:, None] + np.arange(n)]).view(np.dtype((np.void, 4 * n))).reshape(-1)
            _, one, phrase = np.unique(rows, return_index=True, return_inverse=True)
            owners = np.repeat(owner[of], count)
            pairs = np.unique(phrase[owners >= 0] * (len(self.names) + 1) + owners[owners >= 0])
            phrase, owners = pairs // (len(self.names) + 1), pairs % (len(self.names) + 1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(phrase, minlength=len(one)))])
            self.groups.append((n, starts[one].astype(np.int32), owners, ends))
        self.shortest = min((group[0] for group in self.groups), default=WINDOW)

    def in_shard(self, texts: list[str | None]) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """For each text: its words, its merged spans (start, end, ... by word) and its items."""
        lookup, counts, parts = self.vocabulary.get, [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            parts.append(np.fromiter(map(lookup, words, repeat(0)), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
        spans, items = [[] for _ in texts], [[] for _ in texts]
        symbols = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], symbols != 0, [0]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if len(begin) and self.groups:
            size = end - begin + 1  # a stretch and the separator behind it
            place = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            index = FMIndex(symbols[place], len(self.vocabulary))
            first_word = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
            covered = np.zeros(len(symbols) + 1, np.int32)
            here = np.zeros(len(self.vocabulary) + 1, bool)
            here[index.present] = True
            pairs = []
            for length, starts, owners, ends in self.groups:
                likely = np.flatnonzero(np.logical_and.reduce([here[self.words[starts + k]] for k in range(length)]))
                found, low, high = index.search(self.words, starts[likely], length)
                number = high - low
                rows = np.repeat(low - (np.cumsum(number) - number), number) + np.arange(number.sum())
                if not len(rows):
                    continue
                start = place[index.locate(rows)]
                np.add.at(covered, start, 1)
                np.add.at(covered, start + length, -1)
                row = np.searchsorted(first_word, start, side="right") - 1
                phrase = np.repeat(likely[found], number)
                met = np.unique(row * len(starts) + phrase)  # a document and a phrase in it, once
                row, phrase = met // len(starts), met % len(starts)
                many = ends[phrase + 1] - ends[phrase]
                owner = owners[np.repeat(ends[phrase] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                pairs.append(np.unique(np.repeat(row, many) * (len(self.names) + 1) + owner))
            for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
                items[pair // (len(self.names) + 1)].append(self.names[pair % (len(self.names) + 1)])
            hit = np.cumsum(covered) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
            row = np.searchsorted(first_word, edge[::2], side="right") - 1
            for doc, a, b in zip(row.tolist(), (edge[::2] - first_word[row]).tolist(), (edge[1::2] - first_word[row]).tolist(), strict=True):
                spans[doc] += [a, b]
        return counts, spans, items


def phrase_blocks(benchmark: DataFrame) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded size; at least one block, which may be empty."""
    block, size, any_block = [], 0, False
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator(prefetchPartitions=False):
        words = words_of(row["text"])
        if block and size + len(words) > BLOCK_WORDS:
            yield Phrases(block)
            block, size, any_block = [], 0, True
        block.append((row["item_id"], words))
        size += len(words)
    if block or not any_block:
        yield Phrases(block)


_FOUND = "doc_id long, tk long, n_words long, spans array<int>, items array<string>"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def find_phrases(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tk (a hash of the text), n_words, merged spans by word, items and columns to keep; one row for each row.

    One block needs no shuffle at all. Several are united by document.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    slim = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text", *(c for c in keep if c not in ("doc_id", "text")))
    passes = []
    blocks = phrase_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    alone = second is None
    for phrases in chain([first], [] if alone else [second], blocks):
        sent = spark.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in batches_of(whole, most=SHARD_BYTES):
                    counts, spans, items = sent.value.in_shard(batch.column("text").to_pylist())
                    out = record(_FOUND_ARROW, doc_id=batch.column("doc_id"), tk=batch.column("tk"), n_words=counts, spans=spans, items=items)
                    yield with_kept(out, batch, keep if alone else ())

        passes.append(slim.mapInArrow(run, _FOUND + (kept_ddl(docs, keep) if alone else "")))
    if alone:
        return passes[0]
    united = passes[0]
    for other in passes[1:]:
        united = united.unionAll(other)
    copies = F.count(F.lit(1)) / len(passes)
    grouped = united.groupBy("doc_id", "tk").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sequence(F.lit(1), copies.cast("int")).alias("copy"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record(_FOUND_ARROW, doc_id=batch.column("doc_id"), tk=batch.column("tk"), n_words=batch.column("n_words"), spans=[merged(x) for x in batch.column("spans").to_pylist()], items=batch.column("items"))

    found = grouped.select("*", F.explode("copy")).drop("copy", "col").mapInArrow(merge, _FOUND)
    if not keep:
        return found
    once = found.dropDuplicates(["doc_id", "tk"]).withColumnRenamed("doc_id", "did").withColumnRenamed("tk", "key")
    return slim.join(once, F.col("doc_id").eqNullSafe(F.col("did")) & (F.col("tk") == F.col("key"))).select("doc_id", "tk", "n_words", "spans", "items", *(c for c in keep if c != "doc_id"))


def merged(lists: list[list[int]]) -> list[int]:
    """The union of spans given as flat lists of start, end."""
    out: list[int] = []
    for start, end in sorted(pair for x in lists for pair in zip(x[::2], x[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans."""
    found = find_phrases(docs, benchmark)
    length = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("sign")), lambda at, x: F.struct((at["n"] + at["sign"] * x).alias("n"), (-at["sign"]).alias("sign")), lambda at: at["n"])
    return found.select(
        "doc_id",
        "n_words",
        length.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
