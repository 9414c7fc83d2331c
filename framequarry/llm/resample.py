"""Importance resampling: draw from a corpus the documents most like a target, by hashed word features.

A feature is a run of 1 to `RUNS` words (lower-cased A-Z; digits, letters and all beyond ASCII), counted as
often as it stands in a text, and falls into one of `BUCKETS` buckets by its CRC-32. Of each bucket the
corpus and the target give a gain, 1000 times the logarithm of how much likelier the target has it, smoothed
by one; a document's weight is the mean gain of its features, and its score is that plus noise of its own
(Gumbel, from a hash of seed and doc_id), so that the highest scores are a sample without replacement.

Rows with the same text are one before anything is computed: texts are grouped whole, each map task first
adding up its own copies, and features, counts and weight are made once a distinct text, counts being
multiplied by its copies. Features are written as bucket numbers and read for the counts, then for the
weights; counts are a number a bucket, whatever the corpus. Weights go back to documents by the
text's SHA-256: texts that make up `HOT_SHARE` of all rows or more - at most 1 / HOT_SHARE of them - are
broadcast, the rest are joined, so no key of the join has more rows than that share. Ranks come from
ranges of scores, numbered by sums over the ranges.

Defined results: null and empty texts, and those without words, have no features and weight 0; a null doc_id
is hashed like an empty one and loses ties; rows that share an id, or repeat, are documents of their own (equal
ones take their ranks in any order); an empty target or corpus only leaves the smoothing; texts are
read whole; other columns are ignored, whatever their names, unless asked for.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, batches_of, numbered, record, stored, text_bytes

RUNS, BUCKETS = 2, 10_000
SHARE_PERCENT, LEAST_WORDS, SEED = 25, 20, 7
HOT_SHARE = 1e-4
#: Words beyond this many bytes are hashed one by one.
LONG = 64
_ALL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32, from its reversed polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_TABLE = _crc_table()
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _fed(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states after a word each, all words side by side, a byte a step."""
    order = np.argsort(-sizes, kind="stable")
    out, at, size = state[order], starts[order], sizes[order]
    longest = int(np.searchsorted(-size, -LONG, side="left"))  # so many words are longer
    for k in range(longest):
        out[k] = zlib.crc32(raw[at[k] : at[k] + size[k]].tobytes(), int(out[k] ^ _ALL)) ^ int(_ALL)
    live = len(size)
    for step in range(int(size[longest]) if longest < live else 0):
        live = int(np.searchsorted(-size, -step, side="left"))
        now = out[longest:live]
        out[longest:live] = _TABLE[(now ^ raw[at[longest:live] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of texts, text by text; each text's number of words, and where its features begin."""
    raw, ends = text_bytes(column)
    rows = len(ends) - 1
    raw = _FOLD[raw]
    inside = _IN_WORD[raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = ends[(ends > 0) & (ends < len(raw))]  # a text's last word does not run on into the next text
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(stops) + 1 - starts
    row = np.searchsorted(ends, starts, side="right") - 1
    words = np.bincount(row, minlength=rows)
    runs, owners, state, first = [], [], np.full(len(starts), _ALL), np.arange(len(starts))
    for size in range(1, RUNS + 1):
        if size > 1:
            more = first + size - 1 < len(starts)
            more[more] = row[first[more] + size - 1] == row[first[more]]
            first, state = first[more], state[more]
            state = _TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        last = first + size - 1
        state = _fed(state, raw, starts[last], sizes[last])
        runs.append(((state ^ _ALL) % np.uint32(BUCKETS)).astype(np.int32))
        owners.append(row[first])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(runs)[order], words, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


_FEATURES = pa.schema([("key", pa.string()), ("copies", pa.int64()), ("n_words", pa.int64()), ("features", pa.list_(pa.int32()))])


def features(texts: DataFrame) -> DataFrame:
    """key, copies, n_words and features (bucket numbers) of every distinct text."""
    arrow_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                found, words, starts = buckets(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found, pa.int32()))
                yield record(_FEATURES, key=batch.column("key"), copies=batch.column("copies"), n_words=words, features=lists)

    distinct = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return distinct.select(F.sha2("text", 256).alias("key"), "text", "copies").mapInArrow(run, "key string, copies long, n_words long, features array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bucket numbers of a batch end to end, and where each row's begin."""
    lists = batch.column("features")
    starts = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[starts[0] : starts[-1]], starts - starts[0]


def counts(featured: DataFrame) -> np.ndarray:
    """How many features each bucket holds, copies counted: one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found, starts = _flat(batch)
            total += np.bincount(found, np.repeat(batch.column("copies").to_numpy(), np.diff(starts)), BUCKETS).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "total": pa.array(total[some], pa.int64())})

    summed = featured.select("copies", "features").mapInArrow(run, "bucket int, total long").groupBy("bucket").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("total").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket 1000 * ln of how much likelier the target has it, rounded down."""
    all_corpus, all_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, copies, n_words, n_features and weight of every distinct text."""
    sent = featured.sparkSession.sparkContext.broadcast(gain)  # a number a bucket
    schema = pa.schema([("key", pa.string()), ("copies", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, starts = _flat(batch)
            many = np.diff(starts)
            sums = np.diff(np.concatenate([[0], np.cumsum(sent.value[found])])[starts])
            yield record(schema, key=batch.column("key"), copies=batch.column("copies"), n_words=batch.column("n_words"), n_features=many, weight=sums // np.maximum(many, 1))

    return featured.mapInArrow(run, "key string, copies long, n_words long, n_features long, weight long")


def joined_back(docs: DataFrame, weighted: DataFrame, rows: int) -> DataFrame:
    """Documents (with `key`) and what belongs to their text; rows: how many documents there are."""
    values = ("n_words", "n_features", "weight")
    often = F.col("copies") >= math.ceil(rows * HOT_SHARE)  # at most 1 / HOT_SHARE texts
    hot = weighted.where(often).select("key", F.struct(*values).alias("hot"))
    rest = weighted.where(~often).select(F.col("key").alias("sought"), F.struct(*values).alias("cold"))
    found = docs.join(F.broadcast(hot), "key", "left")
    # what is found already matches nothing below, and is dealt out evenly
    sought = F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", F.monotonically_increasing_id()).cast("string")))
    both = found.withColumn("sought", sought).join(rest, "sought", "left").withColumn("of", F.coalesce("hot", "cold"))
    return both.select(*docs.columns, *(F.col(f"of.{c}").alias(c) for c in values))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, key (the text's SHA-256), n_words, n_features, weight and score of every document."""
    featured = stored(features(docs), "resample-features")
    corpus = counts(featured)
    rows = featured.agg(F.sum("copies")).first()[0] or 0
    weighted = stored(weights(featured, gains(corpus, counts(features(target)))), "resample-weights")
    named = docs.select("doc_id", *(c for c in keep if c != "doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    return joined_back(named, weighted, rows).withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null where it is not drawn), and the columns in keep.

    Drawn are `share_percent` of the documents of at least `least_words` words, those with the highest scores.
    """
    order = {"falling": -F.col("score"), "no_id": F.col("doc_id").isNull()}
    able = F.when(F.col("n_words") >= least_words, "able").otherwise("short")
    placed = numbered(scored(docs, target, seed, keep).withColumns({"grp": able, **order}), "falling", "no_id", "doc_id", "key")
    drawn = (F.col("grp") == "able") & (F.col("idx") < F.floor(F.col("n") * share_percent / 100))
    return placed.select("doc_id", *(c for c in keep if c != "doc_id"), "n_features", "weight", "score", F.when(drawn, F.col("idx") + 1).alias("rank"))
