"""Quality scores by histogram gradient-boosted trees over document statistics.

The trees are grown here in numpy, level by level, on histograms of binned statistics with logistic
loss, from a bounded sample of labelled rows (`SAMPLE_ROWS`, the first by a hash of doc_id; rows whose
crc32(doc_id as text) modulo 5 is 0 are held out). They are then flattened into arrays - feature,
threshold, children, value - and a batch of documents walks all trees at once, one numpy step a level.

A score is the probability of label 1, from the text alone. Null and empty texts have the statistics
of no text and get a score like any other. Labels of documents that do not exist, null labels and
null doc_ids are not learnt from; a document with several labels counts once for each. An empty table gives
an empty one; with nothing to learn from, every score is one half. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, batches_of, record, text_bytes

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 1.0, 1.0
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "blanks", "beyond_ascii", "stops", "commas", "marks", "symbols", "bars",
    "distinct", "top_word", "repeats_last", "upper_words", "symbol_words", "long_words", "short_words", "lines", "line_length", "distinct_lines", "entropy", "distinct_pairs",
)
_CLASSES = np.full(256, 8, np.uint8)
for _k, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\n\r\x0b\x0c", range(128, 256), b".", b",;:'\"-()", b"!?")):
    _CLASSES[list(_members)] = _k
_SYMBOLS = frozenset(b"#$%&*+/<=>@[]^_`{|}~!\\")


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    raw, ends = text_bytes(column)
    n = len(ends) - 1
    out = np.zeros((n, len(FEATURES)))
    for row in range(n):
        part = raw[ends[row] : ends[row + 1]]
        size = len(part)
        if not size:
            continue
        counts = np.bincount(part, minlength=256)
        by_class = np.bincount(_CLASSES, counts, 9) / size
        share = counts[counts > 0] / size
        text = part.tobytes()
        words, lines = text.split(), text.split(b"\n")
        many = max(len(words), 1)
        seen = Counter(words)
        sizes = [len(w) for w in words]
        out[row] = (
            np.log1p(size), np.log1p(len(words)), sum(sizes) / many, by_class[0] + by_class[1], by_class[1], by_class[2], by_class[3], by_class[4], by_class[5], by_class[6], by_class[7], by_class[8], counts[124] / size,
            len(seen) / many, max(seen.values(), default=0) / many, sum(map(eq, words, words[1:])) / many, sum(map(bytes.isupper, words)) / many,
            sum(w[-1] in _SYMBOLS for w in words) / many, sum(s > 12 for s in sizes) / many, sum(s < 3 for s in sizes) / many,
            np.log1p(len(lines)), size / len(lines), len(set(lines)) / len(lines), float(-(share * np.log2(share)).sum()), len(set(zip(words, words[1:]))) / many,
        )
    return out


class Trees:
    """Boosted trees as flat arrays; leaves point to themselves."""

    def __init__(self, width: int):
        self.base, self.depth = 0.0, DEPTH
        self.feature, self.threshold = np.zeros(0, np.int32), np.zeros(0)
        self.left, self.right, self.value, self.roots = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32)
        self.width = width

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum over trees, all rows and trees side by side."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boost `trees` trees of depth `DEPTH` on rows x (n, width) with labels y in 0, 1."""
    n, width = x.shape
    model = Trees(width)
    rate = (y.sum() + 0.5) / (n + 1)
    model.base = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(n, model.base)
    parts: list[list[float]] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(parts))
        node = np.full(n, len(parts))
        parts.append([0, 0.0, 0, 0, 0.0])
        level = [roots[-1]]
        for depth in range(DEPTH + 1):
            local = np.full(len(parts), -1)
            local[level] = np.arange(len(level))
            k = local[node]
            live = np.flatnonzero(k >= 0)
            gs, hs = np.bincount(k[live], g[live], len(level)), np.bincount(k[live], h[live], len(level))
            best = np.full(len(level), 1e-9)
            split = [(-1, 0)] * len(level)
            if depth < DEPTH:
                for f in range(width):
                    cell = k[live] * BINS + binned[live, f]
                    gl = np.cumsum(np.bincount(cell, g[live], len(level) * BINS).reshape(-1, BINS), axis=1)[:, :-1]
                    hl = np.cumsum(np.bincount(cell, h[live], len(level) * BINS).reshape(-1, BINS), axis=1)[:, :-1]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = np.where((hl >= LEAST) & (hr >= LEAST), gl**2 / (hl + L2) + gr**2 / (hr + L2), -np.inf) - (gs**2 / (hs + L2))[:, None]
                    top = gain.argmax(axis=1)
                    for j in np.flatnonzero(gain[np.arange(len(level)), top] > best):
                        if top[j] < len(cuts[f]):
                            best[j], split[j] = gain[j, top[j]], (f, int(top[j]))
            following = []
            for j, at in enumerate(level):
                f, cut = split[j]
                if f < 0:
                    parts[at] = [0, 0.0, at, at, float(-RATE * gs[j] / (hs[j] + L2))]
                    continue
                children = [len(parts), len(parts) + 1]
                parts[at] = [f, float(cuts[f][cut]), *children, 0.0]
                parts += [[0, 0.0, c, c, 0.0] for c in children]
                mine = node == at
                node[mine] = np.where(binned[mine, f] <= cut, children[0], children[1])
                following += children
            level = following
            if not level:
                break
        values = np.array([p[4] for p in parts])
        margin += values[node]
    columns = list(zip(*parts, strict=True))
    model.feature, model.threshold = np.array(columns[0], np.int32), np.array(columns[1])
    model.left, model.right, model.value = np.array(columns[2], np.int32), np.array(columns[3], np.int32), np.array(columns[4])
    model.roots = np.array(roots, np.int32)
    return model


def _statistics(docs: DataFrame) -> DataFrame:
    """x (the features of text), quality and h of every row."""
    schema = pa.schema([("x", pa.list_(pa.float64())), ("quality", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                yield record(schema, x=features(batch.column("text")).tolist(), quality=batch.column("quality"), h=batch.column("h"))

    return docs.mapInArrow(run, "x array<double>, quality int, h long")


def learnt(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Grow trees on at most `sample_rows` labelled rows that are not held out, chosen by hashes of doc_id and statistics."""
    arrow_batches(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    sample = usable.select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "quality").limit(sample_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "quality", "h")
    # ids may repeat in documents: the rows are bounded too, in a fixed order
    rows = _statistics(labelled).orderBy(F.xxhash64("h", "x"), "h", "quality", "x").limit(sample_rows).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows.column("quality").to_numpy().astype(float)
    order = np.lexsort([*x.T, y]) if len(y) else []
    return grow(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, by a narrow map over whole texts."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(trees or learnt(docs, labels))  # a few thousand numbers, whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                score = sent.value.score(features(batch.column("text")))
                held = [None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in batch.column("doc_id").to_pylist()]
                yield record(schema, doc_id=batch.column("doc_id"), held_out=held, score=score, predicted=(score >= THRESHOLD).astype(np.int32))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
