"""Quality rules, the last of which asks whether a text is distributed like text of any known language.

Base rules count, in every whole text: words, their characters, symbols, lines that repeat an earlier one, and
words in runs of three that the text holds twice or more. A text fails them with too few words or too many
repeated ones. A text that passes is compared with references, one a language: the histogram of `CLASSES` of
characters and that of the language's `COMMON` commonest words and all others, by the Jensen-Shannon distance (the
square root of the divergence to base 2, 0 to 1). It is kept if it is near enough to the reference that is nearest by both.

Guards: characters are judged in texts of at least `LEAST_CHARS`, words in texts of at least `LEAST_WORDS`, and the
word limit falls with length, as a short text strays by chance. What no guard admits is kept.

References are counted over all documents that have a language and pass the base rules. Character histograms are
counted twice: first over all, then over the half of each language's documents that is nearest to that, so that junk
labelled with a language does not shift it. A language needs one document in `RARE` to have a reference, so there are no
more than RARE, of a fixed size each; those alone are broadcast. Word counts are added up a task, then by word, and
Spark's limit on ranks leaves each task's best before the exchange.

Defined results: null, empty and blank texts have no words and fail; rows that repeat are counted again; without any
labelled document there are no references, and what passes the base rules is kept, with null distances; an empty table gives an
empty one; texts are read whole; columns other than doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, batches_of, record, stored, text_bytes

FEWEST_WORDS, MOST_REPEATED = 50, 50
COMMON, RARE, BINS = 64, 1000, 1000
LEAST_CHARS, CHAR_LIMIT = 800, 0.16
LEAST_WORDS, WORD_LIMIT, WORD_SLACK = 50, 0.30, 1.0
#: Words that a task counts before it passes the counts on.
FLUSH = 200_000
CLASSES = ("vowel", "consonant", "upper", "digit", "blank", "line end", "stop", "mark", "call", "symbol", "beyond ascii")
_BLANK, _LINE = 4, 5
_CLASS = np.full(256, 9, np.uint8)
for _k, _members in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", range(65, 91), range(48, 58), b" ", b"\t\n\x0b\x0c\r", b".", b",;:'\"-()", b"!?")):
    _CLASS[list(_members)] = _k
_CLASS[192:], _CLASS[128:192] = 10, 11  # a character beyond ASCII counts by its first byte
_SYMBOLS = list(b"#*$%&|<>")


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a run of three that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, which, many = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= many[which] > 1
    return int(covered.sum())


@dataclass(frozen=True)
class Measures:
    """What the rules need of one text."""

    words: list[bytes]
    word_chars: int
    symbols: int
    dup_lines: int
    repeated: int
    chars: np.ndarray  # a count a class

    @property
    def failed(self) -> bool:
        n = len(self.words)
        return n < FEWEST_WORDS or 100 * self.repeated > MOST_REPEATED * n


def measure(part: np.ndarray) -> Measures:
    """Measures of a text, given as bytes."""
    by_byte = np.bincount(part, minlength=256)
    chars = np.bincount(_CLASS, by_byte, 12)[:11].astype(np.int64)
    raw = part.tobytes()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return Measures(words, int(chars.sum() - chars[_BLANK] - chars[_LINE]), int(by_byte[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words), chars)


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms, along the last axis."""
    p, q = (x / np.maximum(x.sum(axis=-1, keepdims=True), 1) for x in (p, q))
    return np.sqrt(np.maximum(_entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2, 0))


@dataclass(frozen=True)
class References:
    """A histogram of characters and one of common words (the rest last) for each language."""

    langs: list[str]
    chars: np.ndarray
    common: list[dict[bytes, int]]
    words: list[np.ndarray]

    def judge(self, of: Measures) -> tuple[bool, str | None, float | None, float | None]:
        """Whether a text that passes the base rules is kept; its nearest language and the distances to that."""
        if not self.langs:
            return True, None, None, None
        n, size = len(of.words), int(of.chars.sum())
        counts = Counter(of.words)
        chars = distance(of.chars, self.chars)
        words = np.array([distance(_words(counts, n, common), reference) for common, reference in zip(self.common, self.words, strict=True)])
        best = int((chars + words).argmin())
        strange = (size >= LEAST_CHARS and chars[best] > CHAR_LIMIT) or (n >= LEAST_WORDS and words[best] > WORD_LIMIT + WORD_SLACK / np.sqrt(n))
        return not strange, self.langs[best], round(float(chars[best]), 6), round(float(words[best]), 6)


def _words(counts: Counter, n: int, common: dict[bytes, int]) -> np.ndarray:
    out = np.zeros(COMMON + 1)
    for word, place in common.items():
        out[place] = counts.get(word, 0)
    out[COMMON] = n - out.sum()
    return out


_COUNTED = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("many", pa.int64()), ("chars", pa.list_(pa.int64()))])


def _counted(docs: DataFrame) -> DataFrame:
    """Of documents with a language that pass the base rules: a row of characters each, and counts of words a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def flushed() -> pa.RecordBatch:
            rows = [(lang, word, many) for lang, counts in words.items() for word, many in counts.items()]
            words.clear()
            return record(_COUNTED, lang=[r[0] for r in rows], word=[r[1] for r in rows], many=[r[2] for r in rows], chars=[None] * len(rows))

        for whole in batches:
            for batch in batches_of(whole):
                raw, ends = text_bytes(batch.column("text"))
                langs, chars = [], []
                for k, lang in enumerate(batch.column("lang").to_pylist()):
                    of = measure(raw[ends[k] : ends[k + 1]])
                    if not of.failed:
                        langs.append(lang)
                        chars.append(of.chars.tolist())
                        words.setdefault(lang, Counter()).update(of.words)
                yield record(_COUNTED, lang=langs, word=[None] * len(langs), many=[None] * len(langs), chars=chars)
                if sum(map(len, words.values())) > FLUSH:
                    yield flushed()
        yield flushed()

    return docs.where("lang is not null").select("text", "lang").mapInArrow(run, "lang string, word binary, many long, chars array<long>")


def references(docs: DataFrame) -> References:
    """One reference a language that is not rare."""
    arrow_batches(docs.sparkSession)
    counted = stored(_counted(docs), "divergence-counts")
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES))]
    each = counted.where("chars is not null")
    total = each.count()
    first = each.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *sums).where(F.col("docs") * RARE >= total).orderBy("lang").collect()  # at most RARE rows
    langs = [r.lang for r in first]
    if not langs:
        return References([], np.zeros((0, len(CLASSES))), [], [])
    rough = docs.sparkSession.sparkContext.broadcast({r.lang: np.array(r[2:], float) for r in first})
    schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("chars", pa.list_(pa.int64()))])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, chars = batch.column("lang").to_pylist(), np.array(batch.column("chars").to_pylist(), float).reshape(-1, len(CLASSES))
            far = distance(chars, np.array([rough.value[lang] for lang in names]).reshape(chars.shape))
            yield record(schema, lang=batch.column("lang"), bin=np.floor(far * BINS).astype(np.int32), chars=batch.column("chars"))

    known = F.col("lang").isin(langs)
    bins = each.where(known).select("lang", "chars").mapInArrow(binned, "lang string, bin int, chars array<long>").groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("docs"), *sums)
    lang = Window.partitionBy("lang")  # at most BINS + 1 rows
    before = F.coalesce(F.sum("docs").over(lang.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = bins.withColumns({"before": before, "docs": F.sum("docs").over(lang)}).where("2 * before < docs")
    chars = {r.lang: np.array(r[1:], float) for r in near.groupBy("lang").agg(*(F.sum(f"c{k}") for k in range(len(CLASSES)))).collect()}
    counts = counted.where(F.col("word").isNotNull() & known).groupBy("lang", "word").agg(F.sum("many").alias("many"))
    placed = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("many"), "word"))).where(F.col("place") <= COMMON).collect()  # COMMON a language
    whole = {r.lang: r.many for r in counted.where(F.col("word").isNotNull() & known).groupBy("lang").agg(F.sum("many").alias("many")).collect()}
    common = {name: {bytes(r.word): r.place - 1 for r in placed if r.lang == name} for name in langs}
    words = {name: np.zeros(COMMON + 1) for name in langs}
    for r in placed:
        words[r.lang][r.place - 1] = r.many
    for name in langs:
        words[name][COMMON] = whole[name] - words[name].sum()
    return References(langs, np.array([chars[name] for name in langs]), [common[name] for name in langs], [words[name] for name in langs])


_JUDGED = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ref_lang", pa.string()), ("char_distance", pa.float64()), ("word_distance", pa.float64())]
)


def judge_quality(docs: DataFrame, known: References | None = None) -> DataFrame:
    """Measures, verdict, nearest language and distances of every row, by a narrow map over whole texts."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(known or references(docs))  # at most RARE references

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                raw, ends = text_bytes(batch.column("text"))
                rows = []
                for k in range(batch.num_rows):
                    of = measure(raw[ends[k] : ends[k + 1]])
                    verdict = (False, None, None, None) if of.failed else sent.value.judge(of)
                    rows.append((len(of.words), of.word_chars, of.symbols, of.dup_lines, of.repeated, of.failed, *verdict))
                yield record(_JUDGED, doc_id=batch.column("doc_id"), **dict(zip(_JUDGED.names[1:], zip(*rows, strict=True), strict=True)))

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ref_lang string, char_distance double, word_distance double"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
