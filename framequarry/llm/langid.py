"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every position and pools the positions'
probabilities over the document. It is trained here in numpy, by backpropagation through time, on a
bounded sample: of each language the `SAMPLE_EACH` labelled rows that come first by a hash of doc_id. Their
whole texts are cut into pieces of `PIECE` bytes, and of all these the `PIECES` that come first by a hash of
text and place make up what the training steps draw from. For prediction a text is cut into
strips of `STRIP` bytes that overlap by `LEAD` bytes on either side, so that all strips of a batch run
side by side; every byte of every text is labelled exactly once. Gates use clipped linear functions, so
a step is a few array operations.

A text that is null or has no letter is `und` with score 0. The score is the pooled probability of
the predicted language. Texts of any length are read whole. Rows that share a doc_id and a language count
once in training, as the text with the least hash, and are answered one by one; a null doc_id is neither
learnt from nor held out (null). With nothing to learn from, all is `und`; an empty table gives an empty
one. Other columns, whatever their names, are ignored unless asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, batches_of, kept_ddl, record, text_bytes, with_kept

UNKNOWN = "und"
HIDDEN = 6
SAMPLE_EACH, PIECE, PIECES, STEPS, ROWS_A_STEP, RATE = 800, 48, 3200, 200, 128, 0.03
STRIP, LEAD, WIDE = 240, 12, 2048
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id):
    """Whether a row must not be learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0.0, 1.0)


class Network:
    """Two gated recurrent layers over bytes, one a direction, and a linear read-out of both.

    Per direction d: `in`d (256, 3H) input tables for update gate, reset gate and candidate; `gate`d
    (H, 2H) and `cand`d (H, H) recurrent weights. Read-out: `out` (2H, classes) and `bias`.
    """

    def __init__(self, languages: list[str], seed: int = 7):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.languages = languages
        self.weights = {}
        for d in "fb":
            self.weights["in" + d] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.weights["gate" + d] = rng.normal(0, 0.3, (h, 2 * h)).astype(np.float32)
            self.weights["cand" + d] = rng.normal(0, 0.3, (h, h)).astype(np.float32)
        self.weights["out"] = rng.normal(0, 0.3, (2 * h, len(languages))).astype(np.float32)
        self.weights["bias"] = np.zeros(len(languages), np.float32)

    # -- training -----------------------------------------------------------------------------

    def _forward(self, d: str, data: np.ndarray) -> tuple[list, np.ndarray]:
        """States after each step (time, rows, H) and what the way back needs."""
        h, tape = np.zeros((data.shape[0], HIDDEN), np.float32), []
        states = np.empty((data.shape[1], data.shape[0], HIDDEN), np.float32)
        table, gate, cand = self.weights["in" + d], self.weights["gate" + d], self.weights["cand" + d]
        for t in range(data.shape[1]):
            x = table[data[:, t]]
            pre = x[:, : 2 * HIDDEN] + h @ gate
            both = _gate(pre)
            z, r = both[:, :HIDDEN], both[:, HIDDEN:]
            raw = x[:, 2 * HIDDEN :] + (r * h) @ cand
            c = np.clip(raw, -1, 1)
            tape.append((h, pre, z, r, raw, c))
            h = h + z * (c - h)
            states[t] = h
        return tape, states

    def _backward(self, d: str, data: np.ndarray, tape: list, grads: np.ndarray, into: dict) -> None:
        gate, cand = self.weights["gate" + d], self.weights["cand" + d]
        carry = np.zeros((data.shape[0], HIDDEN), np.float32)
        for t in range(data.shape[1] - 1, -1, -1):
            h, pre, z, r, raw, c = tape[t]
            g = grads[t] + carry
            d_raw = g * z * (np.abs(raw) < 1)
            d_mixed = d_raw @ cand.T
            d_pre = np.concatenate([g * (c - h), d_mixed * h], axis=1) * (0.25 * (np.abs(pre) < 2))
            into["cand" + d] += (r * h).T @ d_raw
            into["gate" + d] += h.T @ d_pre
            np.add.at(into["in" + d], data[:, t], np.concatenate([d_pre, d_raw], axis=1))
            carry = g * (1 - z) + d_mixed * r + d_pre @ gate.T

    def learn(self, pieces: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on the mean cross-entropy of every position's label."""
        rng, first, second = np.random.default_rng(seed), {}, {}
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(pieces), ROWS_A_STEP)
            data, label = pieces[rows], labels[rows]
            back = data[:, ::-1]
            tape_f, ahead = self._forward("f", data)
            tape_b, behind = self._forward("b", back)
            both = np.concatenate([ahead, behind[::-1]], axis=2)
            logits = both @ self.weights["out"] + self.weights["bias"]
            logits -= logits.max(axis=2, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=2, keepdims=True)
            p[:, np.arange(len(rows)), label] -= 1
            p /= p.shape[0] * p.shape[1]
            into = {k: np.zeros_like(w) for k, w in self.weights.items()}
            into["out"] = np.einsum("trh,trc->hc", both, p)
            into["bias"] = p.sum(axis=(0, 1))
            g = p @ self.weights["out"].T
            self._backward("f", data, tape_f, g[:, :, :HIDDEN], into)
            self._backward("b", back, tape_b, g[::-1, :, HIDDEN:], into)
            rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, grad in into.items():
                first[k] = 0.9 * first.get(k, 0) + 0.1 * grad
                second[k] = 0.99 * second.get(k, 0) + 0.01 * grad * grad
                self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    # -- prediction ---------------------------------------------------------------------------

    def _states(self, d: str, data: np.ndarray) -> np.ndarray:
        """As `_forward`, without a tape and in place; data (time, rows) of array indices."""
        rows, h2, quarter = data.shape[1], 2 * HIDDEN, np.float32(0.25)
        table = self.weights["in" + d]
        tables = [np.ascontiguousarray(table[:, k : k + HIDDEN]) for k in (0, HIDDEN, h2)]
        tables[0], tables[1] = tables[0] * quarter + np.float32(0.5), tables[1] * quarter + np.float32(0.5)
        update, reset = (np.ascontiguousarray(self.weights["gate" + d][:, k : k + HIDDEN]) * quarter for k in (0, HIDDEN))
        cand, zero, one = self.weights["cand" + d], np.float32(0), np.float32(1)
        states = np.empty((len(data), rows, HIDDEN), np.float32)
        h = np.zeros((rows, HIDDEN), np.float32)
        z, r, c, x = (np.empty((rows, HIDDEN), np.float32) for _ in range(4))
        for t in range(len(data)):
            np.matmul(h, update, out=z)
            np.matmul(h, reset, out=r)
            np.take(tables[0], data[t], axis=0, out=x, mode="clip")
            z += x
            np.clip(z, zero, one, out=z)
            np.take(tables[1], data[t], axis=0, out=x, mode="clip")
            r += x
            np.clip(r, zero, one, out=r)
            r *= h
            np.matmul(r, cand, out=c)
            np.take(tables[2], data[t], axis=0, out=x, mode="clip")
            c += x
            np.clip(c, -one, one, out=c)
            c -= h
            c *= z
            h = np.add(h, c, out=states[t])
        return states

    def positions(self, strips: np.ndarray) -> np.ndarray:
        """Probabilities (classes, time, rows) of the positions between the leads of strips (rows, time)."""
        data = np.ascontiguousarray(strips.T).astype(np.intp)
        ahead, behind = self._states("f", data)[LEAD:-LEAD], self._states("b", data[::-1])[::-1][LEAD:-LEAD]
        w, n = self.weights["out"], ahead.shape[0] * ahead.shape[1]
        logits = w[:HIDDEN].T @ ahead.reshape(n, HIDDEN).T
        logits += w[HIDDEN:].T @ np.ascontiguousarray(behind).reshape(n, HIDDEN).T
        logits += self.weights["bias"][:, None]
        np.clip(logits, np.float32(-30), np.float32(30), out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(len(w.T), *ahead.shape[:2])

    def pooled(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean probabilities per document: raw bytes end to end, each document's start in `ends`."""
        size = np.diff(ends)
        out = np.zeros((len(size), len(self.languages)))
        count = -(-size // STRIP)
        owner = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = ends[owner] + nth * STRIP
        padded = np.concatenate([np.full(LEAD, 32, np.uint8), raw, np.full(STRIP + LEAD, 32, np.uint8)])
        window = np.lib.stride_tricks.sliding_window_view(padded, STRIP + 2 * LEAD) if len(owner) else None
        place = np.arange(STRIP + 2 * LEAD)
        for at in range(0, len(owner), WIDE):
            s, o = start[at : at + WIDE], owner[at : at + WIDE]
            strips = window[s].copy()
            left, right = ends[o] - s + LEAD, ends[o + 1] - s + LEAD  # outside the document: blanks
            strips[(place < left[:, None]) | (place >= right[:, None])] = 32
            p = self.positions(strips)
            p *= place[LEAD:-LEAD, None] < np.minimum(right, LEAD + STRIP)[None, :]
            for k, sums in enumerate(p.sum(axis=1, dtype=np.float64)):
                out[:, k] += np.bincount(o, sums, len(size))
        return out / np.maximum(size, 1)[:, None]


def _pieces(text: str, doc_id: int) -> tuple[np.ndarray, list[bytes]]:
    """A whole text in pieces of `PIECE` bytes, the last one reaching back where it would be short, and a hash of each by id and place."""
    raw = text.encode()
    starts = np.arange(0, max(len(raw) - PIECE, 0) + PIECE, PIECE)
    starts[-1] = max(len(raw) - PIECE, 0)
    mixed = (np.arange(len(starts), dtype=np.uint64) + np.uint64(zlib.crc32(str(doc_id).encode()) << 32)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64), [raw[s : s + PIECE].ljust(PIECE) for s in starts.tolist()]


def learnt(docs: DataFrame, sample_each: int = SAMPLE_EACH) -> Network:
    """Train on a bounded sample: the first `sample_each` rows of each language by a hash of doc_id, of whose pieces `PIECES` a language reach the driver.

    Which rows is settled on ids and languages alone; their texts are read by a later scan and cut up in place.
    """
    arrow_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out("doc_id"), F.lit(True)))
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    counts = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))  # one row a language
    # the first by hash are among the lowest hashes: twice as many as needed are looked at, so that no language gathers in one task
    low = F.shiftrightunsigned("h", 1) <= F.least(F.lit(1.0), 2.0 * sample_each / F.col("n")) * float(1 << 63)
    likely = ids.join(F.broadcast(counts), "lang").where(low).select("lang", "h", "doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = likely.withColumn("nth", nth).where(F.col("nth") <= sample_each).select("doc_id", "lang")
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("piece", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                for lang, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "text")), strict=True):
                    if _LETTER.search(text):
                        h, pieces = _pieces(text, doc_id)
                        yield record(schema, lang=[lang] * len(pieces), h=h, piece=pieces)

    # at most sample_each ids a language: small enough to send to every task
    fetched = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    one = fetched.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("tk"), "text")).alias("least")).select("doc_id", "lang", "least.text")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))  # each task passes on its first PIECES alone
    rows = one.mapInArrow(cut, "lang string, h long, piece binary").withColumn("nth", order).where(F.col("nth") <= PIECES).select("lang", "nth", "piece").toArrow().sort_by([("lang", "ascending"), ("nth", "ascending")])
    langs = rows.column("lang").to_pylist()
    network = Network(sorted(set(langs)) or [UNKNOWN])
    if len(network.languages) > 1:
        pieces = np.frombuffer(b"".join(rows.column("piece").to_pylist()), np.uint8).reshape(-1, PIECE)
        place = {lang: k for k, lang in enumerate(network.languages)}
        network.learn(pieces, np.array([place[x] for x in langs]))
    return network


def identify(docs: DataFrame, network: Network, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and columns to keep) for every row, by a narrow map over whole texts."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(network)  # a few thousand weights, whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for whole in batches:
            for batch in batches_of(whole, most=2 << 20):
                pooled = net.pooled(*text_bytes(batch.column("text")))
                lettered = np.array([bool(t and _LETTER.search(t)) for t in batch.column("text").to_pylist()])
                best = pooled.argmax(axis=1)
                ids = batch.column("doc_id").to_pylist()
                out = record(
                    schema,
                    doc_id=batch.column("doc_id"),
                    held_out=[None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in ids],
                    lang_pred=[net.languages[k] if yes else UNKNOWN for k, yes in zip(best.tolist(), lettered.tolist(), strict=True)],
                    score=np.clip(np.where(lettered, pooled[np.arange(len(best)), best], 0.0), 0, 1),
                )
                yield with_kept(out, batch, keep)

    return docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text"))).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + kept_ddl(docs, keep))


def languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that may be learnt from, then label all rows."""
    return identify(docs, learnt(docs))
