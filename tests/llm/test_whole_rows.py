"""The rows of whole queries recomputed by other means: quality scores, fingerprints, byte-level ids."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framequarry.llm import bpe, minhash, pii, quality
from framequarry.llm.common import table
from framequarry.llm.queries import llm_queries


@pytest.fixture(scope="module")
def texts(spark, small):
    return dict(sorted((r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()))


# -- quality ------------------------------------------------------------------------------------


def statistics(text: str) -> dict[str, float]:
    raw = text.encode()
    if not raw:
        return {}
    share = lambda signs: sum(c in signs for c in text) / len(raw)  # noqa: E731  (ASCII signs: a character is a byte)
    words, lines = re.findall(r"[^ \t\n\r\x0b\x0c]+", text), text.split("\n")
    many = max(len(words), 1)
    count, bytes_ = Counter(words), Counter(raw)
    sizes = [len(w.encode()) for w in words]
    lower, upper, digits, blanks = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c"
    stops, commas, marks = ".", ",;:'\"-()", "!?"
    known = lower + upper + digits + blanks + stops + commas + marks
    ascii_upper = lambda w: any(c in upper for c in w) and not any(c in lower for c in w)
    return {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "word_length": sum(sizes) / many, "letters": share(lower + upper), "upper": share(upper), "digits": share(digits), "blanks": share(blanks),
        "beyond_ascii": sum(b >= 128 for b in raw) / len(raw), "stops": share(stops), "commas": share(commas), "marks": share(marks), "symbols": sum(b < 128 and chr(b) not in known for b in raw) / len(raw), "bars": share("|"),
        "distinct": len(count) / many, "top_word": max(count.values(), default=0) / many, "repeats_last": sum(a == b for a, b in zip(words, words[1:], strict=False)) / many, "upper_words": sum(map(ascii_upper, words)) / many,
        "symbol_words": sum(w[-1] in "#$%&*+/<=>@[]^_`{|}~!\\" for w in words) / many, "long_words": sum(s > 12 for s in sizes) / many, "short_words": sum(s < 3 for s in sizes) / many,
        "lines": math.log1p(len(lines)), "line_length": len(raw) / len(lines), "distinct_lines": len(set(lines)) / len(lines), "entropy": -sum(n / len(raw) * math.log2(n / len(raw)) for n in bytes_.values()),
        "distinct_pairs": len(set(zip(words, words[1:], strict=False))) / many,
    }


def test_quality_scores_of_a_table(spark, small, texts):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    trees = quality.learnt(docs, labels)
    rows = quality.score_quality(docs, labels, trees).collect()
    assert len(rows) == len(texts)
    odd = ["", " ", "\n\n", "ÄÖ ü", "A!", "x|y|z", "word\x85word b"]
    for text, got in zip([*texts.values(), *odd], quality.features(pa.array([*texts.values(), *odd])), strict=True):
        own = statistics(text)
        assert np.allclose(got, [own.get(name, 0.0) for name in quality.FEATURES], atol=1e-9)
    for r in rows:
        own = statistics(texts[r.doc_id])
        x, total = [own.get(name, 0.0) for name in quality.FEATURES], trees.base
        for at in trees.roots.tolist():
            while trees.left[at] != at:
                at = int(trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] + 1e-12 else trees.right[at])
            total += trees.value[at]
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


# -- fingerprints -------------------------------------------------------------------------------


def print_of(text: str) -> str:
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", text)
    least: dict[int, int] = {}
    for k in range(max(1, len(words) - 4)) if words else ():
        h = 42
        for word in words[k : k + 5]:
            h = xxhash.xxh64_intdigest(word.encode(), h)
        least[h & 127] = min(h >> 16, least.get(h & 127, 1 << 64))
    if not least:
        return ""
    orders = minhash._orders().reshape(128, 127).tolist()
    return "".join(f"{least[k if k in least else next(j for j in orders[k] if j in least)] & 255:02x}" for k in range(128))


def likeness(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    equal = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 256, 2))
    return max(0.0, (equal / 128 - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_of_a_table(spark, small, texts):
    got = {r.doc_id: r for r in llm_queries()["op7_minhash_fingerprints"](spark, small).collect()}
    ids = list(texts)
    assert set(got) == set(ids)
    for k, d in enumerate(ids):
        text, after = texts[d], texts[ids[(k + 1) % len(ids)]]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        mine, other = print_of(text), print_of(edited)
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), mine, other)
        assert r.near_edited == pytest.approx(likeness(mine, other)) and r.near_next == pytest.approx(likeness(mine, print_of(after)))


# -- byte-level ids -----------------------------------------------------------------------------


def test_ids_of_a_table(spark, small, texts):
    import tiktoken

    path, pattern = bpe.default_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = llm_queries()["op10_byte_bpe"](spark, small).collect()
    assert sorted(r.doc_id for r in rows) == list(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# -- pseudonyms ---------------------------------------------------------------------------------


def drawn(key: str, kind: str, turn: int, value: object) -> int:
    return int(hashlib.sha256(f"{key}|{kind}|{turn}|{value}".encode()).hexdigest()[:15], 16)


def mixed(key: str, kind: str, left: int, right: int, left_size: int, right_size: int) -> tuple[int, int]:
    for turn in range(pii.ROUNDS):
        if turn % 2 == 0:
            left = (left + drawn(key, kind, turn, right) % left_size) % left_size
        else:
            right = (right + drawn(key, kind, turn, left) % right_size) % right_size
    return left, right


def test_addresses_and_dates_are_permuted_by_the_key_and_back(spark):
    """An independent network gives the same pseudonyms, and running it backward gives the values back."""
    values = [("ip", f"{a}.{b}.{c}.{d}") for a, b, c, d in ((1, 2, 3, 4), (255, 255, 255, 255), (10, 0, 0, 1))]
    rows = spark.createDataFrame([(k, f"x {v} y") for k, (_, v) in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(rows, "some key").collect()}
    for k, (_, value) in enumerate(values):
        a, b, c, d = map(int, value.split("."))
        left, right = mixed("some key", "ip", a * 256 + b, c * 256 + d, 65536, 65536)
        assert got[k].text == f"x {left // 256}.{left % 256}.{right // 256}.{right % 256} y" and got[k].n_ip == 1
        assert got[k].text_sha256 == hashlib.sha256(got[k].text.encode()).hexdigest()
        for turn in reversed(range(pii.ROUNDS)):
            if turn % 2 == 0:
                left = (left - drawn("some key", "ip", turn, right)) % 65536
            else:
                right = (right - drawn("some key", "ip", turn, left)) % 65536
        assert (left, right) == (a * 256 + b, c * 256 + d)
    dates = [(k, f"{y}-{m:02d}-{d:02d}") for k, (y, m, d) in enumerate(((1900, 1, 1), (2024, 2, 29), (2099, 12, 31), (1999, 7, 4)))]
    told = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(dates, "doc_id long, text string"), "some key").collect()}
    first = datetime.date(1900, 1, 1)
    for k, value in dates:
        n = (datetime.date.fromisoformat(value) - first).days
        while True:  # walking on while outside of the range
            left, right = mixed("some key", "date", n // pii.DAY_RIGHT, n % pii.DAY_RIGHT, pii.DAY_LEFT, pii.DAY_RIGHT)
            n = left * pii.DAY_RIGHT + right
            if n < pii.DAYS:
                break
        assert told[k] == (first + datetime.timedelta(days=n)).isoformat()


def test_the_key_is_in_no_plan(spark):
    rows = pii.pseudonymise(spark.createDataFrame([(1, "1.2.3.4 a@b.de 4111 1111 1111 1111")], "doc_id long, text string"), "the very secret key")
    assert rows.collect()[0].n_ip == 1
    assert "very secret" not in rows._jdf.queryExecution().toString() and "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        pii.pseudonymise(rows.select("doc_id", "text"), "")
