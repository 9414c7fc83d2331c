"""The Merkle manifest, the quality rules and importance resampling against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from framequarry.llm import divergence, merkle, resample
from framequarry.llm.common import table
from framequarry.llm.queries import llm_queries
from framequarry.llm.sql import llm_sql

from .test_operators import awkward

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- the Merkle manifest ----------------------------------------------------------------------


def brute_tree(digests):
    """The root over a list, and the siblings of each entry, level by level."""
    paths, level, place = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for k, j in enumerate(place):
            run = level[j // 16 * 16 :][:16]
            paths[k].append((run[: j % 16], run[j % 16 + 1 :]))
        place = [j // 16 for j in place]
        level = [sha(*level[a : a + 16]) for a in range(0, len(level), 16)]
    return level[0] if level else None, paths


def brute_manifest(rows):
    leaf = lambda *v: sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    groups = {}
    for d, text, lang, source, n in rows:
        lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        changed = lower if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else text
        groups.setdefault(source, []).append((d, leaf(d, source, lang, n, text), leaf(d, source, lang, n, changed)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subtrees = []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subtrees.append(brute_tree([r[1] for r in groups[name]]))
    root, tops = brute_tree([sub for sub, _ in subtrees])
    out = []
    for name, (sub, paths), top in zip(names, subtrees, tops, strict=True):
        for (d, own, tampered), path in zip(groups[name], paths, strict=True):
            folded = tampered
            for left, right in path + top:
                folded = sha(*left, folded, *right)
            out.append((d, own, sub, root, sha(*(x for left, right in path + top for x in left + right)), folded, folded == root))
    return sorted(out, key=repr)


def random_rows(seed: int, n: int):
    rng = random.Random(seed)
    names = ["big"] * 12 + ["b", "é", "", None] + [f"s{k}" for k in range(30)]
    rows = [(k if rng.random() < 0.97 else None, rng.choice(["Ab", "xé Q", "", "lower", None]), rng.choice(["en", None]), rng.choice(names), rng.choice([k, None])) for k in range(n)]
    rows += rows[:20]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "merged"), [(1500, 2), (1, 64), (0, 64)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, merged):
    monkeypatch.setattr(merkle, "MERGED", merged)
    rows = random_rows(n, n)
    got = merkle.verify_tampered(spark.createDataFrame(rows, KINDS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)


def test_stretches_merge_to_the_same_nodes_wherever_they_are_cut():
    rng = random.Random(7)
    for n in (2, 15, 16, 17, 255, 256, 257, 700, 4097):
        digests = [sha(str(k)) for k in range(n)]
        whole = merkle.Mountains("g", n)
        for k, digest in enumerate(digests):
            whole.add(0, k, digest)
        whole.close()
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(9))})
        nodes, peaks = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = merkle.Mountains("g", n)
            for k in range(a, b):
                part.add(0, k, digests[k])
            part.close()
            nodes, peaks = nodes + part.nodes, peaks + part.peaks
        top = merkle.Mountains("g", n)
        for peak in sorted(peaks, key=lambda p: p[1] * 16 ** p[0]):
            top.add(*peak)
        top.close()
        assert sorted(nodes + top.nodes) == sorted(whole.nodes) and top.peaks == whole.peaks == [(whole.top, 0, brute_tree(digests)[0])]


def test_a_published_proof_leads_to_the_root(spark):
    rows = random_rows(3, 300)
    for r in merkle.manifest(spark.createDataFrame(rows, KINDS)).collect():
        digest = r.leaf
        for level in r.proof:
            digest = sha(level.left, digest, level.right)
        assert digest == r.root


# -- importance resampling --------------------------------------------------------------------


def brute_resample(docs, target):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = lambda w: [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]
    have, want = Counter(), Counter()
    for _, t in docs:
        have.update(found(words(t)))
    for _, t in target:
        want.update(found(words(t)))
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((have[b] + 1) * (t + 10000))))
    rows = []
    for d, text in docs:
        w = words(text)
        f = found(w)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"7:{'' if d is None else d}")[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((*r[:4], ranks[r].pop() if ranks.get(r) and r[4] >= 20 else None) for r in rows), key=repr)


def test_resampling_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    pool = ["Alpha", "beta", "gamma9", "déjà", "x" * 90, "The", "of", "中文", "a-b"]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choices(pool, k=rng.randint(0, 60)))
    docs = [(k, text()) for k in range(300)] + [(k, "the same text of " * 9) for k in range(300, 400)] + [(400, None), (401, ""), (402, " . "), (403, "word " * 20_000)]
    target = [(f"i{k}", "beta gamma9 " * k) for k in range(5)] + [("n", None)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(target, "item_id string, text string")
    expected = brute_resample(docs, target)
    assert sorted(map(tuple, resample.resample(*frames).collect()), key=repr) == expected
    monkeypatch.setattr(resample, "HOT_SHARE", 0.1)  # all but the copies go through the exchange
    assert sorted(map(tuple, resample.resample(*frames).collect()), key=repr) == expected


def test_drawn_texts_come_along(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * 25) for k in range(40)], "doc_id long, text string")
    rows = resample.resample(docs, docs.where("doc_id < 3"), share_percent=10, keep=("text",)).where("rank is not null").collect()
    assert sorted(r.rank for r in rows) == [1, 2, 3, 4] and all(r.text.startswith(f"word{r.doc_id} ") for r in rows)


def test_features_across_texts_and_long_words():
    import pyarrow as pa

    texts = ["end", "start", None, "", "A " + "y" * 200, "été", "b"]
    found, words, starts = resample.buckets(pa.array(texts))
    expected = [["end"], ["start"], [], [], ["a", "y" * 200, "a " + "y" * 200], ["été"], ["b"]]
    assert words.tolist() == [1, 1, 0, 0, 2, 1, 1]
    assert [sorted(found[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)] == [sorted(zlib.crc32(x.encode()) % 10000 for x in e) for e in expected]


# -- quality rules ----------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def brute_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(SPACE):
            dups += line in seen
            seen.add(line)
    n, r = len(words), len(again)
    return words, (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, r, n < 50 or 100 * r > 50 * n)


def brute_classes(text):
    of = lambda c: (
        "vowel" if c in "aeiou" else "consonant" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "blank" if c == " "
        else "line end" if c in SPACE else "stop" if c == "." else "mark" if c in ",;:'\"-()" else "call" if c in "!?" else "symbol" if ord(c) < 128 else "beyond ascii"
    )
    counts = Counter(map(of, text))
    return [counts[c] for c in divergence.CLASSES]


def brute_distance(p, q):
    def kl(a, m):
        return sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)

    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    middle = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, (kl(p, middle) + kl(q, middle)) / 2))


def brute_rules(rows):
    """rows: doc_id, text, lang."""
    measured = [(d, *brute_measures(t), t or "", lang) for d, t, lang in rows]
    usable = [(words, text, lang) for _, words, m, text, lang in measured if lang is not None and not m[-1]]
    often = Counter(lang for *_, lang in usable)
    known = sorted(lang for lang in often if often[lang] * 1000 >= len(usable))
    references = {}
    for lang in known:
        mine = [(words, brute_classes(text)) for words, text, name in usable if name == lang]
        rough = [sum(c) for c in zip(*(c for _, c in mine), strict=True)]
        bins = [math.floor(brute_distance(c, rough) * 1000) for _, c in mine]
        near = [c for (_, c), b in zip(mine, bins, strict=True) if 2 * sum(x < b for x in bins) < len(bins)]
        counts = Counter(w for words, _ in mine for w in words)
        top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:64]
        references[lang] = [sum(c) for c in zip(*near, strict=True)], top, [counts[w] for w in top] + [0] * (64 - len(top)) + [sum(counts.values()) - sum(counts[w] for w in top)]
    out = {}
    for d, words, m, text, _ in measured:
        kept, best = not m[-1], None
        for lang in known if kept else ():
            chars, top, reference = references[lang]
            mine = Counter(words)
            shares = [mine[w] for w in top] + [0] * (64 - len(top)) + [len(words) - sum(mine[w] for w in top)]
            far = brute_distance(brute_classes(text), chars), brute_distance(shares, reference)
            if best is None or sum(far) < sum(best):
                best = far
        if best:
            kept = not ((len(text) >= 800 and best[0] > 0.16) or best[1] > 0.30 + 1 / math.sqrt(len(words)))
        out[d] = (*m, kept, best)
    return out


def test_rules_equal_brute_force_on_the_table(spark, small):
    docs = table(spark, small, "documents")
    expected = brute_rules([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    rows = divergence.judge_quality(docs).collect()
    assert len(rows) == len(expected)
    for r in rows:
        *measures, kept, far = expected[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (*measures, kept)
        assert far is None or np.allclose((r.char_distance, r.word_distance), far, atol=1e-6)


def test_rules_keep_clean_documents_and_drop_junk(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    rows = divergence.judge_quality(docs).where("not base_failed").join(labels, "doc_id").collect()
    share = lambda q: np.mean([r.kept for r in rows if r.quality == q])
    assert share(1) > 0.99 and share(0) < 0.1


def test_measures_of_odd_texts():
    odd = ["", " \n ", "a b c a b c", "a a a a", "x\n\nx\n x\nx", "é 中 # *\x0b|", "a b c d", "one two three one two", "﻿b\x85c"]
    for text in odd:
        of = divergence.measure(np.frombuffer(text.encode(), np.uint8))
        words, expected = brute_measures(text)
        assert (len(of.words), of.word_chars, of.symbols, of.dup_lines, of.repeated, of.failed) == expected
        assert of.chars.tolist() == brute_classes(text)


# -- all three --------------------------------------------------------------------------------


def test_awkward_rows(spark):
    docs = awkward(spark)
    target = spark.createDataFrame([("i", "one two", 1)], "item_id string, text string, key int")
    n = docs.count()
    assert merkle.verify_tampered(docs).count() == n
    rows = {r.doc_id: r for r in resample.resample(docs, target).collect()}
    assert rows[0].n_features == rows[1].n_features == 0 and rows[0].weight == 0
    judged = divergence.judge_quality(docs).collect()
    assert len(judged) == n and all(not r.kept for r in judged if r.n_words < 50)
    assert len(resample.resample(docs, target).collect()) == n


def test_empty_tables(spark):
    none = spark.createDataFrame([], KINDS)
    target = spark.createDataFrame([], "item_id string, text string")
    assert merkle.verify_tampered(none).collect() == [] and divergence.judge_quality(none).collect() == [] and resample.resample(none, target).collect() == []
    one = spark.createDataFrame([(1, "word " * 60 + "unlike " * 3, None, None, None)], KINDS)
    assert len(resample.resample(one, target).collect()) == 1 and divergence.judge_quality(one).first().ref_lang is None


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_quality_rules", "op13_importance_resampling"])
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{small}/{view}.parquet')")
    df = llm_queries()[name](spark, small)
    result = con.execute(llm_sql()[name])
    order = [df.columns.index(c[0]) for c in result.description]
    assert sorted((tuple(r[k] for k in order) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)
