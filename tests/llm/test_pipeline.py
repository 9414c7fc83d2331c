"""The corpus pipeline against its decisions taken one by one."""

from __future__ import annotations

import corpus_pipeline as P
from framequarry.llm import bpe, decontaminate, langid, secrets, simhash
from framequarry.llm.common import table


def test_stages_equal_decisions_by_hand(spark, small):
    docs = table(spark, small, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    network = langid.learnt(docs)
    keep = {r.doc_id for r in langid.identify(docs, network).collect() if r.lang_pred != "und"}
    prints = {d: simhash.fingerprint(simhash.shingle_hashes(rows[d].text)) for d in keep}
    up = {d: d for d in keep}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(keep)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    keep = [d for d in ids if root(d) == d]
    bench = [(str(r.item_id), decontaminate.words_of(r.text)) for r in table(spark, small, "benchmark").collect()]
    _, spans, _ = decontaminate.Phrases(bench).in_shard([rows[d].text for d in keep])
    keep = [d for d, s in zip(keep, spans) if not s]
    coder = bpe.text_coder(*bpe.default_ranks())
    want = {(d, coder.encode(secrets.redact(rows[d].text, secrets.scan(rows[d].text)[1]))) for d in keep}
    got = {(r.doc_id, bytes(r.ids)) for r in P.run(spark, small).collect()}
    assert got == want and 0 < len(got) < len(rows)


def test_stages_return_the_columns_of_documents(spark, small):
    docs = table(spark, small, "documents")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, small).dtypes == docs.dtypes, name


def test_repeated_rows_and_nulls(spark, small):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15), (1, "some words here", "en", "s", 15), (2, None, None, None, None), (3, "12 34", "en", "s", 5), (4, "token = abcdefgh1", "en", "s", 17)], kinds)
    assert [r.doc_id for r in P.near_dups(spark, docs, small).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    masked = {r.doc_id: r for r in P.mask_secrets(spark, docs, small).collect()}
    assert masked[4].text == "[SECRET]" and masked[4].n_chars == 8 and masked[2].text is None
    assert sorted(r.doc_id for r in P.language(spark, docs, small).collect()) == [1, 1, 4]
    assert P.benchmark(spark, docs, small).count() == 5


def test_rows_that_share_an_id_are_told_apart(spark, small):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c, d, e = (" ".join(f"{name}{k}" for k in range(60)) for name in ("apple", "brick", "cloud", "dune", "ember"))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (None, c), (None, d), (None, d), (None, e), (4, e), (4, None), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", t and len(t)) for k, t in rows], kinds)
    got = sorted(((r.doc_id, r.text) for r in P.near_dups(spark, docs, small).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (None, d), (4, e), (4, None)], key=str)
