"""Repeated passages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from atalaya.llm import common, suffixes


def slow(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[k:k + least] for raw in raws for k in range(len(raw) - least + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - least + 1):
            if seen[raw[k:k + least]] > 1:
                gone[k + 1:k + least + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((len(raw), spans, bytes(b for b, g in zip(raw, gone[1:-1]) if not g)))
    return out


def texts_of(seed, least, count):
    """Copies, near copies, passages inside other texts, periods, runs of one letter and passages just short of `least`."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(least)[:rnd.randint(least - 3, 3 * least)] for _ in range(6)]
    texts = ["", None, "x" * (least - 1), "x" * least, "x" * (2 * least), "ab" * least, "y" * (least + 1)]
    for _ in range(count):
        base = prose(rnd.randint(1, least))
        texts.append(base)
        if rnd.random() < 0.3:
            texts.append(base)
        if rnd.random() < 0.4:
            at = rnd.randrange(len(base))
            texts.append(base[:at] + rnd.choice(["", "Z", "ZZ"]) + base[at + 1:])
        if rnd.random() < 0.6:
            texts.append(prose(rnd.randint(0, 30)) + rnd.choice(passages) + prose(rnd.randint(0, 30)) + rnd.choice(passages))
    return texts


@pytest.mark.parametrize("least,limit,piece,heat", [(200, 32_768, 1 << 20, 10_000), (24, 3, 64, 5), (1, 32_768, 1 << 20, 10_000), (9, 32_768, 50, 5)])
def test_equals_brute_force(spark, monkeypatch, least, limit, piece, heat):
    """Also with hot texts, hot grams, grams of too many stretches and texts of many pieces."""
    monkeypatch.setattr(suffixes, "PIECE", piece)
    plain = common.meet
    monkeypatch.setattr(suffixes, "meet", lambda *a: plain(*a, least=heat))
    texts = texts_of(least, least, 60) + ["a full table of copies " * 12] * (1100 if least == 24 else 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.drop_repeats(docs, least=least, limit=limit).collect()}
    want = slow(texts, least)
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert got[k] == want[k], (k, texts[k])


def test_radix_order():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, size=(300, 24), dtype=np.uint8) * (rng.random((300, 24)) < 0.3)
    rows[100:200] = rows[:100]
    groups = rng.integers(0, 4, 300)
    order, shared = suffixes.radix_order(groups, rows.view(">u8").astype(np.uint64))
    keyed = [(groups[k], rows[k].tobytes()) for k in order]
    assert keyed == sorted(keyed)
    for k in range(1, 300):
        same = 0
        while same < 24 and keyed[k][1][same] == keyed[k - 1][1][same]:
            same += 1
        assert shared[k] == (same if keyed[k][0] == keyed[k - 1][0] else -1)


def test_grams_in_one_task_over_many_batches(spark):
    """Groups of stretches that end inside a batch, at its end and go on over several."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choices("ab", k=40)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    plain = suffixes.compared
    try:
        suffixes.compared = lambda parts, least: plain(parts, least, 10)
        got = {r.id: [tuple(s) for s in r.spans] for r in suffixes.drop_repeats(docs, least=12).collect()}
    finally:
        suffixes.compared = plain
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: w[1] for k, w in enumerate(slow(texts, 12))}


def test_odd_rows(spark, odd_docs, no_docs):
    out = suffixes.drop_repeats(odd_docs, least=20).collect()
    assert len(out) == odd_docs.count() and suffixes.drop_repeats(no_docs).count() == 0
    sizes = {len((r.text or "").encode()) for r in odd_docs.collect()}
    assert {r.n_bytes for r in out} == sizes
    assert [r.spans for r in out if r.id == 1] == [[(0, 61)]] * 2
