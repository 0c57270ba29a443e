import hashlib
import string
from collections import defaultdict

import pytest

from atalaya.llm.exact_dedup import exact_dedup

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(FOLD)].append(i)
    return {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("words", [1, 1 << 10])
def test_groups_and_one_row_stays(odd_docs, words):
    """A filter of 64 slots sends every row the long way; the result is the same."""
    out = exact_dedup(odd_docs, filter_words=words)
    assert [c for c in odd_docs.columns if c != "kept"] == out.columns[:len(odd_docs.columns) - 1]
    rows = out.select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256").collect()
    want = brute((r.doc_id, r.text) for r in odd_docs.collect())
    assert len(rows) == odd_docs.count()
    stays = defaultdict(list)
    for r in rows:
        assert r.text_sha256 == hashlib.sha256((r.text or "").translate(FOLD).encode()).hexdigest()
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
        if r.kept:
            stays[r.text_sha256].append(r.doc_id)
    assert {k: [v[0]] for k, v in want.items()} == dict(stays)


def test_hot_group(spark):
    df = spark.createDataFrame([(i, "Copy" if i % 3 else f"own {i}") for i in range(3000)], "doc_id long, text string").repartition(7)
    rows = exact_dedup(df).where("kept").collect()
    assert len(rows) == 1001 and {r.group_size for r in rows if r.doc_id % 3} == {2000}
    assert [r.doc_id for r in rows if r.doc_id % 3] == [2999]


def test_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0
