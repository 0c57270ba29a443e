import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from atalaya.llm import packing
from atalaya.llm.queries import tokenizer_files

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ENCODE = packing.encoder(*tokenizer_files())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1.,! \n\t  　\x1c\x85é漢'sſ|"))))
def test_encoder_equals_tokenizer(text):
    from tokenizers import Tokenizer

    t = test_encoder_equals_tokenizer.__dict__.setdefault("t", Tokenizer.from_file(P.path("byte_bpe_50k.json")))
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


END = "<|endoftext|>"


@cache
def unaltered():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", [END, END * 2, f"a {END} b", f"a{END}b c", f" {END} ", f"one two{END}\n\n{END} x  y", f"{END[:-1]} <{END}>", f"a <|ENDOFTEXT|> {END}s"])
def test_added_tokens_equal_tokenizer(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == unaltered().encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([END, "a", " ", "word", "<|", "|>", "\n", "é", "  b", "<"])).map("".join))
def test_added_tokens_anywhere(text):
    test_added_tokens_equal_tokenizer(text)


def best_fit_decreasing(counts, cap):
    """The textbook packer: each piece, longest first, goes where it leaves least room."""
    room = Counter()
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = min((g for g in room if g >= length and room[g]), default=cap)
            room[gap] -= gap in room and room[gap] > 0
            room[gap - length] += 1
    return sum(room.values())


def test_plan_uses_every_piece_once():
    rnd = random.Random(2)
    for trial in range(12):
        cap = rnd.choice([7, 64, 300])
        counts = defaultdict(int)
        for _ in range(rnd.randint(1, 500)):
            counts[rnd.randint(1, cap) if trial % 2 else min(cap, int(rnd.expovariate(6 / cap)) + 1)] += rnd.randint(1, 9)
        plan = packing.plan_sequences(dict(counts), cap)
        used = defaultdict(int)
        for pattern, times in plan:
            assert sum(pattern) <= cap
            for length in pattern:
                used[length] += times
        assert used == counts
        assert sum(times for _, times in plan) <= best_fit_decreasing(counts, cap) * 1.01 + 1


def test_exact_fillings():
    have = np.zeros(101, np.int64)
    have[[20, 30, 50]] = [2, 1, 1]
    dead = {2: set(), 3: set()}
    assert packing.fill_exactly(50, have, dead) == (50,) and packing.fill_exactly(80, have, dead) == (50, 30)
    assert packing.fill_exactly(90, have, dead) == (50, 20, 20) and packing.fill_exactly(60, have, dead) == ()
    assert packing.fill_exactly(40, have, dead) == (20, 20)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_round_trip(odd_docs, no_docs, reference, capacity):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(docs, *tokenizer_files(), capacity=capacity).toPandas()
    texts = {r.doc_id: reference(r.text or "") + [0] for r in docs.select("doc_id", "text").collect()}
    assert set(rows.id) == set(texts)
    for doc_id, own in rows.groupby("id"):
        own, at = own.sort_values("piece"), 0
        for k, r in enumerate(own.itertuples()):
            ids = texts[doc_id][at:at + r.length]
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(texts[doc_id])
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= capacity
    assert len(packing.pack_documents(odd_docs, *tokenizer_files(), capacity=capacity).toPandas()) > len(rows)  # repeated rows are packed too
    assert packing.pack_documents(no_docs, *tokenizer_files()).count() == 0
