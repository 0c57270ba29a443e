"""Collocations against brute force."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from atalaya.llm import phrases

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def slow(rows, least, top, share=80, widest=4):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, widest + 1):
                counts[lang].update(tuple(words[k:k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s:s + m]] = max(longer[p[s:s + m]], a)
        for p, a in candidates.items():
            if longer[p] and 100 * longer[p] >= share * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, total[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, count):
    rnd = random.Random(seed)
    vocabulary = [rnd.choice(["", "É", "x"]) + "".join(rnd.choices("abcDe'-\x1f\xa0", k=rnd.randint(1, 4))) for _ in range(120)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    fixed = [" ".join(rnd.choices(vocabulary, k=rnd.randint(2, 5))) for _ in range(12)]
    rows = [("en", None), (None, None), ("de", ""), ("de", " \t .;"), (None, "the end. The End")]
    for _ in range(count):
        parts = []
        for _ in range(rnd.randint(1, 14)):
            parts.append(rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choices(vocabulary, weights)[0])
            parts.append(rnd.choices([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"], [12, 1, 1, 2, 1, 1, 1, 1])[0])
        rows.append((rnd.choice(["en", "en", "de", None]), "".join(parts)))
    return rows


@pytest.mark.parametrize("least,top,words,wide", [(30, 2000, 1 << 17, 1 << 20), (3, 40, 1 << 17, 1 << 20), (3, 5000, 25, 40), (3, 5000, 1 << 17, 30)])
def test_equals_brute_force(spark, least, top, words, wide):
    """Also where not all frequent words or phrases are numbered."""
    rows = corpus(least + words, 1500)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    got = phrases.collocations(docs, least=least, top=top, words=words, phrases=wide)
    assert sorted(map(tuple, got.collect())) == slow(rows, least, top)


def test_tiles(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(phrases, "DENSE", 500)
    left, right = (np.minimum(rng.zipf(1.3, 40_000), 1 << 20).astype(np.int64) for _ in range(2))
    cells, counts = phrases.tile_counts(left, right)
    want = Counter((left << 32 | right).tolist())
    assert len(cells) == len(want) and dict(zip(cells.tolist(), counts.tolist())) == want


def test_squares_in_parts(spark, monkeypatch):
    """Tiny buffers: counts are merged and flushed many times, long texts are read in parts."""
    monkeypatch.setattr(phrases, "CHUNK", 64)
    monkeypatch.setattr(phrases, "MERGED", 100)
    monkeypatch.setattr(phrases, "CELLS", 500)
    monkeypatch.setattr(phrases, "SENT", 3)
    monkeypatch.setattr(phrases.tokens, "__defaults__", (50,))
    rows = corpus(5, 300)
    rows.append(("en", " ".join(text or "" for _, text in rows)))
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(docs, least=3, top=100)
    assert sorted(map(tuple, got.collect())) == slow(rows, 3, 100)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    got = phrases.collocations(odd_docs, least=2, top=50).collect()
    assert sorted(map(tuple, got)) == slow(rows, 2, 50) and phrases.collocations(no_docs).count() == 0


def test_only_phrases_of_frequent_parts_are_spelled(spark, monkeypatch):
    """Beyond the numbered words a phrase is counted by its text only if its parts are frequent, but for chance hits of the bit map."""
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = [("en", " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(4000)], k=40))) for _ in range(1500)]
    sent, plain = {}, phrases.runs

    def watched(texts, numbers, width, parts):
        found = plain(texts, numbers, width, parts)
        runs = [phrases.zstandard.ZstdDecompressor().decompress(r.run) for r in found.where("part % 2 = 1").collect()]
        sent[width] = sum(int.from_bytes(run[:8], "little") for run in runs)
        return found

    monkeypatch.setattr(phrases, "runs", watched)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = phrases.collocations(docs, least=20, top=5000, words=50, phrases=40)
    assert sorted(map(tuple, got.collect())) == slow(rows, 20, 5000)
    counts = [Counter(tuple(words[k:k + m]) for words in (text.split() for _, text in rows) for k in range(len(words) - m + 1)) for m in range(1, 5)]
    for width in (2, 3, 4):
        shorter = counts[width - 2]
        able = sum(shorter[p[1:]] >= 20 and shorter[p[:-1]] >= 20 for p in counts[width - 1])
        assert sent[width] <= able + 0.2 * len(counts[width - 1]) < len(counts[width - 1]), width
    assert sent[2] > 0
