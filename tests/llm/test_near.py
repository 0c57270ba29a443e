import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from atalaya.llm import simhash
from atalaya.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    digests = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(odd_docs):
    for r in odd_docs.select("text").collect():
        got = simhash.fingerprint((r.text or "").encode())
        assert got & (2 ** 64 - 1) == slow_print(r.text)


def test_pieces_do_not_matter(monkeypatch):
    text = " ".join(f"w{i * i % 71}" for i in range(500)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole


def flipped(rnd, fp, bits):
    for b in rnd.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_links_equal_brute_force(spark):
    """Isolated pairs at every distance, chains, and a dense group that takes the path of blocks."""
    rnd = random.Random(5)
    fps = set()
    for _ in range(150):
        base = rnd.getrandbits(64)
        fps |= {base, flipped(rnd, base, rnd.randint(1, 5))}
    for _ in range(10):
        base = rnd.getrandbits(64)
        for _ in range(12):
            fps.add(base)
            base = flipped(rnd, base, 3)
    hub = rnd.getrandbits(64)
    fps |= {flipped(rnd, hub, rnd.randint(0, 4)) for _ in range(300)}
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    signed = fps.view(np.int64).tolist()
    want = roots([(signed[i], signed[j]) for i, j in zip(*np.nonzero(near)) if i < j], signed)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for few, block in ((64, 2048), (8, 40), (1, 16)):
        links = simhash.near_links(df, few, block).distinct().collect()
        assert all(bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= 3 for r in links)
        assert roots([(r.a, r.b) for r in links], signed) == want, (few, block)


def test_components(spark):
    rnd = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(links, {n for link in links for n in link})
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_of_odd_documents(odd_docs, no_docs):
    rows = simhash.near_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.id: r.component_id for r in rows if r.id is not None}
    assert by_id[2] == by_id[1] == 1 and by_id[4] == by_id[5] == by_id[3] == 3  # texts without a word link
    assert simhash.near_classes(no_docs).count() == 0


def test_hot_copies(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(i, text if i % 2 else f"{text} tail{i % 40}") for i in range(600)] + [(1000 + i, f"other {i} text {i * i}") for i in range(50)]
    out = simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    prints = {i: slow_print(t) for i, t in rows}
    ids = sorted(prints)
    fps = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = roots([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i < j], ids)
    assert {r.id: r.component_id for r in out.collect()} == want
    digits = out.select("id", simhash.hex_digits(F.col("fp")).alias("x")).collect()
    assert all(r.x == f"{prints[r.id]:016x}" for r in digits)
