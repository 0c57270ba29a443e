"""The pipeline's near copies against brute-force Jaccard over five-word shingles."""

import random

import corpus_pipeline
import numpy as np
from atalaya.llm import common, jaccard
from test_near import WORD, roots

STAGES = dict(corpus_pipeline.STAGES)


def slow_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def edited(rnd, words, edits):
    words = list(words)
    for k in rnd.sample(range(len(words)), edits):
        words[k] = f"new{rnd.random()}"
    return words


def test_stage_equals_brute_force_jaccard(spark):
    """Copies with 0 to 12 edited words, chains of edits, texts of one to four words and unrelated ones."""
    rnd = random.Random(3)
    texts = ["one", "one", "one two three", "One  two three", "one two four", "", " "]
    for _ in range(60):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([12, 40, 120, 400]))]
        texts += [" ".join(base), " ".join(edited(rnd, base, rnd.randint(1, 12)))]
    for _ in range(6):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(150)]
        for _ in range(30):
            texts.append(" ".join(base))
            base = edited(rnd, base, 2)
    hub = [f"h{k}" for k in range(200)]
    texts += [" ".join(edited(rnd, hub, rnd.randint(1, 6))) for _ in range(60)]
    sets = dict(enumerate(map(slow_set, texts)))
    links, between = [], 0
    for a in sets:
        for b in range(a + 1, len(texts)):
            either = len(sets[a] | sets[b])
            share = len(sets[a] & sets[b]) / either if either else 1
            if share >= 0.8:
                links.append((a, b))
                between += share < 0.95
    assert between > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [r.doc_id for r in STAGES["near dedup"](spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(roots(links, sets).values()))


def test_one_row_of_a_component_stays(spark):
    """Near copies that all lack an id, or that share the smallest one, and a repeated row."""
    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:-1], "other"])
    other = near.replace("w", "v")
    rows = [(None, " ".join(base)), (None, near), (7, other), (7, other + " more"), (7, other), (9, other)]
    kept = STAGES["near dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["7", "None"]


def test_components_that_share_keys(spark, monkeypatch):
    """Many components in one key, in blocks of a few nodes and with hot keys: links across blocks and none too many."""
    rnd = random.Random(5)
    hub = [f"h{k}" for k in range(500)]
    texts = [" ".join(edited(rnd, hub, rnd.randint(2, 7))) for _ in range(150)]
    texts += [" ".join(edited(rnd, hub, rnd.randint(12, 15))) for _ in range(40)]
    sets = dict(enumerate(map(slow_set, texts)))
    links = [(a, b) for a in sets for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = set(roots(links, sets).values())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = common.meet
    monkeypatch.setattr(jaccard, "meet", lambda *a: plain(*a, least=20))
    kept = [r.doc_id for r in jaccard.drop_near_copies(docs, block=4).collect()]
    assert len(links) > 300 and len(want) > 20 and sorted(kept) == sorted(want)


def test_likely_pairs_equal_in_both_forms(spark):
    """The sketch test of the first round and that of the blocks let the same pairs pass."""
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(edited(rnd, base, rnd.randint(1, 20))) for _ in range(40)]
    rows = spark.createDataFrame([(i, i, i, bytearray(t, "utf8")) for i, t in enumerate(texts)], "id long, h1 long, h2 long, raw binary")
    nodes = common.stored(jaccard.sign(rows, 5), "t")
    own = {r.node: r for r in nodes.collect()}
    pairs = [(a, b) for a in own for b in own if a < b]
    got = {(r.a, r.b) for r in jaccard.likely(common.stored(spark.createDataFrame(pairs, "a long, b long"), "t"), nodes, 0.8).collect()}
    lanes = {n: np.array(r.sketch).view("<u2") for n, r in own.items()}
    want = {(a, b) for a, b in pairs if (lanes[a] == lanes[b]).sum() >= jaccard.ENOUGH and min(own[a].size, own[b].size) >= 0.8 * max(own[a].size, own[b].size)}
    assert got == want and 0 < len(want) < len(pairs)


def test_simhash_brings_pairs_together(spark, monkeypatch):
    """Without any MinHash key in common the pairs within three bits are still found and checked."""
    rnd = random.Random(8)
    texts = [" ".join(t) for k in range(30) for base in [[f"a{k}x{j}" for j in range(400)]] for t in (base, edited(rnd, base, 1), edited(rnd, base, 2))]
    rows = spark.createDataFrame([(i, i, i, bytearray(t, "utf8")) for i, t in enumerate(texts)], "id long, h1 long, h2 long, raw binary")
    nodes = common.stored(jaccard.sign(rows, 5), "t")
    fps = {r.node: r.fp % (1 << 64) for r in nodes.collect()}
    links = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = roots(links, fps)
    pairs = [tuple(sorted(r)) for r in jaccard.print_pairs(nodes).collect()]
    assert len(links) > 20 and roots(pairs, fps) == want
    nodes = common.stored(nodes.drop("bands").selectExpr("*", "array(node) AS bands"), "t")
    monkeypatch.setattr(jaccard, "sign", lambda *a: nodes)
    classes = {r.id: r.root for r in jaccard.near_classes(rows).collect()}
    assert len(texts) - len(set(classes.values())) == len(fps) - len(set(want.values()))


def test_odd_documents(odd_docs, no_docs):
    kept = jaccard.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    left = [r.doc_id for r in kept.select("doc_id").collect()]
    assert left.count(1) == 1 and not {2, 4, 5, None} & set(left) and {3, 8, 9, 10, 11, 12} <= set(left)
    assert jaccard.drop_near_copies(no_docs).count() == 0
