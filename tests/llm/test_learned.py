"""Held-out accuracy of the learned operators, and defined results for odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atalaya.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held(rows, parts, fold):
    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % parts == fold]


def checked(spark, name, label, sf=SF):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    out = queries.QUERIES[name](spark, sf)
    rows = out.join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    return [r for r in rows if r[label] is not None]


def test_toxicity(spark):
    """Most held-out toxic texts are found (87 of 97 when this was written), and of those found nine in ten are toxic."""
    rows = checked(spark, "op4_toxicity", "toxic", "/root/testdata/sf0.1")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = held(rows, 5, 0)
    hits = sum(r.predicted and r.toxic for r in own)
    assert hits >= 0.88 * sum(r.toxic for r in own) and hits >= 0.9 * sum(r.predicted for r in own)


def test_toxicity_of_few_labels(spark):
    own = held(checked(spark, "op4_toxicity", "toxic"), 5, 0)
    assert sum(r.predicted != r.toxic for r in own) <= 0.03 * len(own)
    assert not any(r.predicted and not r.toxic for r in own)


def test_break_even():
    margin, toxic = np.array([3.0, 2.0, 2.0, 1.0, -4.0, -4.0, -4.0]), np.array([1, 1, 0, 1, 1, 0, 0])
    assert toxicity.break_even(margin, toxic) == -1.5
    assert toxicity.break_even(margin, toxic * 0) == 0.0
    assert toxicity.break_even(margin, np.array([0, 0, 0, 1, 0, 0, 1])) == 2.5  # both rows at 2 would be one too many
    assert toxicity.break_even(np.zeros(5), np.ones(5)) == 0.0 and toxicity.break_even(np.zeros(0), np.zeros(0)) == 0.0


def test_quality(spark):
    rows = checked(spark, "op6_pu_quality", "quality")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    own = held(rows, 3, 1)
    assert sum(r.predicted != r.quality for r in own) <= 0.08 * len(own)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op7_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = held(rows, 3, 1)
    assert own and all(r.held_out for r in own) and sum(r.lang_pred != r.lang for r in own) <= 0.02 * len(own)


def test_code_switching():
    """Words of two invented languages; transitions keep a passage together."""
    rng = np.random.default_rng(4)
    word = lambda part: "".join(rng.choice(part, 4))
    say = {"x": lambda n: " ".join(word(list("abcd")) for _ in range(n)), "y": lambda n: " ".join(word(list("wxyz")) for _ in range(n))}
    crf = langid.fit([(say[lang](80), lang) for lang in "xy" for _ in range(30)], ["x", "y"])
    text = say["x"](12) + " " + say["y"](8)
    scores = langid.word_scores(text.split(), crf.weights)
    shares = langid.forward_backward(scores, np.array([20]), crf.moves)
    assert shares[:12, 0].min() > 0.9 and shares[12:, 1].min() > 0.9 and np.allclose(shares.sum(axis=1), 1)


def test_training_reads_texts_to_their_end(spark):
    """Each language shows its own words only behind an opening of 400 words that both share."""
    rng = np.random.default_rng(9)
    say = lambda part, n: " ".join("".join(rng.choice(list(part), 5)) for _ in range(n))
    opening = say("mnop", 400)
    docs = spark.createDataFrame([(i, f"{opening} {say('abcd' if i % 2 else 'wxyz', 400)}", "xy"[i % 2]) for i in range(60)],
                                 "doc_id long, text string, lang string")
    for bound in (5000, 200):
        crf = langid.train(docs, per_label_passages=bound)
        for part, lang in (("abcd", 1), ("wxyz", 0)):
            words = say(part, 20).split()
            assert (langid.word_scores(words, crf.weights).argmax(axis=1) == lang).mean() > 0.9
    places = [r.place for r in langid.passages(docs.withColumnRenamed("doc_id", "id")).collect()]
    assert sorted(places) == sorted(60 * list(range(20)))


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    lengths, moves = np.array([1, 4, 3]), rng.normal(size=(3, 3))
    scores, got, pairs = rng.normal(size=(8, 3)), None, np.zeros((3, 3))
    got = langid.forward_backward(scores, lengths, moves, pairs)
    at, expected = 0, np.zeros((3, 3))
    for n in lengths:
        total, want = 0.0, np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[at + t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += p
        for path in product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[at + t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))) / total
            for t, k in enumerate(path):
                want[t, k] += p
            for a, b in zip(path, path[1:]):
                expected[a, b] += p
        assert np.allclose(got[at:at + n], want)
        at += n
    assert np.allclose(pairs, expected)


def test_label_model_finds_accuracies():
    """Three good voters, one that copies the first and one that is noise."""
    rng = np.random.default_rng(6)
    truth = rng.random(20_000) < 0.2
    fires = [np.where(truth, rng.random(20_000) < hit, rng.random(20_000) < miss) for hit, miss in ((0.8, 0.02), (0.7, 0.05), (0.6, 0.01))]
    fires += [fires[0] ^ (rng.random(20_000) < 0.02), rng.random(20_000) < 0.02]
    codes = sum(f.astype(int) << k for k, f in enumerate(fires))
    patterns = dict(zip(*[x.tolist() for x in np.unique(codes, return_counts=True)]))
    post, learned = toxicity.label_model(patterns, 5)
    assert abs(learned["prior"] - 0.2) < 0.06
    assert learned["weight"][0] < learned["weight"][1] and learned["weight"][3] < learned["weight"][2]
    # Close to the best that the three independent voters allow if everything about them is known.
    odds = np.log(0.2 / 0.8) + sum(np.where(f, np.log(hit / miss), np.log((1 - hit) / (1 - miss)))
                                   for f, (hit, miss) in zip(fires, ((0.8, 0.02), (0.7, 0.05), (0.6, 0.01))))
    best = np.mean((odds > 0) == truth)
    assert np.mean((np.array([post[c] for c in codes]) > 0.5) == truth) > best - 0.02
    assert toxicity.label_model({}, 5)[0] == {}


def test_class_prior():
    rng = np.random.default_rng(2)
    good, bad = rng.beta(6, 2, 50_000), rng.beta(2, 6, 50_000)
    bins = lambda x: np.histogram(x, quality.BINS, (0, 1))[0]
    for share in (0.3, 0.6, 0.85):
        mixed = np.concatenate([good[:int(40_000 * share)], bad[:int(40_000 * (1 - share))]])
        assert abs(quality.class_prior(bins(good), bins(mixed)) - share) < 0.07


def test_risk_turns_back_when_negative():
    assert (quality.non_negative(0.9)(np.full(4, 3.0), np.full(4, 3.0))[4:] > 0).all()
    assert (quality.non_negative(0.9)(np.full(4, 9.0), np.full(4, -9.0))[4:] < 0).all()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 1 - i % 2) for i in range(1, 13)] + [(None, 1, 1), (5, None, None), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_documents(odd_docs, no_docs, labels):
    n = odd_docs.count()
    for scored in (toxicity.score_toxicity(odd_docs, labels), quality.score_quality(odd_docs, labels)):
        rows = scored.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    none = labels.where("false")
    assert {r.score for r in quality.score_quality(odd_docs, none).collect()} == {0.5}
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(odd_docs, none).collect())
    assert toxicity.score_toxicity(no_docs, labels).count() == 0 and quality.score_quality(no_docs, labels).count() == 0


def test_odd_languages(odd_docs, no_docs):
    tagged = langid.tag(odd_docs, langid.train(odd_docs))
    assert tagged.columns == [c for c in odd_docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    rows = {r.doc_id: r for r in tagged.select("doc_id", "text", "lang_pred", "score").collect() if r.doc_id}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 10))
    assert rows[11].lang_pred in ("en", "de", "fr") and rows[12].lang_pred != "und"
    assert {r.lang_pred for r in langid.tag(odd_docs, langid.train(no_docs)).collect()} == {"und"}
    assert langid.tag(no_docs, langid.train(odd_docs)).count() == 0
    assert tagged.where(F.col("doc_id").isNull()).count() == 3
