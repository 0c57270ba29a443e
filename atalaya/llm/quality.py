"""Text quality by positive-unlabelled learning.

Trusted positives and unlabelled web texts are all it learns from. Two first networks, each fitted on
one half of the ids, tell positives from unlabelled texts; the share of positives among the latter
follows from how their scores of the other halves are distributed over all documents. A last network
then minimises the non-negative unbiased risk: what the unlabelled texts cost as negatives, less what the positives among them would, never below zero.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from atalaya.llm.common import drawn, fold, stored

BINS = 200


def features(text: str) -> list[float]:
    """Shares and averages that describe how a text is written, never what about."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    raw = text.encode()
    kinds = Counter(text)
    letters = sum(v for c, v in kinds.items() if c.isalpha())
    upper = sum(v for c, v in kinds.items() if c.isupper())
    digits = sum(v for c, v in kinds.items() if c.isdigit())
    marks = sum(kinds[c] for c in ".,;:'\"()-")
    blank = sum(v for c, v in kinds.items() if c.isspace())
    odd = chars - letters - digits - marks - blank
    p = np.fromiter(kinds.values(), float) / chars if kinds else np.ones(1)
    return [np.log1p(len(words)), letters / n, len(counts) / n, top / n, repeats / n, len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))), letters / chars, upper / max(1, letters), digits / chars, marks / chars, odd / chars,
            kinds["|"] / n, kinds["!"] / n, kinds["?"] / n, kinds["."] / n, kinds[","] / n,
            sum(kinds[c] for c in "%$&*#@^~=+<>{}[]\\/_") / n, float(-(p * np.log(p)).sum()),
            len(zlib.compress(raw, 1)) / max(1, len(raw)), np.log1p(max(map(len, words), default=0)),
            sum(v for w, v in counts.items() if len(w) <= 3) / n, sum(v for w, v in counts.items() if w[-1] in ".!?") / n,
            sum(v for w, v in counts.items() if w[0].isupper()) / n]


class Network:
    """One hidden layer on standardised features."""

    def __init__(self, sample: np.ndarray, hidden: int = 32, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = sample.mean(axis=0), sample.std(axis=0) + 1e-6
        self.parts = [rng.normal(0, sample.shape[1] ** -0.5, (sample.shape[1], hidden)), np.zeros(hidden),
                      rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return x, np.tanh(x @ self.parts[0] + self.parts[1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.parts[2] + self.parts[3][0]

    def fit(self, positive: np.ndarray, other: np.ndarray, slope, rounds: int = 400, rate: float = 0.02, decay: float = 1e-2) -> "Network":
        """Adam on the whole sample; `slope` turns the margins of both parts into derivatives of the risk."""
        x, n = np.concatenate([positive, other]), len(positive)
        mean, square = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        for step in range(1, rounds + 1):
            scaled, out = self.hidden(x)
            d = slope((out @ self.parts[2] + self.parts[3][0])[:n], (out @ self.parts[2] + self.parts[3][0])[n:])
            inner = np.outer(d, self.parts[2]) * (1 - out ** 2)
            grads = [scaled.T @ inner, inner.sum(axis=0), out.T @ d, np.array([d.sum()])]
            for p, g, m, s in zip(self.parts, grads, mean, square):
                g = g + decay * p
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
        return self


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def contrast(positive: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Slope of the logistic loss that tells positives from the other sample, both of equal weight."""
    return np.concatenate([(sigmoid(positive) - 1) / len(positive), sigmoid(other) / len(other)])


def non_negative(prior: float):
    """Slope of the non-negative unbiased risk with the logistic loss.

    Risk: prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)]). While the second part is negative
    its slope is turned round, which takes back what the network overfitted.
    """
    def slope(positive: np.ndarray, other: np.ndarray) -> np.ndarray:
        loss = lambda g: np.logaddexp(0, g)  # noqa: E731  of calling it negative
        sign = 1.0 if loss(other).mean() - prior * loss(positive).mean() >= 0 else -1.0
        own = prior * (sigmoid(positive) - 1) * (sign > 0) - sign * prior * sigmoid(positive)
        return np.concatenate([own / len(positive), sign * sigmoid(other) / len(other)])

    return slope


def class_prior(positive: np.ndarray, everything: np.ndarray, least: float = 0.3) -> float:
    """Largest share of positives that the counts over score bins allow, from the best-scored bins down.

    Any region holds at least prior x (its share of positives), so the least ratio over regions with
    at least `least` of the positives bounds the prior; a quarter of a standard deviation allows for noise.
    """
    p, u = positive[::-1].cumsum() / max(1, positive.sum()), everything[::-1].cumsum() / max(1, everything.sum())
    n = max(1, positive.sum())
    wide = p >= least
    ratio = (u + 0.25 * np.sqrt(u / max(1, everything.sum()))) / np.maximum(p - 0.25 * np.sqrt(p / n), 1e-9)
    return float(np.clip(ratio[wide].min() if wide.any() else 0.5, 0.05, 0.98))


def score_quality(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text",
                  positives: int = 10_000, unlabelled: int = 20_000) -> DataFrame:
    """(`id`, `score`, `predicted`) for every row of `docs`.

    The networks are fitted on about `positives` rows labelled 1 outside the held-out fold and about
    `unlabelled` documents (at most twice as many each); the class prior uses all documents. Labels of
    0 are never read. Rows without an id are scored but never learned from. Null and empty texts have
    the features of no words. Without a positive label every score is 0.5; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.float32()))], ["id", "x"])

    described = stored(rows.mapInArrow(describe, "id long, x array<float>"), "features")
    trusted = (labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").alias("quality"))
               .where((fold(F.col("id"), parts) != held) & (F.col("quality") == 1)).select("id").distinct())
    trusted = stored(drawn(trusted, "id", positives), "trusted")  # bounded by `positives`, so it may be broadcast

    def matrix(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Features and halves of a sample of bounded size."""
        got = sorted((r["id"], r["x"], r["half"]) for r in frame.collect())
        return np.array([x for _, x, _ in got], float).reshape(len(got), len(features(""))), np.array([h for *_, h in got], int)

    half = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(2)).cast("int")
    described = described.withColumn("half", half)
    p, p_half = matrix(described.join(F.broadcast(trusted), "id").limit(2 * positives))
    u, u_half = matrix(drawn(described.where("id is not null"), "id", unlabelled))
    if not len(p) or not len(u):
        return described.select("id", F.lit(0.5).alias("score"), F.lit(1).cast("int").alias("predicted"))

    def scored(networks: list[Network], frame: DataFrame) -> DataFrame:
        """Each row by the network of its half."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                score, own = np.zeros(batch.num_rows), batch.column("half").to_numpy()
                for k, network in enumerate(networks):
                    score[own == k] = sigmoid(network.margin(x[own == k])) if (own == k).any() else 0
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])

        return frame.mapInArrow(run, "id long, score double")

    # Scores of the rows that a network was fitted on would be too good: each half is scored by the other's.
    parts = [(p[p_half != k], u[u_half != k]) for k in (0, 1)]
    if not all(len(a) and len(b) for a, b in parts):
        parts = [(p, u), (p, u)]
    first = [Network(b).fit(a, b, contrast, rounds=200) for a, b in parts]
    spread, own = np.zeros(BINS), np.zeros(BINS)
    bins = scored(first, described).groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin"))
    for r in bins.agg(F.count(F.lit(1)).alias("n")).collect():
        spread[r["bin"]] = r["n"]
    for k, network in enumerate(first):
        own += np.bincount(np.minimum((sigmoid(network.margin(p[p_half == k])) * BINS).astype(int), BINS - 1), minlength=BINS)
    last = Network(u).fit(p, u, non_negative(class_prior(own, spread)))
    return scored([last, last], described).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
