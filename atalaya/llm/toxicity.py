"""Toxicity by weak supervision.

Many voters look at a text: a lexicon of insults, lexicons of words and of word beginnings mined from
labelled rows, and a pattern. A generative label model estimates from the votes on all documents,
without labels, how often each voter fires on toxic and on clean texts and how voters correlate; one
that repeats what others say counts for less. Its posterior probabilities are the labels on which a
linear classifier over the lexicon entries is trained. As those are cautious, the labelled rows move
the classifier's intercept to where it takes about as many of them for toxic as are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from atalaya.llm.common import drawn, fold, stored

WORD = re.compile(r"[^\W\d_]+")
INSULTS = frozenset("idiot stupid moron loser scum trash pathetic worthless clown disgusting dumb garbage".split())
SPLITS = {"w": 3, "4": 2, "5": 2, "6": 2}  # voters of each kind of mined entry
DENSE = (2, 4)  # pattern voters: so many different words with an entry
VOTERS = 1 + sum(SPLITS.values()) + len(DENSE)


def mine(sample: DataFrame, size: int, least: int = 6, log_odds: float = 2.5) -> list[tuple[str, str]]:
    """At most `size` entries (kind, string) that mark toxic texts: words, and beginnings of 4 to 6 letters.

    `sample` has `text` and `toxic`. Equal texts count once. An entry needs `least` toxic texts and
    smoothed log-odds of `log_odds`; the strongest come first, ties by name.
    """
    once = sample.groupBy(F.sha2(F.lower("text").cast("binary"), 256).alias("h")).agg(F.max(F.struct("toxic", "text")).alias("r"))
    once = once.select("r.toxic", F.array_distinct(F.regexp_extract_all(F.lower("r.text"), F.lit(r"\p{L}+"), F.lit(0))).alias("words"))
    begin = lambda n: F.array_distinct(F.transform(F.filter("words", lambda w: F.length(w) > n),
                                                   lambda w: F.concat(F.lit(str(n)), F.substring(w, 1, n))))
    entries = F.concat(F.transform("words", lambda w: F.concat(F.lit("w"), w)), begin(4), begin(5), begin(6))
    once = stored(once.select("toxic", entries.alias("entries")), "entries")
    totals = once.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    toxic, clean = totals["t"], totals["n"] - totals["t"]
    odds = (F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1)))
    rows = (once.select("toxic", F.explode("entries").alias("entry")).groupBy("entry")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where(F.col("t") >= least)
            .withColumn("odds", odds).where(F.col("odds") >= log_odds)
            .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "entry").limit(size).collect())
    return [(r["entry"][0], r["entry"][1:]) for r in rows]


def votes_of(text: str, places: dict[str, dict[str, int]]) -> tuple[list[int], int]:
    """Lexicon entries found in a text, by their place, and the voters that fire as bits of a number."""
    words = set(WORD.findall(text.lower()))
    found, marked, bits = set(), set(), int(not INSULTS.isdisjoint(words))
    base = 1
    for kind, count in SPLITS.items():
        known = places[kind]
        own = words & known.keys() if kind == "w" else {w for w in words if len(w) > int(kind) and w[:int(kind)] in known}
        marked |= own
        for place in {known[w if kind == "w" else w[:int(kind)]] for w in own}:
            found.add(place)
            bits |= 1 << base + place % count
        base += count
    for k, least in enumerate(DENSE):
        bits |= (len(marked) >= least) << base + k
    return sorted(found), bits


def voter_correlations(fires: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How much more two voters agree than the class they both see explains, from 0 to 1.

    If nothing but the class tied voters together, their covariance would be a product of one number
    for each. Three voters i, j, k give the square of i's number as c_ij c_ik / c_jk. Ties between
    voters can only raise it, so a low quantile over all pairs is taken; what a covariance has beyond
    the product of both numbers is correlation.
    """
    voters, n = fires.shape[1], max(count.sum(), 1.0)
    off = fires - (count @ fires) / n
    cov = (off * count[:, None]).T @ off / n
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    sure = np.abs(cov) > 3 * np.outer(scale, scale) / np.sqrt(n)
    own = np.zeros(voters)
    for i in range(voters):
        squares = [cov[i, j] * cov[i, k] / cov[j, k] for j in range(voters) for k in range(j) if i not in (j, k) and sure[j, k]]
        own[i] = np.sqrt(max(0.0, np.quantile(squares, 0.25, method="lower"))) if squares else 0.0
    extra = np.abs(cov - np.outer(own, own)) / np.outer(scale, scale) * sure
    np.fill_diagonal(extra, 0)
    return np.minimum(extra, 1)


def label_model(patterns: dict[int, int], voters: int = VOTERS, rounds: int = 60) -> tuple[dict[int, float], dict]:
    """Probability that a text with each vote pattern is toxic; what was learned about the voters.

    Expectation-maximisation over two classes. A voter's evidence is divided by one plus its
    correlations with the others, so voters that repeat each other count about once together.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, {}
    fires = np.array([[p >> v & 1 for v in range(voters)] for p in keys], float)
    count = np.array([patterns[p] for p in keys], float)
    tied = voter_correlations(fires, count)
    weight = 1 / (1 + tied.sum(axis=1))
    post = np.where(fires.sum(axis=1) > 0, 0.9, 0.01)
    for _ in range(rounds):
        mass = np.stack([count * (1 - post), count * post])
        rate = (mass @ fires + np.array([[0.01], [0.5]])) / (mass.sum(axis=1, keepdims=True) + 1)
        # A voter is never better than certain, and never fires more on clean texts than on toxic ones.
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        rate[0] = np.minimum(rate[0], rate[1])
        prior = np.clip(mass[1].sum() / count.sum(), 1e-6, 0.5)
        evidence = fires @ (weight * np.log(rate[1] / rate[0])) + (1 - fires) @ (weight * np.log((1 - rate[1]) / (1 - rate[0])))
        post = 1 / (1 + np.exp(-np.clip(evidence + np.log(prior / (1 - prior)), -50, 50)))
    return dict(zip(keys, post.tolist())), {"prior": prior, "fires": rate, "correlation": tied, "weight": weight}


def fit_linear(rows: list[tuple[list[int], float]], size: int, rounds: int = 200, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights of the entries and, last, the intercept; each target is a probability."""
    weights = np.zeros(size + 1)
    if not rows:
        weights[-1] = -3.0
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(found) for found, _ in rows])
    found = np.array([k for own, _ in rows for k in own], np.int64)
    target = np.array([p for _, p in rows])
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        margin = np.bincount(owner, weights[found], len(rows)) + weights[-1]
        error = target - 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        push = np.append(np.bincount(found, error[owner], size), error.sum()) / len(rows) - decay * weights
        mean += 0.1 * (push - mean)
        square += 0.01 * (push * push - square)
        weights += rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return weights


def margins(weights: np.ndarray, found: list[list[int]]) -> np.ndarray:
    owner = np.repeat(np.arange(len(found)), [len(own) for own in found])
    return np.bincount(owner, weights[np.array([k for own in found for k in own], np.int64)], len(found)) + weights[-1]


def break_even(margin: np.ndarray, toxic: np.ndarray) -> float:
    """The lowest cut, between two margins, above which lie no more rows than are toxic; 0 without a toxic row.

    Rows of one margin stay together, so a margin that too many share, such as that of texts without
    any entry, lies below the cut. If even the highest does, the cut stays at 0.
    """
    values, counts = np.unique(margin, return_counts=True)
    above = np.cumsum(counts[::-1])[::-1]
    taken = np.flatnonzero(above <= toxic.sum())
    if not len(taken) or taken[0] == 0:
        return 0.0
    return float((values[taken[0] - 1] + values[taken[0]]) / 2)


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text",
                   sample: int = 20_000, lexicon: int = 1_500) -> DataFrame:
    """(`id`, `score`, `predicted`) for every row of `docs`.

    About `sample` labelled rows outside the held-out fold (at most twice as many) are used to mine at
    most `lexicon` entries and to fit the classifier; votes are counted over all documents. Rows
    without an id are scored but never learned from. A null or empty text has no entries and gets the
    score of the intercept. Without a toxic label all scores are low. An empty table gives no rows.
    Repeated rows are scored alike and texts of any length whole; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where((fold(F.col("id"), parts) != held) & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = stored(drawn(known, "id", sample), "labelled")  # bounded by `sample`, so it may be broadcast
    entries = mine(rows.join(F.broadcast(known), "id").select("text", "toxic"), lexicon)
    places: dict[str, dict[str, int]] = {kind: {} for kind in SPLITS}
    for place, (kind, entry) in enumerate(entries):
        places[kind][entry] = place

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [votes_of(t.as_py(), places) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([f for f, _ in seen], pa.list_(pa.int32())), pa.array([v for _, v in seen], pa.int64())],
                ["id", "found", "votes"])

    looked = stored(rows.mapInArrow(look, "id long, found array<int>, votes long"), "votes")
    patterns = {r["votes"]: r["n"] for r in looked.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= 2 ** VOTERS
    posterior, _ = label_model(patterns)
    chosen = looked.join(F.broadcast(known), "id").select("id", "found", "votes", "toxic")
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "votes", "found").limit(2 * sample)  # binds only where ids repeat
    fitted = sorted((r["id"], r["found"], r["votes"], r["toxic"]) for r in chosen.collect())
    weights = fit_linear([(found, posterior[votes]) for _, found, votes, _ in fitted], len(entries))
    weights[-1] -= break_even(margins(weights, [f for _, f, _, _ in fitted]), np.array([t for *_, t in fitted]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            sizes = np.diff(found.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            margin = np.bincount(owner, weights[found.flatten().to_numpy()], batch.num_rows) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             ["id", "score", "predicted"])

    return looked.select("id", "found").mapInArrow(judge, "id long, score double, predicted int")
