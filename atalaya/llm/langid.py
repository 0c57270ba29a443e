"""Language identification with a linear-chain conditional random field over words.

Each word is labelled with a language. Its score sums learned weights of its affixes (character
n-grams that touch a word boundary), inner n-grams and its lexicon entry, all hashed; learned
transitions join neighbouring words, and forward-backward gives every word its probabilities. A text's
language is the one with most letters, in expectation; code-switched passages keep their own labels.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from atalaya.llm.common import fold, stored

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
UNDETERMINED = "und"
CACHE_WORDS = 150_000
CHUNK_WORDS = 120_000


@dataclass(frozen=True)
class Crf:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    moves: np.ndarray  # labels x labels, log scale


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in one array, and where each word's begin: 2- to 4-grams of "^word$" and the word."""
    raw = [b"^" + word.encode() + b"$" for word in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes, sizes) - np.arange(len(data))  # bytes up to the word's end
    owner = np.repeat(np.arange(len(raw)), sizes)
    hashed, owners = [np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))], [np.arange(len(raw))]
    code = data * np.uint32(0x9E3779B1) + np.uint32(1)
    for n in range(2, 5):
        code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + data[n - 1:] * np.uint32(0xC2B2AE3D) + np.uint32(n)
        inside = left[:len(code)] >= n
        hashed.append(code[inside])
        owners.append(owner[:len(code)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    mixed = np.concatenate(hashed)[order]
    mixed = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x45D9F3B)
    counts = np.bincount(owners, minlength=len(raw))
    return ((mixed >> np.uint32(8)) % np.uint32(BUCKETS)).astype(np.int32), np.cumsum(counts) - counts


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    features, begin = word_features(words)
    return np.add.reduceat(weights[features], begin, axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every word. `scores` holds chain after chain; all chains advance together.

    `pairs`, if given, gets the expected number of each transition added.
    """
    chains = np.argsort(-lengths, kind="stable")
    sizes, first = lengths[chains], (np.cumsum(lengths) - lengths)[chains]
    steps = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, steps + 1))
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    go = np.exp(moves - moves.max())
    ahead = np.empty_like(emit)
    for t in range(steps):
        at = first[:active[t]] + t
        now = emit[at] if t == 0 else emit[at] * (ahead[at - 1] @ go)
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    back = np.ones((len(sizes), emit.shape[1]))
    out = np.empty_like(emit)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        now = ahead[at] * back[:n]
        out[at] = now / now.sum(axis=1, keepdims=True)
        if t:
            behind = emit[at] * back[:n]
            if pairs is not None:
                joint = ahead[at - 1][:, :, None] * go[None] * behind[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            before = behind @ go.T
            back[:n] = before / before.sum(axis=1, keepdims=True)
    return out


def fit(texts: list[tuple[str, str]], labels: list[str], chain_words: int = 120, pieces: int = 3, rounds: int = 40,
        rate: float = 0.3, decay: float = 1e-5, seed: int = 11) -> Crf:
    """Maximum likelihood by Adam, on chains that join passages of several texts so that moves are learned too."""
    rng = np.random.default_rng(seed)
    span = chain_words // pieces
    parts = []
    for text, label in texts:
        words = WORD.findall(text.lower())
        parts += [(words[k:k + span], labels.index(label)) for k in range(0, len(words), span)]
    parts = [parts[k] for k in rng.permutation(len(parts))]
    words, gold, lengths = [], [], []
    for k in range(0, len(parts), pieces):
        chain = parts[k:k + pieces]
        words += [w for piece, _ in chain for w in piece]
        gold += [label for piece, label in chain for _ in piece]
        lengths.append(sum(len(piece) for piece, _ in chain))
    crf = Crf(labels, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    if not words:
        return crf
    lengths, gold = np.array(lengths), np.array(gold)
    kinds, ids = np.unique(np.array(words, object), return_inverse=True)
    features, begin = word_features(list(kinds))
    size = np.diff(np.append(begin, len(features)))
    wanted = np.eye(len(labels))[gold]
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen = np.zeros_like(crf.moves)
    np.add.at(seen, (gold[at - 1], gold[at]), 1)

    state = {"w": [crf.weights, np.zeros_like(crf.weights), np.zeros_like(crf.weights)],
             "m": [crf.moves, np.zeros_like(crf.moves), np.zeros_like(crf.moves)]}
    for step in range(1, rounds + 1):
        pairs = np.zeros_like(crf.moves)
        scores = np.stack([np.add.reduceat(crf.weights[features, k], begin) for k in range(len(labels))], axis=1)[ids]
        error = wanted - forward_backward(scores, lengths, crf.moves, pairs)
        by_kind = np.stack([np.bincount(ids, error[:, k], len(kinds)) for k in range(len(labels))], axis=1)
        push = np.stack([np.bincount(features, np.repeat(by_kind[:, k], size), BUCKETS) for k in range(len(labels))], axis=1) / len(gold)
        for name, grad in (("w", push - decay * crf.weights), ("m", (seen - pairs) / len(gold) - decay * crf.moves)):
            value, mean, square = state[name]
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            value += rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return crf


def passages(rows: DataFrame, size: int = 40) -> DataFrame:
    """(`id`, `lang`, `place`, `words`): all passages of `size` words of each text, to its end; the last may be shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column("text")):  # a batch for each text, so that long ones do not add up
                words = WORD.findall(text.as_py().lower())
                own = [" ".join(words[k:k + size]) for k in range(0, len(words), size)]
                same = np.full(len(own), row)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(same)), batch.column("lang").take(pa.array(same)),
                                                  pa.array(np.arange(len(own))), pa.array(own, pa.string())], ["id", "lang", "place", "words"])

    kinds = {field.name: field.dataType.simpleString() for field in rows.schema.fields}
    return rows.select("id", "lang", "text").mapInArrow(run, f"id {kinds['id']}, lang string, place long, words string")


def sampled(values: DataFrame, key: list[str], at_most: int) -> DataFrame:
    """About `at_most` rows of each `lang`, drawn by a hash of `key`; all if there are no more."""
    counts = {r["lang"]: r["n"] for r in values.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return values
    chance = F.element_at(F.create_map(*[F.lit(x) for lang in sorted(counts) for x in (lang, min(1.0, at_most / counts[lang]))]), F.col("lang"))
    return values.where(F.pmod(F.xxhash64(*key), F.lit(1_000_003)) < chance * 1_000_003)


def train(docs: DataFrame, per_label: int = 300, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", parts: int = 3, held: int = 1, per_label_passages: int = 5000) -> Crf:
    """Fit on about `per_label` labelled texts of each language, drawn by a hash of the id, from start to end.

    The tasks cut the texts into passages of 40 words. All count if a language has at most
    `per_label_passages`; of more, about that many (at most twice as many in all) are drawn by a hash of
    id, place and words, with one chance for every place in a text. Only rows outside the held-out fold
    and with an id, a text and a language count. No such row: no label.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where((fold(F.col("id"), parts) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not labels:
        return Crf([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    cut = stored(passages(sampled(known, ["id"], per_label)), "passages")
    drawn = sampled(cut, ["id", "place", "words"], per_label_passages).limit(2 * per_label_passages * len(labels))
    # A sample of bounded size; sorted, so the fit does not depend on the order of arrival.
    rows = sorted((r["id"], r["lang"], r["place"], r["words"]) for r in drawn.toLocalIterator())
    return fit([(words, lang) for _, lang, _, words in rows], labels)


def tag(docs: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with `lang_pred` and `score` (the share of letters it covers, in expectation).

    A null text, or one without a letter, is `und` with score 0; so is every text if no label was
    learned. Input columns of these two names are replaced. Nothing shuffles.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    place = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.zeros((0, len(crf.labels)), np.float32)
        for batch in batches:
            if len(known) > CACHE_WORDS:
                known, table = {}, table[:0]
            texts = batch.column(place)
            best, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            order = np.argsort(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), kind="stable")
            rows_in, words, lengths, count = [], [], [], 0

            def finish() -> None:
                nonlocal table, rows_in, words, lengths, count
                if not rows_in:
                    return
                fresh = list({w for own in words for w in own if w not in known})
                known.update(zip(fresh, range(len(table), len(table) + len(fresh))))
                table = np.concatenate([table, word_scores(fresh, crf.weights)])
                ids = np.fromiter((known[w] for own in words for w in own), np.int64, count)
                letters = np.fromiter((len(w) for own in words for w in own), np.float64, count)
                sizes = np.array(lengths)
                shares = forward_backward(table[ids], sizes, crf.moves) * letters[:, None]
                shares = np.add.reduceat(shares, np.cumsum(sizes) - sizes, axis=0)
                top = shares.argmax(axis=1)
                score[rows_in] = shares[np.arange(len(top)), top] / shares.sum(axis=1)
                for row, k in zip(rows_in, top):
                    best[row] = crf.labels[k]
                rows_in, words, lengths, count = [], [], [], 0

            for row in order.tolist() if crf.labels else []:
                text = texts[row].as_py()
                own = WORD.findall(text.lower()) if text else []
                if not any(map(str.isalpha, own)) and not any(c.isalpha() for w in own for c in w):
                    continue
                rows_in.append(row)
                words.append(own)
                lengths.append(len(own))
                count += len(own)
                if count >= CHUNK_WORDS:
                    finish()
            finish()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(np.clip(score, 0, 1))],
                                             schema=pa.schema([*batch.schema, ("lang_pred", pa.string()), ("score", pa.float64())]))

    return rows.mapInArrow(run, schema)
