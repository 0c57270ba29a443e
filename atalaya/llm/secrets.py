"""Secret scans: three fixed patterns, and strings that look random to character Markov models.

Two first-order models are trained from samples that the corpus labels itself: the values that the
patterns match are random strings; all else is ordinary. Runs with a digit or a capital inside are left
out at first and labelled by a first judgement: those it takes for ordinary are counted too. Every run of token characters outside the pattern matches is judged. Its parts
between "=" and "/" score their log-likelihood ratio less `per_char` a character; a stretch of parts that
no longer or shorter one betters is a secret if its ratio in all passes a threshold too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base patterns and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs are maximal, so this is AKIA[A-Z0-9]+ of 16 or more
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "markov"]
LEAST_VALUE = 8

LEAST_RUN = 8
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
OPEN = re.compile("[0-9]|[A-Za-z][A-Z]")
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
OTHER = len(TOKEN_CHARS)  # the class of every other byte, which also stands before and after a string
STATES = OTHER + 1
CLASS_OF = np.full(256, OTHER, np.int64)
CLASS_OF[np.frombuffer(TOKEN_CHARS.encode(), np.uint8)] = np.arange(OTHER)
RUN_OF = np.where(CLASS_OF == TOKEN_CHARS.index("."), OTHER, CLASS_OF)  # a dot ends a run
PIECE = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base matches, sorted; leftmost and non-overlapping within a kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def outside(spans: list[tuple[int, int, int]], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The (start, end) of `runs`, which come in order, that touch none of the sorted spans."""
    free, next_span, reach = [], 0, 0
    for start, end in runs:
        while next_span < len(spans) and spans[next_span][0] < end:
            reach = max(reach, spans[next_span][2])
            next_span += 1
        if reach <= start:
            free.append((start, end))
    return free


def write_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def steps(raw: bytes) -> np.ndarray:
    """How often each class of character follows each other one."""
    out = np.zeros(STATES * STATES, np.int64)
    for start in range(0, len(raw), PIECE):
        code = CLASS_OF[np.frombuffer(raw[start:start + PIECE + 1], np.uint8)]
        out += np.bincount(code[:-1] * STATES + code[1:], minlength=len(out))
    return out


def values_of(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """What the patterns match. The value of an assignment is what stands behind its last separator or quote."""
    return [re.split(r"[\"'\x20:=]+", text[s:e], maxsplit=1)[-1] if kind == 0 else text[s:e] for s, kind, e in spans]


def maximal(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring stretches (first, last) of a list of numbers, in linear time (Ruzzo and Tompa)."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum with, first, last, next to look at
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first, look = at, len(found) - 1
        while True:
            while look >= 0 and found[look][0] >= before:
                look = found[look][4]
            if look < 0 or found[look][1] >= total:
                break
            before, first = found[look][0], found[look][2]
            del found[look:]
            look -= 1
        found.append((before, total, first, at, look))
    return [(first, last) for _, _, first, last, _ in found]


def best_parts(run: bytes, step: np.ndarray, least: float, per_char: float) -> list[tuple[int, int]]:
    """(start, end) of the secrets in a run; `step` has the ratio of the step into each character and out of the run."""
    code = np.frombuffer(run, np.uint8)
    cut = np.flatnonzero((code == ord("=")) | (code == ord("/")))
    starts = np.unique(np.concatenate([[0], cut, cut + 1]))
    starts = starts[starts < len(run)]
    ends = np.append(starts[1:], len(run))
    own = step[:-1].copy()
    own[-1] += step[-1]
    stretches = maximal(np.add.reduceat(own - per_char, starts).tolist())
    out = []
    for i, j in [(int(starts[first]), int(ends[last])) for first, last in stretches]:
        while i < j and run[i] in b"=/":
            i += 1
        while i < j and run[j - 1] in b"=/":
            j -= 1
        ratio = own[i:j].sum()
        if j - i >= LEAST_RUN and ratio >= least and ratio >= per_char * (j - i):
            rest = run[j:]
            out.append((i, len(run) if rest in (b"=", b"==") else j))  # the padding of base64 belongs to it
    if not out and own.sum() >= max(least, per_char * len(run)):
        out.append((0, len(run)))
    return out


def secrets_of(text: str, spans: list[tuple[int, int, int]], table: np.ndarray, least: float, per_char: float) -> list[tuple[int, int]]:
    """(start, end), in code points, of what the models take for secrets outside the sorted `spans`."""
    raw = text.encode()
    code = RUN_OF[np.frombuffer(b" " + raw + b" ", np.uint8)]
    edge = np.flatnonzero(np.diff(code != OTHER))
    starts, ends = edge[::2], edge[1::2]  # in bytes of the text
    long = ends - starts >= LEAST_RUN
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return []
    step = table[code[:-1], code[1:]]
    # No part of a run has a higher ratio than the sum of its positive steps.
    total = np.concatenate([[0.0], np.cumsum(np.maximum(step, 0))])
    likely = total[ends + 1] - total[starts] >= least - 1e-6
    starts, ends = starts[likely].tolist(), ends[likely].tolist()
    if not starts:
        return []
    if len(raw) == len(text):
        runs = list(zip(starts, ends))
    else:
        letters = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        runs = list(zip(letters[starts].tolist(), letters[ends].tolist()))
    at = dict(zip(runs, starts))
    out = []
    for run in outside(spans, runs):
        start, size = at[run], run[1] - run[0]
        out += [(run[0] + i, run[0] + j) for i, j in best_parts(raw[start:start + size], step[start:start + size + 1], least, per_char)]
    return out


def count_steps(rows: DataFrame, table: np.ndarray | None, least: float, per_char: float) -> tuple[np.ndarray, np.ndarray]:
    """Steps between classes in ordinary text and in the values matched.

    What `table` takes for secrets counts for neither; without a table, no run that may be one does.
    Each task sends its sums, so at most 2 * STATES ** 2 rows come back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            for value in batch.column("text"):
                text = value.as_py()
                counts[0] += steps(b" " + text.encode() + b" ")
                spans = base_spans(text)
                for string in values_of(text, spans):
                    own = steps(b" " + string.encode() + b" ")
                    counts[0] -= own
                    counts[1] += own
                if table is None:
                    left = outside(spans, [m.span() for m in RUN.finditer(text) if OPEN.search(m.group())])
                else:
                    left = secrets_of(text, spans, table, least, per_char)
                for s, e in left:
                    counts[0] -= steps(b" " + text[s:e].encode() + b" ")
        kind, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[kind, step])],
                                         ["kind", "step", "n"])

    out = np.zeros((2, STATES * STATES), np.int64)
    for r in rows.select("text").mapInArrow(run, "kind int, step int, n long").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect():
        out[r["kind"], r["step"]] = r["n"]
    return np.maximum(out[0], 0), out[1]


def ratios(ordinary: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each step.

    The labelled secrets may all share one alphabet, such as hex digits, and the next one another:
    half of the random model's probability is spread evenly over all characters. Behind characters
    that ordinary text rarely has, its model falls back on how frequent each character is.
    """
    def smoothed(counts: np.ndarray) -> np.ndarray:
        counts = counts.reshape(STATES, STATES)
        single = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * STATES)
        return (counts + 5 * single) / (counts.sum(axis=1, keepdims=True) + 5)

    return np.log(0.5 * smoothed(random) + 0.5 / STATES) - np.log(smoothed(ordinary))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 12.0, per_char: float = 0.6) -> DataFrame:
    """(`id`, `n_assign`, `n_access`, `n_hex`, `n_markov`, `base`, `spans`) for every row of `docs`.

    `base` and `spans` list kind:start:end in code points, end exclusive, by start and then kind. Both
    models are counted over all documents; the ordinary one in two rounds. A null text is empty and has no spans; a null id stays null; repeated rows are
    scanned each for itself; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = ratios(*count_steps(rows, None, least, per_char))
    # Digits and signs stand mostly in runs without a label yet, so the first judgement goes by the other steps.
    signs = CLASS_OF[np.frombuffer(b"0123456789+/_.=-", np.uint8)]
    first[signs], first[:, signs] = 0, 0
    table = ratios(*count_steps(rows, first, least, per_char))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every, counts = [], [], [[], [], [], []]
            for value in batch.column("text"):
                text = value.as_py()
                spans = base_spans(text)
                more = [(s, 3, e) for s, e in secrets_of(text, spans, table, least, per_char)]
                base.append(write_spans(spans))
                every.append(write_spans(spans + more))
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in spans + more))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int64()) for c in counts],
                                              pa.array(base, pa.string()), pa.array(every, pa.string())],
                                             ["id", "n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    return rows.mapInArrow(
        judge, "id long, n_assign long, n_access long, n_hex long, n_markov long, base string, spans string")
