"""Collocations: phrases of two to `widest` words that occur far more often than their parts.

Words that occur often enough are numbered by frequency, the most frequent first. A pair of neighbours
is then a cell of a large square, which is cut into tiles: a tile that a task meets often is counted with
a dense bincount, the pairs of the other tiles as sorted coordinates. Frequent pairs are numbered by
frequency in their turn, and (pair, next word) is a cell of the next square, and so on: a phrase can only
be frequent if both phrases that are one word shorter are.

Numbers are known to the tasks for the `words` most frequent words and the `phrases` most frequent
phrases of a width; these bounds keep what is broadcast small. Of the frequent phrases beyond the bounds
the tasks know a bit map of hashes: a phrase with such a part is counted by its text, but only where both
phrases that are one word shorter are numbered or in the map. What the map lets through by chance is
counted and found to be rare.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from atalaya.llm.common import stored, temporary, unpack
from atalaya.operators.serve import global_rank

#: Upper case becomes lower case, so that A is free to stand for the ends of pieces; a tab is a space.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"A" * 10 + b" ")
STOP = b"A"
SIDE = 10  # bits of a tile's side
DENSE = 1 << (2 * SIDE - 4)  # pairs that make a tile of a task dense
CHUNK = 1 << 19  # bytes of a text taken at once; pairs counted at once
UNKNOWN = -1
STOPPED = -2  # in place of a word's number at the end of a piece
MERGED = 1 << 20  # counts of cells that a task holds
HELD = 100_000  # counts of words or spelled phrases that a task holds
SENT = 1 << 15  # rows sent at once
CELLS = 1 << 21  # words of the table for each part of the cells
ROWS_READ = 512  # texts read at once
MOST_BITS = 28  # a bit map has at most 2^28 bits (32 MB)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens(raw: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text with `STOP` at the ends of pieces, in parts that end at an end of a piece."""
    raw = raw.translate(FOLD)
    start = 0
    while start < len(raw):
        stop = raw.find(STOP, start + chunk)
        stop = len(raw) if stop < 0 else stop
        yield raw[start:stop].replace(STOP, b" A ").split(b" ")
        start = stop


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts reach the tasks of jobs run inside the block in small batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS_READ))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells (left << 32 | right) and how often each occurs."""
    tile = (left >> SIDE) << 32 | (right >> SIDE)
    order = np.argsort(tile)
    cut = np.flatnonzero(np.diff(tile[order], prepend=-1))
    sizes = np.diff(np.append(cut, len(tile)))
    cells, counts = [], []
    for start, size in zip(cut[sizes >= DENSE].tolist(), sizes[sizes >= DENSE].tolist()):
        own = order[start:start + size]
        low = (1 << SIDE) - 1
        times = np.bincount((left[own] & low) << SIDE | (right[own] & low))
        found = np.flatnonzero(times)
        corner_left, corner_right = left[own[0]] & ~low, right[own[0]] & ~low
        cells.append((corner_left + (found >> SIDE)) << 32 | (corner_right + (found & low)))
        counts.append(times[found])
    sparse = order[np.repeat(sizes < DENSE, sizes)]
    found, times = np.unique(left[sparse] << 32 | right[sparse], return_counts=True)
    return np.concatenate([*cells, found]), np.concatenate([*counts, times])


class Squares:
    """Counts of cells, merged when too many chunks have been added."""

    def __init__(self) -> None:
        self.cells, self.counts, self.left, self.right, self.waiting = [], [], [], [], 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left.append(left)
        self.right.append(right)
        self.waiting += len(left)
        if self.waiting >= CHUNK:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            cells, counts = tile_counts(np.concatenate(self.left), np.concatenate(self.right))
            self.cells.append(cells)
            self.counts.append(counts)
        self.left, self.right, self.waiting = [], [], 0

    def _merge(self) -> None:
        if len(self.cells) > 1:
            cells, counts = np.concatenate(self.cells), np.concatenate(self.counts)
            order = np.argsort(cells)
            cells = cells[order]
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            self.cells, self.counts = [cells[first]], [np.add.reduceat(counts[order], first)]

    def full(self) -> bool:
        if sum(map(len, self.cells)) < MERGED:
            return False
        self._merge()
        return len(self.cells[0]) >= MERGED // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._count()
        self._merge()
        found = (self.cells[0], self.counts[0]) if self.cells else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.cells, self.counts = [], []
        return found


def hashes(lang: np.ndarray | int, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases from the crc32 of their language and, word by word, of their words."""
    found = np.uint64(lang) if isinstance(lang, int) else lang
    for word in words:
        found = (found ^ word) * FACTOR
        found = found ^ (found >> np.uint64(29))
    return found


class Marks:
    """A bit map of hashes, 64 bits to a cell: it holds all that were put in and few others."""

    def __init__(self, bits: int, at: np.ndarray, cells: np.ndarray) -> None:
        self.bits = bits
        self.cells = np.zeros(1 << (bits - 6), np.uint64)
        self.cells[at] = cells.view(np.uint64)

    def hold(self, found: np.ndarray) -> np.ndarray:
        slot = found >> np.uint64(64 - self.bits)
        return (self.cells[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def marks(rows: DataFrame) -> Marks | None:
    """The bit map of the phrases (`lang`, `phrase`), all of one width; none if there are none. 16 bits a phrase, up to `MOST_BITS`."""
    count = rows.count()
    if not count:
        return None
    bits = min(MOST_BITS, max(12, (16 * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                langs = np.array([crc32(lang.encode()) for lang in batch.column("lang").to_pylist()], np.uint64)
                words = [[crc32(word) for word in phrase.encode().split(b" ")] for phrase in batch.column("phrase").to_pylist()]
                slot = hashes(langs, list(np.array(words, np.uint64).T)) >> np.uint64(64 - bits)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64))], ["slot"])

    slots = rows.select("lang", "phrase").mapInArrow(run, "slot long")
    cells = slots.groupBy(F.expr("slot >> 6").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("cell")).toArrow()
    return Marks(bits, cells.column("at").to_numpy(), cells.column("cell").to_numpy())


class Numbers:
    """Numbers of words and phrases. `squares[w]` holds the sorted cells of the numbered phrases of w + 2 words, and their numbers;
    `others` marks the frequent phrases of the last width that have no number."""

    def __init__(self, words: dict[str, dict[bytes, int]], squares: list[tuple[np.ndarray, np.ndarray]], others: Marks | None) -> None:
        self.words, self.squares, self.others = words, squares, others

    def of(self, lang: str, own: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.get(lang, {STOP: STOPPED}).get, own, repeat(UNKNOWN)), np.int64, len(own))

    def widened(self, words: np.ndarray) -> np.ndarray:
        """The number of the widest known phrase width at each place, from the numbers of words."""
        phrase = words
        for width, (cells, numbers) in enumerate(self.squares, 1):
            left, right = phrase[:len(words) - width], words[width:]
            cell = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
            at = np.minimum(np.searchsorted(cells, cell), max(0, len(cells) - 1))
            phrase = np.where(cells[at] == cell, numbers[at], UNKNOWN) if len(cells) else np.full(len(cell), UNKNOWN)
        return phrase

    def unnumbered(self, lang: str, own: list[bytes], words: np.ndarray, phrase: np.ndarray, width: int) -> np.ndarray:
        """Places of phrases of `width` words within pieces that may be frequent though a phrase one word shorter has no number."""
        coded = np.fromiter(map(crc32, own), np.uint64, len(own))
        maybe = phrase >= 0
        blank = np.flatnonzero(~maybe)
        maybe[blank] = self.others.hold(hashes(crc32(lang.encode()), [coded[blank + k] for k in range(width - 1)]))
        ends = np.concatenate([[0], np.cumsum(words == STOPPED)])
        return np.flatnonzero(maybe[:-1] & maybe[1:] & ((phrase[:-1] < 0) | (phrase[1:] < 0)) & (ends[width:] == ends[:-width]))


class Spelled:
    """Counts of phrases by their text (phrase, line end, language), merged when too many have been added."""

    def __init__(self) -> None:
        self.waiting, self.table = [], None

    def add(self, sent: bytes) -> None:
        n = int.from_bytes(sent[:8], "little")
        sizes, counts = np.frombuffer(sent, np.int64, 2 * n, 8).reshape(2, -1)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(sent[8 + 16 * n:])])
        self.waiting.append(pa.table({"text": texts, "a": counts}))
        if sum(t.num_rows for t in self.waiting) > max(HELD, self.table.num_rows if self.table else 0):
            self._merge()

    def _merge(self) -> None:
        parts = self.waiting if self.table is None else [self.table, *self.waiting]
        if parts:
            self.table = pa.concat_tables(parts).group_by("text").aggregate([("a", "sum")]).rename_columns({"a_sum": "a"}).select(["text", "a"])
        self.waiting = []

    def take(self, least: int) -> tuple[list[bytes], list[int]]:
        self._merge()
        if self.table is None:
            return [], []
        found = self.table.filter(pc.field("a") >= least)
        self.table = None
        return found.column("text").to_pylist(), found.column("a").to_pylist()

    @staticmethod
    def packed(texts: list[bytes], counts: list[int]) -> bytes:
        return np.array([len(texts), *map(len, texts), *counts], np.int64).tobytes() + b"".join(texts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(`lang`, `phrase`, `a`) of all words of (`lang`, `raw`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def answer() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()),
                                                  pa.array(list(own.values()), pa.int64())], ["lang", "phrase", "a"])

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw")):
                own = held.setdefault(lang, Counter())
                for part in tokens(raw.as_py()):
                    own.update(part)
                del own[STOP], own[b""]
                if sum(map(len, held.values())) > HELD:
                    yield from answer()
                    held = {}
        yield from answer()

    return texts.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def runs(texts: DataFrame, numbers, width: int, parts: int) -> DataFrame:
    """Sorted runs (`part`, `run`) of what occurs in the texts, compressed: in part 2 p the cells of phrases of `width` words
    whose two shorter phrases are numbered, in part 2 p + 1 the texts of the others that may be frequent; p < `parts`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, squares, spelled = numbers.value, Squares(), Counter()
        press = zstandard.ZstdCompressor(level=1)

        def cells_out() -> Iterator[pa.RecordBatch]:
            cells, counts = squares.take()
            part = ((cells.view(np.uint64) * FACTOR) >> np.uint64(32)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order], prepend=-1))
            for at in range(0, len(cut), SENT):
                few = cut[at:at + SENT + 1]
                own = [order[x:y] for x, y in zip(few, np.append(few[1:], len(order)))][:SENT]
                sent = [press.compress(np.diff(cells[x], prepend=0).tobytes() + counts[x].tobytes()) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(2 * part[order][cut[at:at + SENT]]), pa.array(sent, pa.binary())], ["part", "run"])

        def spelled_out() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list[bytes]] = {}
            for text in sorted(spelled):
                dealt.setdefault(crc32(text) % parts, []).append(text)
            keys = list(dealt)
            for at in range(0, len(keys), SENT):
                sent = [press.compress(Spelled.packed(dealt[k], [spelled[t] for t in dealt[k]])) for k in keys[at:at + SENT]]
                yield pa.RecordBatch.from_arrays([pa.array([2 * k + 1 for k in keys[at:at + SENT]]), pa.array(sent, pa.binary())], ["part", "run"])
            spelled.clear()

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw")):
                for own in tokens(raw.as_py()):
                    own = [word for word in own if word]
                    if len(own) < width:
                        continue
                    words = known.of(lang, own)
                    phrase = known.widened(words)
                    left, right = phrase[:-1], words[width - 1:]
                    good = (left >= 0) & (phrase[1:] >= 0)
                    squares.add(left[good], right[good])
                    if known.others is not None:
                        end = b"\n" + lang.encode()
                        spelled.update(b" ".join(own[k:k + width]) + end for k in known.unnumbered(lang, own, words, phrase, width).tolist())
                if squares.full():
                    yield from cells_out()
                if len(spelled) > HELD:
                    yield from spelled_out()
        yield from cells_out()
        yield from spelled_out()

    return texts.mapInArrow(run, "part long, run binary")


def phrase_counts(texts: DataFrame, numbers, width: int, least: int, parts: int) -> DataFrame:
    """The phrases of `width` words with a >= `least`: as (`left`, `right`, `a`) where their two shorter phrases are numbered,
    as (`lang`, `phrase`, `a`) otherwise. Each of `parts` parts of the cells and of the texts is merged in one place."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, squares, spelled = None, Squares(), Spelled()

        def answer() -> Iterator[pa.RecordBatch]:
            cells, counts = squares.take()
            cells, counts = cells[counts >= least], counts[counts >= least]
            n = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array(cells >> 32), pa.array(cells & 0xFFFFFFFF), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
                                              pa.array(counts, pa.int64())], names)
            texts, times = spelled.take(least)
            n = len(texts)
            both = [text.decode().split("\n", 1) for text in texts]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([g for _, g in both], pa.string()),
                                              pa.array([p for p, _ in both], pa.string()), pa.array(times, pa.int64())], names)

        for batch in batches:
            for part, sent in zip(batch.column("part").to_pylist(), batch.column("run")):
                if part != current:
                    yield from answer()
                    current = part
                if part % 2:
                    spelled.add(unpack(sent))
                    continue
                both = np.frombuffer(unpack(sent), np.int64).reshape(2, -1)
                squares.cells.append(np.cumsum(both[0]))
                squares.counts.append(both[1])
                squares.full()  # merges what has come when it is much
        yield from answer()

    names = ["left", "right", "lang", "phrase", "a"]
    sent = runs(texts, numbers, width, parts).repartition("part").sortWithinPartitions("part")
    return stored(sent.mapInArrow(merge, "left long, right long, lang string, phrase string, a long"), "counts", keep=True)


def numbered(frequent: DataFrame) -> DataFrame:
    """`frequent` with `id`, from 0, the most frequent first."""
    return global_rank(frequent, [F.desc("a"), "lang", "phrase"], "id").withColumn("id", F.col("id") - 1)


def frequent_phrases(texts: DataFrame, least: int, widest: int, words: int, phrases: int) -> tuple[DataFrame, DataFrame]:
    """(`lang`, `phrase`, `width`, `a`) of the phrases of (`lang`, `raw`) with a >= `least`, and (`lang`, `n`), the words of each language."""
    spark = texts.sparkSession
    with temporary(spark), small_batches(spark):
        counts = stored(word_counts(texts), "words")
        totals = stored(counts.groupBy("lang").agg(F.sum("a").alias("n")), "totals", keep=True)
        base = stored(numbered(counts.where(F.col("a") >= least)), "word-numbers", keep=True)
    parts = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // CELLS
    own: dict[str, dict[bytes, int]] = {}
    few = base.where(F.col("id") < words).select("lang", "phrase", "id").toArrow()
    for lang, word, number in zip(*(few.column(c).to_pylist() for c in few.column_names)):
        own.setdefault(lang, {STOP: STOPPED})[word.encode()] = number
    known = Numbers(own, [], marks(base.where(F.col("id") >= words)))
    levels = [base.select("lang", "phrase", F.lit(1).alias("width"), "a")]
    last = base
    for width in range(2, widest + 1):
        shared = spark.sparkContext.broadcast(known)
        with temporary(spark), small_batches(spark):
            counts = phrase_counts(texts, shared, width, least, parts)
            coded = (counts.where("left is not null").select("left", "right", "a")
                     .join(last.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head")), "left")
                     .join(base.select(F.col("id").alias("right"), F.col("phrase").alias("tail")), "right")
                     .select("left", "right", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "a"))
            coded = stored(numbered(coded), f"phrases-{width}", keep=True)
        shared.unpersist()
        levels.append(coded.select("lang", "phrase", F.lit(width).alias("width"), "a"))
        spelled = counts.where("left is null") if known.others is not None else None
        if spelled is not None:
            levels.append(spelled.select("lang", "phrase", F.lit(width).alias("width"), "a"))
        if width < widest:
            few = coded.where(F.col("id") < phrases).select((F.shiftleft("left", 32) + F.col("right")).alias("cell"), "id").toArrow()
            cells, ids = (few.column(c).to_numpy() for c in ("cell", "id"))
            order = np.argsort(cells)
            others = coded.where(F.col("id") >= phrases).select("lang", "phrase")
            others = others if spelled is None else others.unionByName(spelled.select("lang", "phrase"))
            known = Numbers(own, [*known.squares, (cells[order], ids[order])], marks(others))
            last = coded
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, widest: int = 4, top: int = 2000,
                 share: int = 80, words: int = 1 << 17, phrases: int = 1 << 20) -> DataFrame:
    """(`lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`): the `top` phrases of each language.

    Texts are lower-cased (A-Z) and cut into pieces at `. , ; : ! ?` and the line ends, pieces into words at
    spaces and tabs. A phrase occurs `a` >= `least` times within pieces; each cut of it into two parts, which
    occur `l` and `r` times, scores floor(2000000 a / (l + r)), and the lowest score counts (of equal ones
    the earliest cut). A phrase goes if a longer one that holds it has `share` hundredths of its count or more.
    Higher scores come first, then higher counts, then the phrase in byte order.

    A null text is empty, a null language `und`; a repeated row counts each time; texts without a phrase and
    empty tables give no rows. A long text is read in parts that end between pieces. Further columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    found, totals = frequent_phrases(texts, least, widest, words, phrases)
    found = stored(found, "frequent")
    candidates = found.where("width > 1")

    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, width - 1)")))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - width)")})
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("times").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("times").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("lowest")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")

    inner = candidates.where("width > 2").withColumn("inner", F.explode(F.expr("""
        flatten(transform(sequence(2, width - 1), w -> transform(sequence(1, width - w + 1),
            s -> array_join(slice(split(phrase, ' '), s, w), ' '))))""")))
    inner = inner.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(
        f"longer is null or cast(100 as decimal(3, 0)) * cast(longer as decimal(19, 0)) < cast({int(share)} as decimal(10, 0)) * cast(a as decimal(19, 0))")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
