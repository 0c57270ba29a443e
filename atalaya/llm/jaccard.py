"""Near copies by exact Jaccard similarity of five-word shingles.

Candidates come from two searches. SimHash fingerprints of the sets, of 64 bits, are linked at 3 or fewer
differing bits by pigeonring keys (`simhash.near_links`). At a radius those keys can search they find few of
the pairs near 0.8, so MinHash has to find the rest: a text has `BANDS` keys of `ROWS` minima each, and texts that share a key are candidates
(a pair at 0.8 shares none with probability (1 - 0.8^4)^20 = 3e-5). Of a candidate pair the sizes and a
sketch, 16 bits of each of the 80 minima, are looked at next (a pair at 0.8 has fewer than `ENOUGH` equal
ones with probability 2e-6); only then are its sets of shingles built from the texts and compared.

Texts with equal sets are one node, and links join nodes. First the nodes that SimHash links meet, and each
node of a key meets the key's first node. Keys whose nodes are then all connected are done, so thousands of near copies cost one comparison
each. Where a key holds several components, the nodes outside the first one's meet all of the key's in
blocks of bounded size: once with sketches, to find the nodes that have a candidate, and once with the
texts of those. A block returns a forest that joins the components it finds linked, and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from atalaya.llm.common import meet, packed, stored, temporary, unpack
from atalaya.llm.components import components
from atalaya.llm.simhash import near_links

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 20, 4
SEED = 42
PIECE = 1 << 12
TURNS = np.random.default_rng(SEED).integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
SHARE = 256  # pairs that take the text of one node in one task
BLOCK = 512  # nodes on one side of a block
ENOUGH = 46  # equal minima, of 80, that a similar pair has
NODE = "node long, size long, fp long, bands array<long>, sketch array<long>"


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles; a shorter text is one shingle, one without a word has none."""
    words = raw.lower().split()  # for bytes: A-Z, and white space is \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    parts = map(b" ".join, zip(*[words[k:] for k in range(width)]))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(words) - width + 1))


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return small == large
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both) - 1e-9


def minima(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), PIECE):
        least = np.minimum(least, (own[None, start:start + PIECE] * TURNS).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def sketch_of(least: np.ndarray) -> np.ndarray:
    """16 bits of each minimum; the four of a band in one number."""
    return (least >> np.uint64(24)).astype("<u2").view("<i8")


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number: a bit is 1 if set in over half of their hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(own), PIECE):
        part = own[start:start + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view("<i8")[0])


def sign(rows: DataFrame, width: int) -> DataFrame:
    """`id`, `h1`, `h2` of the rows with their `NODE`; the node is a hash of the set of shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch, nodes, sizes, prints, bands, sketches = whole.slice(at, 1024), [], [], [], [], []
                for raw in batch.column("raw"):
                    own = shingles(raw.as_py(), width)
                    least = minima(own)
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                    sizes.append(len(own))
                    prints.append(fingerprint(own))
                    bands.append(band_keys(least))
                    sketches.append(sketch_of(least))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["id", "h1", "h2", "node", "size", "fp", "bands", "sketch"])

    return rows.select("id", "h1", "h2", "raw").mapInArrow(run, f"id long, h1 long, h2 long, {NODE}")


def unpacked(value: pa.BinaryScalar, width: int) -> np.ndarray:
    return shingles(unpack(value), width)


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (`a`, `b`) of nodes that connect all those whose fingerprints SimHash links or that share one."""
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    same = meet(nodes.select("fp", "node"), stored(fps.where("n > 1"), "same-prints"), ["fp"], "n")
    same = same.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    end = lambda name: fps.select(F.col("fp").alias(name), F.col("first").alias(f"node_{name}"))
    linked = near_links(fps.select("fp")).distinct().join(end("a"), "a").join(end("b"), "b")
    return same.unionByName(linked.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The `pairs` (`a`, `b`) whose sizes and sketches allow the similarity."""
    own = nodes.select("node", "size", "sketch")
    ends = lambda name: own.select(*(F.col(c).alias(f"{c}_{name}") for c in ("node", "size", "sketch")))
    lanes = " + ".join(f"if((x & {0xFFFF << k if k < 48 else -(1 << 48)}L) = 0, 1, 0)" for k in (0, 16, 32, 48))
    equal = f"aggregate(zip_with(sketch_a, sketch_b, (x, y) -> x ^ y), 0, (n, x) -> n + {lanes})"
    times = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "times")
    left = times.join(ends("a").withColumnRenamed("node_a", "a"), "a")
    both = meet(pairs.join(ends("b").withColumnRenamed("node_b", "b"), "b"), left, ["a"], "n")
    return both.where(f"least(size_a, size_b) >= {least} * greatest(size_a, size_b)").where(f"{equal} >= {ENOUGH}").select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The `pairs` (`a`, `b`, distinct) whose texts are similar. An `a` of many pairs is sent to several tasks."""
    shares = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares")), "shares")
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").alias("share"))
    left = (shares.join(texts.withColumnRenamed("node", "a"), "a")
            .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.col("raw").alias("raw_a")))
    both = dealt.join(texts.select(F.col("node").alias("b"), F.col("raw").alias("raw_b")), "b").join(left, ["a", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for a, raw_a, raw_b in zip(batch.column("a").to_pylist(), batch.column("raw_a"), batch.column("raw_b")):
                if a != last:
                    last, own = a, unpacked(raw_a, width)
                keep.append(similar(own, unpacked(raw_b, width), least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "raw_a", "raw_b").mapInArrow(run, "a long, b long")


def blocks_of(members: DataFrame, columns: list[str], block: int) -> DataFrame:
    """`members` (`key`, `node`, `label`, `columns`) dealt into cells: nodes outside the first one's component (role 0) against all (role 1)."""
    counts = members.groupBy("key").agg(F.min_by("label", "node").alias("main"), F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    counts = stored(counts.where("x <> y").select("key", "main", "n"), "open")
    rows = stored(meet(members, counts, ["key"], "n"), "members")
    others = stored(rows.where("label <> main").groupBy("key").agg(F.count(F.lit(1)).alias("others")), "others")
    rows = meet(rows.drop("n"), counts.join(others, "key").select("key", "n", "others"), ["key"], "n")
    size = {"a": F.ceil(F.col("others") / block), "b": F.ceil(F.col("n") / block)}
    upto = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), size[side] - 1))
    place = lambda side: F.pmod(F.xxhash64("node"), size[side])
    left = rows.where("label <> main").withColumns({"at": place("a"), "role": F.lit(0)}).withColumn("to", upto("b"))
    right = rows.withColumns({"to": place("b"), "role": F.lit(1)}).withColumn("at", upto("a"))
    names = ["key", "at", "to", "role", "node", "label", *columns]
    return left.select(names).unionByName(right.select(names)).repartition("key", "at", "to").sortWithinPartitions("key", "at", "to", "role")


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Both sides of each cell."""
    def parted(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
        whole = pa.Table.from_batches(held).combine_chunks()
        role = whole.column("role").to_numpy()
        cut = int(np.searchsorted(role, 1))
        if 0 < cut < len(role):
            yield whole.slice(0, cut), whole.slice(cut)

    cell, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in ("key", "at", "to")])
        cuts = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            if held and cell != tuple(marks[:, start]):
                yield from parted(held)
                held = []
            cell = tuple(marks[:, start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield from parted(held)


def likely_in(left: pa.Table, right: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in `left` and `right`, and equal minima, of the pairs of different components that may be similar, here where they first share a band."""
    lanes = [t.column("sketch").combine_chunks().flatten().to_numpy().view("<u2").reshape(-1, BANDS * ROWS) for t in (left, right)]
    label, size, node = ([t.column(c).to_numpy() for t in (left, right)] for c in ("label", "size", "node"))
    band = int(left.column("band")[0].as_py())
    found = []
    for start in range(0, left.num_rows, 32):
        part = slice(start, start + 32)
        small, large = np.minimum(size[0][part, None], size[1]), np.maximum(size[0][part, None], size[1])
        i, j = np.nonzero((label[0][part, None] != label[1]) & (small >= least * large))
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)] + start, j[at:at + (1 << 16)]
            equal = lanes[0][a] == lanes[1][b]
            count = equal.sum(axis=1)
            first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            good = (count >= ENOUGH) & (first == band)
            found.append((a[good], b[good], count[good]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def flagged(cells: DataFrame, least: float) -> DataFrame:
    """(`key`, `node`) of the nodes that have a likely pair in a cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in cells_of(batches):
            a, b, _ = likely_in(left, right, least)
            own = np.unique(np.concatenate([left.column("node").to_numpy()[a], right.column("node").to_numpy()[b]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), left.column("key")[0].as_py())), pa.array(own)], ["key", "node"])

    return cells.mapInArrow(run, "key long, node long").distinct()


def joined(cells: DataFrame, width: int, least: float) -> DataFrame:
    """Links (`a`, `b`) that join the components of each cell as all its similar pairs do; the likeliest pairs are compared first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in cells_of(batches):
            a, b, count = likely_in(left, right, least)
            label = [t.column("label").to_numpy() for t in (left, right)]
            node = [t.column("node").to_numpy() for t in (left, right)]
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            sets: dict[int, np.ndarray] = {}

            def own_set(side: int, place: int) -> np.ndarray:
                name = int(node[side][place])
                if name not in sets:
                    sets[name] = unpacked((left, right)[side].column("raw")[place], width)
                return sets[name]

            links = []
            for k in np.argsort(-count, kind="stable").tolist():
                x, y = find(int(label[0][a[k]])), find(int(label[1][b[k]]))
                if x != y and similar(own_set(0, int(a[k])), own_set(1, int(b[k])), least):
                    root[max(x, y)] = min(x, y)
                    links.append((node[0][a[k]], node[1][b[k]]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*links)], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def node_links(nodes: DataFrame, printed: DataFrame, texts: DataFrame, width: int, least: float, block: int) -> DataFrame:
    """Links (`a`, `b`) that connect the nodes (`NODE`) as all similar candidate pairs do.

    `printed` has the pairs that SimHash found, `texts` has (`node`, packed `raw`) of all that have a candidate.
    """
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    first = keys.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(meet(keys, stored(first, "firsts"), ["key"], "n").select("key", "band", "first", "node"), "shared")
    pairs = shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = stored(pairs.unionByName(printed).distinct(), "pairs")
    links = stored(verified(stored(likely(pairs, nodes, least), "likely"), texts, width, least), "links")

    labels = stored(components(links), "labels")
    labelled = stored(shared.join(labels, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("label")), "labelled")
    spread = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    members = stored(meet(labelled, stored(spread.select("key", "n"), "spread"), ["key"], "n").select("key", "band", "node", "label"), "open")
    members = stored(members.join(nodes.select("node", "size", "sketch"), "node"), "sketched")
    hits = flagged(blocks_of(members, ["band", "size", "sketch"], 4 * block), least)
    members = stored(members.join(stored(hits, "flagged"), ["key", "node"]).join(texts, "node"), "with-texts")
    return links.unionByName(stored(joined(blocks_of(members, ["band", "size", "sketch", "raw"], block), width, least), "more-links"))


def near_classes(rows: DataFrame, width: int = WIDTH, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(`id`, `h1`, `h2`, `root`) for rows of (`id`, `h1`, `h2`, `raw`); rows are near copies if their roots are equal."""
    signed = stored(sign(rows, width), "sets")
    nodes = signed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "fp", "bands", "sketch", "h1", "h2")))
    nodes = stored(nodes, "nodes")
    shared = nodes.select("node", F.explode("bands").alias("key"))
    keys = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    printed = stored(print_pairs(nodes), "print-pairs")
    # Only texts that share a key with another or are linked by SimHash are compared; one row stands for its node.
    some = meet(shared, stored(keys, "keys"), ["key"], "n").select("node")
    some = some.unionByName(printed.select(F.explode(F.array("a", "b")).alias("node")))
    some = some.distinct().join(nodes.select("node", "h1", "h2"), "node")
    texts = packed(rows.select("h1", "h2", "raw")).dropDuplicates(["h1", "h2"]).join(stored(some, "some"), ["h1", "h2"])
    texts = stored(texts.select("node", "raw"), "texts")
    roots = components(node_links(nodes, printed, texts, width, least, block))
    return signed.join(roots, "node", "left").select("id", "h1", "h2", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                     least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """One row of each component stays: the one with the smallest id. A null text is empty.

    Rows without an id come last; among rows of one id the smaller hash of the text goes first, and of
    rows that share id and text the one whose columns hash least. Texts without a word are near copies of
    one another; very long texts are compared whole. Columns are those of `docs`, in their order, whatever
    their names; an empty table gives no rows.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = {"id": F.col(id_col).cast("long"), "h1": F.xxhash64(raw), "h2": F.xxhash64(F.lit(1), raw)}
    rows = docs.select(*(column.alias(name) for name, column in names.items()), raw.alias("raw"))
    whole = docs.select(*(column.alias(name) for name, column in names.items()), F.struct("*").alias("row"))
    with temporary(docs.sparkSession):
        keyed = stored(near_classes(rows, width, least, block).groupBy("root", "id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "keyed")
        order = F.struct(F.col("id").isNull(), "id", "h1", "h2")
        best = keyed.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows"))
        best = best.select("root", "rows", F.col("best.id").alias("best_id"), F.col("best.h1").alias("best_1"), F.col("best.h2").alias("best_2"))
        stays = F.col("id").eqNullSafe(F.col("best_id")) & (F.col("h1") == F.col("best_1")) & (F.col("h2") == F.col("best_2"))
        told = stored(meet(keyed, stored(best, "best"), ["root"], "rows").select("id", "h1", "h2", "n", stays.alias("stays")), "told")
        gone = stored(told.where("not stays").select("id", "h1", "h2"), "gone", keep=True)
        twice = stored(told.where("stays and n > 1").select("id", "h1", "h2"), "twice", keep=True)
    same = lambda other: (whole.id.eqNullSafe(other.id)) & (whole.h1 == other.h1) & (whole.h2 == other.h2)
    kept = whole.join(gone, same(gone), "left_anti")
    if not twice.limit(1).count():
        return kept.select("row.*")
    first = Window.partitionBy("id", "h1", "h2").orderBy(F.xxhash64("row"))
    repeated = whole.join(twice, same(twice), "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.join(twice, same(twice), "left_anti").select("row.*").unionByName(repeated.select("row.*"))
