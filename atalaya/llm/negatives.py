"""Hard negatives by a multiway hyperplane tree whose split points know how far the other subtrees lie.

Integer vectors are lifted by one component so that all have the norm of the longest; an anchor has zero
there. Its inner product with a row then says how far the row is, and the scores from `low` to `high` are
the rows in an annulus around the anchor. A node of the tree has a few split points and deals its rows
to the nearest; each split point stores, for each sibling subtree, the least and the greatest distance
of its rows, counted over all rows. A subtree is skipped if for some split point that range misses
what the annulus allows. Leaves that remain are compared exactly.

The tree has at most `leaves` leaves, grown from a bounded sample; every row is in one. A leaf is cut
into pages of bounded size, and the anchors that reach it into blocks, so that no task holds a hot leaf.
Each search goes twice: to the anchor's own leaf, which gives scores that the result has at least, and
then with the annuli so narrowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from atalaya.llm.common import stored

ARITY = 8
LARGEST = 2.0 ** 56  # squared norm from which 100 x score leaves 64 bits
EXACT = 2.0 ** 52  # squared norm up to which products of doubles are exact
SLACK = 1e-6  # of the longest norm: what rounding may add to a distance
EVER = 1 << 62


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; missing components are zero."""
    wide = min(a.shape[1], b.shape[1])
    return a[:, :wide] @ b[:, :wide].T


def norms(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


@dataclass
class Node:
    """`points` (lifted by `rise`) and the numbers of the children; a leaf has no points."""
    points: np.ndarray
    rise: np.ndarray
    children: list[int]
    near: np.ndarray = field(default=None)  # near[i, j]: least distance from point i to the rows of child j
    far: np.ndarray = field(default=None)


class Tree:
    """Nodes by number, the root first; `longest` is the greatest squared norm of all rows."""

    def __init__(self, sample: np.ndarray, longest: float, total: int, leaf_rows: int, leaves: int) -> None:
        self.longest, self.nodes = longest, []
        rows_each = total / max(1, len(sample))
        budget = [leaves - 1]
        rng = np.random.default_rng(5)
        waiting = [self._add()]
        held = {0: np.arange(len(sample))}
        while waiting:
            # The fullest node is split first, so that a bound on leaves goes where rows are.
            number = max(waiting, key=lambda k: len(held[k]))
            waiting.remove(number)
            own = sample[held[number]]
            if len(own) * rows_each <= leaf_rows or budget[0] < 1 or len(own) < 2:
                continue
            points = self._points(own, rng, min(ARITY, budget[0] + 1))
            if len(points) < 2:
                continue
            budget[0] -= len(points) - 1
            node = self.nodes[number]
            node.points = points
            node.rise = self._rise(points)
            node.children = [self._add() for _ in points]
            side = self.distances(node, own).argmin(axis=1)
            for j, child in enumerate(node.children):
                held[child] = held[number][side == j]
                waiting.append(child)
        for node in self.nodes:
            m = len(node.children)
            node.near, node.far = np.full((m, m), np.inf), np.full((m, m), -np.inf)

    def _add(self) -> int:
        self.nodes.append(Node(np.zeros((0, 0)), np.zeros(0), []))
        return len(self.nodes) - 1

    def _rise(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - norms(rows), 0))

    def _points(self, own: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
        """Split points far from each other: each is the farthest of a few rows from those before it."""
        few = own[rng.permutation(len(own))[:32 * ARITY]]
        rise = self._rise(few)
        gap = 2 * self.longest - 2 * (products(few, few) + np.outer(rise, rise))
        chosen = [0]
        while len(chosen) < most:
            least = gap[:, chosen].min(axis=1)
            best = int(least.argmax())
            if least[best] <= SLACK * self.longest:
                break
            chosen.append(best)
        return few[chosen]

    def distances(self, node: Node, rows: np.ndarray) -> np.ndarray:
        """From lifted rows to the split points."""
        return np.sqrt(np.maximum(2 * self.longest - 2 * (products(rows, node.points) + np.outer(self._rise(rows), node.rise)), 0))

    def distances_of_anchors(self, node: Node, rows: np.ndarray, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares[:, None] + self.longest - 2 * products(rows, node.points), 0))

    def place(self, rows: np.ndarray, ranges: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The leaf of each row; widens `ranges` of the nodes on the way."""
        leaf = np.zeros(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            number, own = waiting.pop()
            node = self.nodes[number]
            if not node.children:
                leaf[own] = number
                continue
            away = self.distances(node, rows[own])
            side = away.argmin(axis=1)
            m = len(node.children)
            near, far = ranges.setdefault(number, (np.full((m, m), np.inf), np.full((m, m), -np.inf)))
            for j, child in enumerate(node.children):
                mine = side == j
                if mine.any():
                    near[:, j] = np.minimum(near[:, j], away[mine].min(axis=0))
                    far[:, j] = np.maximum(far[:, j], away[mine].max(axis=0))
                    waiting.append((child, own[mine]))
        return leaf

    def home(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The leaf whose split points are nearest, going down."""
        waiting = [(0, np.arange(len(rows)))]
        squares = norms(rows)
        while waiting:
            number, own = waiting.pop()
            node = self.nodes[number]
            if not node.children:
                yield number, own
                continue
            side = np.where(np.isfinite(node.near.min(axis=0)), self.distances_of_anchors(node, rows[own], squares[own]), np.inf).argmin(axis=1)
            waiting += [(child, own[side == j]) for j, child in enumerate(node.children) if (side == j).any()]

    def reached(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves that may hold scores from `low` to `high` (one column a window) of the anchors `rows`."""
        squares = norms(rows)
        slack = SLACK * np.sqrt(self.longest) + 1e-9
        outer = np.sqrt(np.maximum(squares[:, None] + self.longest - 2.0 * low, 0)) + slack
        inner = np.sqrt(np.maximum(squares[:, None] + self.longest - 2.0 * high, 0)) - slack
        outer[low > high] = -1.0
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            number, own = waiting.pop()
            node = self.nodes[number]
            if not node.children:
                yield number, own
                continue
            away = self.distances_of_anchors(node, rows[own], squares[own])[:, None, :]
            most = away + outer[own][:, :, None]
            least = np.maximum(away - outer[own][:, :, None], inner[own][:, :, None] - away)
            open_ = (outer[own] >= 0)[:, :, None]
            for j, child in enumerate(node.children):
                meets = (open_ & (node.near[:, j] - slack <= most) & (least <= node.far[:, j] + slack)).all(axis=2).any(axis=1)
                if meets.any():
                    waiting.append((child, own[meets]))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of integers as doubles, padded with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def clean(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(`id`, `label`, `vec` as longs), without the rows that take no part (see `hard_negatives`)."""
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda n, x: n + x * x)
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)) & (square < LARGEST)
    return (found.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(good, F.lit(False)))
            .select("id", "label", F.transform("vec", lambda x: x.cast("long")).alias("vec")))


def candidates_of(rows: DataFrame, most: int) -> DataFrame:
    """The rows that can be among the first `most` of any anchor: of equal vectors with one label those of the smallest ids.

    `most` + 1 ids with `most` copies each are enough, as an anchor leaves out one id, its own.
    """
    counted = rows.groupBy("label", "vec", "id").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("copies"))
    first = Window.partitionBy("label", "vec").orderBy("id")
    few = counted.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most + 1)
    return few.select("id", "label", "vec", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def planted(rows: DataFrame, tree, kinds: str) -> tuple[DataFrame, DataFrame]:
    """`rows` with their leaf, and (`node`, `i`, `j`, `near`, `far`): the ranges of all rows, at most one cell a task and pair."""
    names = ["leaf", "id", "label", "vec", "copy", "node", "i", "j", "near", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict = {}
        types = [pa.int64(), pa.int64(), None, None, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        for batch in batches:
            types[2], types[3] = batch.column("label").type, batch.column("vec").type
            leaf = tree.value.place(matrix(batch.column("vec")), ranges)
            n = len(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c) for c in names[1:5]), *(pa.nulls(n, t) for t in types[5:])], names)
        for node, (near, far) in ranges.items():
            i, j = np.nonzero(np.isfinite(near))
            n = len(i)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, t) for t in types[:5]), pa.array(np.full(n, node)), pa.array(i.astype(np.int32)),
                 pa.array(j.astype(np.int32)), pa.array(near[i, j]), pa.array(far[i, j])], names)

    out = rows.mapInArrow(run, f"leaf long, id long, label {kinds}, vec array<long>, copy int, node long, i int, j int, near double, far double")
    out = stored(out, "planted")
    ranges = out.where("node is not null").groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    return out.where("node is null").select("leaf", "id", "label", "vec", "copy"), ranges


def routed(anchors: DataFrame, tree, kinds: str, home: bool) -> DataFrame:
    """(`leaf`, `no`, `id`, `label`, `vec`, `low`, `high`) for each leaf an anchor has to see: its own, or all that are not skipped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vec"))
            if home:
                found = tree.value.home(rows)
            else:
                wide = len(batch.column("low")[0]) if batch.num_rows else 0
                low, high = (batch.column(c).flatten().to_numpy().reshape(-1, wide) for c in ("low", "high"))
                found = tree.value.reached(rows, low, high)
            for leaf, own in found:
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), leaf)), *part.columns], ["leaf", *part.schema.names])

    return (anchors.select("no", "id", "label", "vec", "low", "high")
            .mapInArrow(run, f"leaf long, no long, id long, label {kinds}, vec array<long>, low array<long>, high array<long>"))


def met(rows: DataFrame, asked: DataFrame, kinds: str, same: bool, k: int, page: int, block: int) -> DataFrame:
    """(`no`, `w`, `found`, `score`): the first `k` rows in window `w` of each anchor, of its label (`same`) or of others.

    A cell is a page of a leaf and a block of the anchors that reach it.
    """
    asked = stored(asked, "routed")
    pages = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / page).alias("pages"))
    blocks = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    grid = stored(pages.join(blocks, "leaf"), "grid")  # at most one row a leaf
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = lambda kind: F.lit(None).cast(kind)
    held = (rows.join(F.broadcast(grid), "leaf").withColumn("page", F.pmod(F.xxhash64("id", "copy", "vec"), "pages")).withColumn("block", upto("blocks"))
            .select("leaf", "page", "block", F.lit(0).alias("role"), none("long").alias("no"), "id", "label", "vec",
                    none("array<long>").alias("low"), none("array<long>").alias("high")))
    sent = (asked.join(F.broadcast(grid), "leaf").withColumn("block", F.pmod(F.xxhash64("no"), "blocks")).withColumn("page", upto("pages"))
            .select("leaf", "page", "block", F.lit(1).alias("role"), "no", "id", "label", "vec", "low", "high"))
    cells = held.unionByName(sent).repartition("leaf", "page", "block").sortWithinPartitions("leaf", "page", "block", "role")

    def first_of(batch: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchors, wide = matrix(batch.column("vec")), len(batch.column("low")[0])
        longest = max(norms(anchors).max(initial=0), norms(vecs).max(initial=0))
        if longest <= EXACT:
            scores = products(anchors, vecs).astype(np.int64)
        else:
            scores = products(anchors.astype(np.int64), vecs.astype(np.int64))
        own, label = batch.column("id").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False)
        usable = ((label[:, None] == labels[None, :]) == same) & (own[:, None] != ids[None, :])
        low, high = (batch.column(c).flatten().to_numpy().reshape(-1, wide) for c in ("low", "high"))
        for w in range(wide):
            a, r = np.nonzero(usable & (scores >= low[:, w, None]) & (scores <= high[:, w, None]))
            score = scores[a, r]
            order = np.lexsort((ids[r], -score, a))
            a, r, score = a[order], r[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            a, r, score = a[place < k], r[place < k], score[place < k]
            yield pa.RecordBatch.from_arrays([batch.column("no").take(pa.array(a)), pa.array(np.full(len(a), w, np.int32)), pa.array(ids[r]), pa.array(score)],
                                             ["no", "w", "found", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, ids = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("leaf", "page", "block", "role")])
            cuts = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(start, stop - start)
                if cell != tuple(marks[:3, start]):
                    cell, parts, ids = tuple(marks[:3, start]), [], None
                if marks[3, start] == 0:
                    parts.append(part)
                    continue
                if ids is None:
                    if not parts:
                        continue
                    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    ids, labels = whole.column("id").to_numpy(), whole.column("label").to_numpy(zero_copy_only=False)
                    vecs = matrix(whole.column("vec"))
                for at in range(0, part.num_rows, 512):
                    yield from first_of(part.slice(at, 512), ids, labels, vecs)

    hits = cells.mapInArrow(run, "no long, w int, found long, score long")
    order = Window.partitionBy("no", "w").orderBy(F.desc("score"), "found")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def floors(hits: DataFrame, k: int) -> DataFrame:
    """(`no`, `floor`): by window the score of the k-th found, where there are so many."""
    return hits.where(F.col("place") == k).groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floor"))


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "vector", label_col: str = "label", every: int = 100,
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, sample: int = 4096,
                   leaf_rows: int = 4096, leaves: int = 1024, page_bytes: int = 1 << 24, block: int = 1 << 16) -> DataFrame:
    """(`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`).

    Vectors are of whole numbers. Anchors are the rows whose id is divisible by `every`; a score is the inner
    product with the anchor (components that a shorter vector lacks are zero), higher first, ties by smaller id.
    The first `positives` other rows of the anchor's label are its positives; for each of them the first
    `negatives` rows of other labels with low * p <= 100 * score <= high * p are returned, p being the positive's
    score. The result is exact. The tree is fitted on at most 2 * `sample` rows and holds all.

    Rows with a null id, label or vector, with a null or non-finite component, or of a squared norm of 2^56 or more
    (100 times their score leaves 64 bits) take no part. Rows that share the anchor's id are not its positives or
    negatives; repeated rows count each time as positives (up to `positives`) and negatives, and once as anchors. An empty
    vector scores zero. Further columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    most = max(positives, negatives)
    kinds = dict(rows.dtypes)[label_col]
    good = clean(rows, id_col, vec_col, label_col)
    some = stored(candidates_of(good, most), "candidates")
    square = F.aggregate("vec", F.lit(0.0), lambda n, x: n + x * x)
    total, longest, widest = some.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("vec"))).first()
    share = min(1.0, sample / max(1, total))
    draw = F.pmod(F.xxhash64(F.lit(5), "id", "vec"), F.lit(1_000_003))
    drawn = some.where((F.col("copy") == 1) & (draw < share * 1_000_003)).orderBy(draw, "id").limit(2 * sample).select("vec").toArrow()
    sampled = matrix(drawn.column("vec").combine_chunks()) if drawn.num_rows else np.zeros((0, 0))
    grown = Tree(sampled, float(longest or 0), total, leaf_rows, leaves)
    shared = spark.sparkContext.broadcast(grown)
    placed, ranges = planted(some, shared, kinds)
    for node, i, j, near, far in ranges.collect():  # at most ARITY cells for each node of the bounded tree
        grown.nodes[node].near[i, j], grown.nodes[node].far[i, j] = near, far
    tree = spark.sparkContext.broadcast(grown)
    page = max(64, page_bytes // (8 * max(1, widest or 1)))

    def search(anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """Two rounds: the anchor's own leaf, then every leaf that the narrowed annuli meet."""
        first = floors(met(placed, routed(anchors, tree, kinds, True), kinds, same, k, page, block), k)
        narrowed = anchors.join(stored(first, "floors"), "no", "left").withColumn(
            "low", F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("floor", w), x))))
        return stored(met(placed, routed(narrowed, tree, kinds, False), kinds, same, k, page, block), "hits")

    asked = good.where(F.col("id") % every == 0).distinct().select(F.monotonically_increasing_id().alias("no"), "id", "label", "vec")
    asked = stored(asked, "anchors")
    likes = search(asked.withColumns({"low": F.array(F.lit(-EVER)), "high": F.array(F.lit(EVER))}), True, positives)
    likes = likes.select("no", F.col("place").alias("nth"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    scores = likes.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("scores"))  # at most `positives`
    bound = lambda name, share, none: F.expr(
        f"transform(sequence(1, {positives}), n -> if(n <= size(scores), "
        f"bigint({name}(cast(scores[n - 1].positive_score as decimal(20, 0)) * cast({share} as decimal(3, 0)) / 100)), {none}L))")
    windows = asked.join(scores, "no").withColumns({"low": bound("ceil", low, EVER), "high": bound("floor", high, -EVER)})
    windows = stored(windows.drop("scores"), "annuli")
    hits = search(windows, False, negatives)
    hits = hits.select("no", (F.col("w") + 1).alias("nth"), F.col("place").alias("rank"), F.col("found").alias("negative_id"),
                       F.col("score").alias("negative_score"))
    return (hits.join(likes, ["no", "nth"]).join(asked.select("no", F.col("id").alias("anchor_id")), "no")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
