"""Hard negatives by dual-tree search.

Anchors and candidates are dealt to blocks, and every block of anchors meets every block of candidates. There a tree is
built over each side: nodes are split between labels first, then at the median of the widest dimension, and know
their labels, centre and radius. The inner products of two nodes lie within centre . centre
-+ (|centre| radius + |centre| radius + radius radius), and a pair of nodes is dropped for all its anchors at once if

- no anchor may have a candidate there by its label,
- the interval lies outside the scores that every anchor of the node asks for, or
- below a score that enough candidates are sure to exceed (nodes whose lower ends count, as their labels and
  interval are sure to fit).

What is left of a pair is split, down to pairs of leaves. These are scored exactly, in whole numbers, for an
anchor leaf the most promising candidates first, until the next pair cannot reach what each ask has found.

The search runs twice: for the positives of each anchor, then, with the scores that each positive asks for, for the negatives.
A block gives an ask's k best rows; Spark ranks those of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.common import kept, ready
from stepforge.llm.topk import _scores
from stepforge.llm.vectors import block_count, copied, dealt, matrix, usable, whole_numbers

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Rows of a leaf over anchors and over candidates; candidates scored first for a leaf of anchors.
ANCHOR_LEAF, CANDIDATE_LEAF, FIRST = 16, 128, 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Tree:
    """A binary tree over rows: order[start:stop] are a node's rows; leaves have no left child (-1)."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(labels))
        start, stop, left, right = [0], [len(labels)], [-1], [-1]
        centre, radius = [], []
        node = -1
        while (node := node + 1) < len(start):
            rows = self.order[start[node] : stop[node]]
            v = vectors[rows].astype(np.float64)
            centre.append(v.mean(axis=0))
            radius.append(float(np.sqrt(((v - centre[-1]) ** 2).sum(axis=1).max())))
            if len(rows) <= leaf:
                continue
            at = self._cut(v, labels[rows])
            if at is None:
                continue
            by, place = at
            self.order[start[node] : stop[node]] = rows[by]
            middle = start[node] + place
            left[node], right[node] = len(start), len(start) + 1
            start += [start[node], middle]
            stop += [middle, stop[node]]
            left += [-1, -1]
            right += [-1, -1]
        self.start, self.stop, self.left, self.right = (np.array(x) for x in (start, stop, left, right))
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.norm, self.size = np.sqrt((self.centre**2).sum(axis=1)), self.stop - self.start
        of = [labels[self.order[a:b]] for a, b in zip(start, stop, strict=True)]
        self.first, self.last = np.array([x.min() for x in of]), np.array([x.max() for x in of])
        self.pure, self.leaf = self.first == self.last, self.left < 0

    @staticmethod
    def _cut(v: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, int] | None:
        """An order of a node's rows and where it is cut in two; None if all rows are alike."""
        n = len(labels)
        if labels.min() != labels.max():
            by = np.argsort(labels, kind="stable")
            edges = np.flatnonzero(np.diff(labels[by])) + 1
            return by, int(edges[np.abs(edges - n // 2).argmin()])
        wide = np.ptp(v, axis=0)
        if not wide.max():
            return None
        return np.argpartition(v[:, wide.argmax()], n // 2), n // 2

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.stop[node]]

    def of_nodes(self, reduce, values: np.ndarray) -> np.ndarray:
        """reduce (np.min, say) of the values of each node's rows."""
        return np.array([reduce(values[self.rows(i)]) for i in range(len(self.start))])


def intervals(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the inner products of any node of a and any of b, with room for rounding."""
    middle = a.centre @ b.centre.T
    wide = np.outer(a.norm, b.radius) + np.outer(a.radius, b.norm) + np.outer(a.radius, b.radius)
    wide += 1 + 1e-9 * (np.outer(a.norm, b.norm) + wide)
    return middle - wide, middle + wide


def leaf_pairs(a: Tree, b: Tree, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold one of the k best candidates of an ask, and their upper ends.

    low and high: by row of a, two columns each, the least and the largest limit of its asks."""
    lower, upper = intervals(a, b)
    least, least_sure = a.of_nodes(np.min, low[:, 0]), a.of_nodes(np.max, low[:, 1])
    most, most_sure = a.of_nodes(np.max, high[:, 1]), a.of_nodes(np.min, high[:, 0])
    floor = np.full(len(a.start), -np.inf)
    x, y, out = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(x):
        lo, up = lower[x, y], upper[x, y]
        apart = (a.first[x] > b.last[y]) | (b.first[y] > a.last[x])
        alike = a.pure[x] & b.pure[y] & (a.first[x] == b.first[y])
        sure = (alike if same else apart) & (lo >= least_sure[x]) & (up <= most_sure[x])
        _raise(floor, x[sure], lo[sure], b.size[y[sure]], k + 1)  # the anchor itself may be among them
        may = ~(apart if same else alike) & (up >= least[x]) & (lo <= most[x]) & (up >= floor[x])
        x, y = x[may], y[may]
        ends = a.leaf[x] & b.leaf[y]
        out.append((x[ends], y[ends]))
        x, y = x[~ends], y[~ends]
        first = ~a.leaf[x] & (b.leaf[y] | (a.radius[x] >= b.radius[y]))
        for child in (a.left, a.right):
            floor[child[x[first]]] = np.maximum(floor[child[x[first]]], floor[x[first]])
        x, y = np.concatenate([a.left[x[first]], a.right[x[first]], x[~first], x[~first]]), np.concatenate([y[first], y[first], b.left[y[~first]], b.right[y[~first]]])
    x, y = (np.concatenate(v) for v in zip(*out, strict=True))
    keep = upper[x, y] >= floor[x]
    return x[keep], y[keep], upper[x, y][keep]


def _raise(floor: np.ndarray, nodes: np.ndarray, lower: np.ndarray, sizes: np.ndarray, enough: int) -> None:
    """Raises a node's floor to the lower end at which its sure candidates, best first, are enough."""
    by = np.lexsort((-lower, nodes))
    nodes, lower, total = nodes[by], lower[by], np.cumsum(sizes[by])
    before = np.concatenate([[0], total])[np.searchsorted(nodes, nodes)]
    hit = np.flatnonzero(total - before >= enough)
    np.maximum.at(floor, nodes[hit], lower[hit])


def searched(vectors: np.ndarray, labels: np.ndarray, places: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, others: np.ndarray, other_labels: np.ndarray, other_places: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """ask, candidate and score of the k best of each ask, ties to the earlier candidate; and how many pairs were scored.

    vectors, labels, places: of the anchors; owner, low, high: of the asks, owner being the anchor's row. The rest: of the candidates."""
    limits = np.full((2, len(labels), 2), 0, dtype=np.int64)
    for side, of in ((0, low), (1, high)):
        limits[side, :, 0], limits[side, :, 1] = MOST, LEAST
        np.minimum.at(limits[side, :, 0], owner, of)
        np.maximum.at(limits[side, :, 1], owner, of)
    a, b = Tree(vectors, labels, ANCHOR_LEAF), Tree(others, other_labels, CANDIDATE_LEAF)
    x, y, up = leaf_pairs(a, b, limits[0], limits[1], same, k)
    by = np.lexsort((-up, x))
    x, y, up = x[by], y[by], up[by]
    found, scored = [], 0
    for begin, end in _groups(x):
        rows = a.rows(x[begin])
        at = np.full(len(labels), -1)
        at[rows] = np.arange(len(rows))
        asks = np.flatnonzero(at[owner] >= 0)
        best = np.full((len(asks), k), LEAST), np.full((len(asks), k), -1)
        size, step = FIRST, begin
        while step < end and up[step] >= best[0][:, -1].min(initial=MOST):
            stop = step + max(1, int(np.searchsorted(np.cumsum(b.size[y[step:end]]), size)))
            columns = np.sort(np.concatenate([b.rows(n) for n in y[step:stop]]))
            scores = _scores(vectors[rows], others[columns])
            scored += scores.size
            fits = (labels[rows][:, None] == other_labels[columns]) == same
            fits &= places[rows][:, None] != other_places[columns]
            of = scores[at[owner[asks]]]
            fits = fits[at[owner[asks]]] & (of >= low[asks, None]) & (of <= high[asks, None])
            best = _better(*best, np.where(fits, of, LEAST), columns)
            step, size = stop, 2 * size
        row, col = np.nonzero(best[1] >= 0)
        found.append((asks[row], best[1][row, col], best[0][row, col]))
    ask, candidate, score = (np.concatenate(v) for v in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    return ask, candidate, score, scored


def _groups(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(x)) + 1
    return zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(x)]]), strict=True) if len(x) else iter(())


def _better(scores: np.ndarray, columns: np.ndarray, new: np.ndarray, new_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of what is held and what is new, largest first, ties by column; LEAST is no score."""
    k = scores.shape[1]
    every = np.concatenate([scores, new], axis=1)
    kth = np.partition(every, -k, axis=1)[:, -k]
    row, col = np.nonzero((every >= kth[:, None]) & (every > LEAST))
    score = every[row, col]
    place = np.where(col < k, columns[row, np.minimum(col, k - 1)], new_columns[np.maximum(col - k, 0)])
    by = np.lexsort((place, -score, row))
    row, score, place = row[by], score[by], place[by]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    some = nth < k
    out = np.full_like(scores, LEAST), np.full_like(columns, -1)
    out[0][row[some], nth[some]], out[1][row[some], nth[some]] = score[some], place[some]
    return out


ASKS = "array<struct<positive: long, positive_id: long, positive_score: long, low: long, high: long>>"
FOUND = "place long, anchor_id long, positive long, positive_id long, positive_score long, other long, vec_id long, score long"


def _block(same: bool, k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])
        if not anchors.num_rows or not candidates.num_rows:
            return schema.empty_table()
        candidates = candidates.sort_by([("vec_id", "ascending"), ("place", "ascending")])
        lists = anchors.column("asks").combine_chunks()
        asks = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        ids, places, labels = (np.asarray(anchors.column(c)) for c in ("vec_id", "place", "label"))
        other_ids, other_places, other_labels = (np.asarray(candidates.column(c)) for c in ("vec_id", "place", "label"))
        of = {c: np.asarray(asks.field(c)) for c in ("positive", "positive_id", "positive_score", "low", "high")}
        ask, at, score, _ = searched(matrix(anchors.column("vec"), np.int64), labels, places, owner, of["low"], of["high"], matrix(candidates.column("vec"), np.int64), other_labels, other_places, same, k)
        columns = [places[owner[ask]], ids[owner[ask]], *(of[c][ask] for c in ("positive", "positive_id", "positive_score")), other_places[at], other_ids[at], score]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def hard_negatives(vectors: DataFrame, every: int = 100, shifted: int = 7, labels: int = 10, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors with vec_id divisible by every.

    Labels of rows with vec_id divisible by shifted become (label + 1) modulo labels first. A negative's score is from 0.3 to 0.9 of the positive's.
    Rows with a null id, label or vector, an empty vector or a null or non-finite component take no part, nor do vectors whose scaled
    length is 2 ** 31 or more, whose scores a long need not hold; vectors of different lengths are not compared. Rows
    that repeat are anchors, positives and negatives each; ties go to the smaller vec_id. Other columns are not read; an empty table, and an anchor without positives
    or negatives, give no rows."""
    spark = ready(vectors.sparkSession)
    named = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fits, whole = whole_numbers(F.col("v"), scale)
    rows = named.filter(usable(F.col("v")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).filter(fits)
    label = F.when(F.col("vec_id") % shifted == 0, F.expr(f"(label + 1) % {labels}")).otherwise(F.col("label"))
    rows = kept(rows.select("vec_id", label.alias("label"), whole.alias("vec")).withColumn("dim", F.size("vec")).withColumn("place", F.monotonically_increasing_id()), "negatives-rows")
    anchors = kept(rows.filter(F.col("vec_id") % every == 0), "negatives-anchors")
    c_blocks, q_blocks = block_count(rows.count(), 2 * spark.sparkContext.defaultParallelism), block_count(anchors.count(), 1)
    candidates = copied(dealt(rows, "place", c_blocks, "c"), q_blocks, "q").groupBy("dim", "c", "q")

    def best(asks: DataFrame, same: bool, k: int, order: list[str]) -> DataFrame:
        sides = copied(dealt(asks, "place", q_blocks, "q"), c_blocks, "c").groupBy("dim", "c", "q")
        found = sides.cogroup(candidates).applyInArrow(_block(same, k), FOUND)
        rank = F.row_number().over(Window.partitionBy(*order).orderBy(F.desc("score"), "vec_id", "other"))
        return kept(found.withColumn("rank", rank).filter(F.col("rank") <= k), "negatives-found")

    anything = F.expr(f"cast(array(named_struct('positive', 0L, 'positive_id', 0L, 'positive_score', 0L, 'low', {LEAST + 1}L, 'high', {MOST}L)) as {ASKS})")
    near = best(anchors.withColumn("asks", anything), True, positives, ["place"])
    # 3/10 and 9/10 of a score in whole numbers, without a product that overflows
    tenth = F.expr("(score - pmod(score, 10L)) div 10")
    low, high = tenth * 3 + F.expr("(pmod(score, 10L) * 3 + 9) div 10"), tenth * 9 + F.expr("pmod(score, 10L) * 9 div 10")
    asks = near.select("place", F.col("other").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"), high.alias("high")).filter("low <= high")
    asks = asks.groupBy("place").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score", "low", "high")).alias("asks"))  # `positives` of an anchor at most
    far = best(anchors.join(asks, "place"), False, negatives, ["place", "positive"])
    return far.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
