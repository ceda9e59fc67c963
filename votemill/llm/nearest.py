"""Approximate nearest neighbours by low-dimensional stable projections in kd-trees.

Vectors are projected to PROJECTED dimensions with Gaussian coefficients, which are 2-stable: the squared
projected distance of two points, over their squared distance, follows a chi-square law of that many degrees.
The projections are indexed by a kd-tree in two levels. Its upper level, fitted to SAMPLE vectors at most, cuts the
projected space into cells of about BLOCK_ROWS rows; each cell's rows are a block with a kd-tree of its own. A query
takes projected neighbours from a tree in order of their leaves' distances, a batch of leaves at a time, and verifies with
exact distances those of them that pass the chi-square test: the distribution function, at a point's squared projected
distance over the squared distance of the k-th best so far, is below CONFIDENCE. It stops when no leaf that is left can have
such a point: a closer one would have had to be projected unusually far. A true neighbour is thus missed with a chance of
1 - CONFIDENCE at most. Cells come under the same test: a query searches the cell
that it lies in, and then, with the distance of its k-th best from there, the cells whose bounds do not pass the test.

Every row is indexed. Distinct vectors are entries with their k + 1 smallest ids, which loses nothing for the k nearest
(ties go to the smaller id). A cell that has more entries than a block is dealt over several by a hash of the vector.
Entries come to a block's task before the queries that visit it, and queries stream past the tree, so a task holds one
block and a batch of queries however many there are.

Edge cases: vectors that are null, zero, empty, hold null or non-finite components take no part, nor do rows with a null
id; vectors of another length than the query's have no distance to it and are not its candidates; rows that share an id
count once (that with the smallest distance), as neighbours and as queries; with fewer candidates than k all are
returned; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votemill.llm.common import first_by_hash, in_batches, materialize

PROJECTED, CONFIDENCE, LEAF = 12, 0.95, 32
BLOCK_ROWS, SAMPLE, SEED = 16_384, 50_000, 7
#: Cells at most; beyond BLOCK_ROWS times as many entries, cells are dealt over several blocks.
CELLS_MOST = 20_000
#: Block numbers: the vectors' length, the cell, and the part of a cell that is dealt over several blocks.
DIM_BITS, CELL_BITS, PART_BITS = 20, 16, 24


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """Distribution function of chi-square with an even number m of degrees."""
    half = x / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_bound(p: float, m: int) -> float:
    """The x at which the distribution function is p."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array([mid]), m)[0] < p else (low, mid)
    return high


class KdTree:
    """A balanced kd-tree over points; leaves of LEAF points, with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= LEAF:
                self.leaves.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            stack += [(a + mid, b), (a, a + mid)]
        self.low = np.array([points[self.order[a:b]].min(0) for a, b in self.leaves])
        self.high = np.array([points[self.order[a:b]].max(0) for a, b in self.leaves])

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of q to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(1)


class Cells:
    """The upper level of the tree: splits of the projected space, and the bounds of its cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, threshold, where to go below it and from it on (~cell if negative)
        self.low, self.high = [], []
        self.root = self._cut(sample, min(max(cells, 1), max(len(sample) // 2, 1)), np.full(PROJECTED, -np.inf), np.full(PROJECTED, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _cut(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        axis = int(np.argmax(np.ptp(points, 0))) if len(points) > 1 else 0
        left = cells // 2
        cut = float(np.quantile(points[:, axis], left / cells)) if cells > 1 and len(points) > 1 else 0.0
        below = points[:, axis] < cut if cells > 1 else np.zeros(0, bool)
        if cells <= 1 or not below.any() or below.all():
            self.low.append(low)
            self.high.append(high)
            return ~(len(self.low) - 1)
        at = len(self.nodes)
        self.nodes.append((axis, cut, 0, 0))
        up, down = high.copy(), low.copy()
        up[axis] = down[axis] = cut
        self.nodes[at] = (axis, cut, self._cut(points[below], left, low, up), self._cut(points[~below], cells - left, down, high))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, open_ = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while open_:
            node, at = open_.pop()
            if node < 0:
                out[at] = ~node
            elif len(at):
                axis, cut, a, b = self.nodes[node]
                below = points[at, axis] < cut
                open_ += [(a, at[below]), (b, at[~below])]
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of q to each cell."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(1)


@lru_cache(8)
def matrix_of(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTED))


class Block:
    """Entries (distinct vectors with their smallest ids), their projections and a tree."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.matrix = matrix_of(vectors.shape[1])
        self.points = self.vectors @ self.matrix
        self.tree = KdTree(self.points)
        self.verified = 0  # exact distances computed so far

    def search(self, query_id: int, v: np.ndarray, k: int, bound: float, within: float = math.inf) -> list[tuple[float, int]]:
        """The k nearest found, as (distance, id), smallest first; none farther than within."""
        point = v @ self.matrix
        near = self.tree.leaf_distances(point)
        order = np.argsort(near, kind="stable")
        best: list[tuple[float, int]] = []
        step = 4
        for i in range(0, len(order), step):
            reached = near[order[i]]  # every point not seen yet is projected at least that far
            limit = min(within, best[-1][0]) if len(best) == k else within
            if reached >= bound * limit**2:
                break
            at = np.concatenate([self.tree.order[a:b] for a, b in (self.tree.leaves[x] for x in order[i : i + step])])
            gap = self.points[at] - point
            at = at[(gap * gap).sum(1) < bound * limit**2]
            self.verified += len(at)
            diff = self.vectors[at] - v
            distance = np.sqrt((diff * diff).sum(1))
            keep = distance <= limit
            best += [(d, int(j)) for x, d in zip(at[keep].tolist(), distance[keep].tolist()) for j in self.ids[x] if j != query_id]
            best = nearest_ids(sorted(best), k)
        return best


def nearest_ids(ordered: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The first k of (distance, id), each id once."""
    first: dict[int, float] = {}
    for d, j in ordered:
        if j not in first:
            if len(first) == k:
                break
            first[j] = d
    return [(d, j) for j, d in first.items()]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & fine)


def stacked(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def by_length(column: pa.Array):
    """Rows of a column of vectors by their length: (length, rows, vectors)."""
    sizes = column.value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, stacked(column.take(pa.array(at)), dim)


def cells_of(entries: DataFrame) -> dict[int, Cells]:
    """The cells of each length of vectors, from a sample."""
    sizes = {r["dim"]: r["count"] for r in entries.groupBy(F.size("v").alias("dim")).count().collect()}
    out = {}
    for dim, n in sizes.items():
        points, cells = np.zeros((1, PROJECTED)), min(-(-n // BLOCK_ROWS), CELLS_MOST)
        if cells > 1:
            sample = first_by_hash(entries.filter(F.size("v") == dim).select("v"), "v", SAMPLE).toArrow()
            points = stacked(sample.column("v").combine_chunks(), dim) @ matrix_of(dim)
        out[dim] = Cells(points, cells)
    return out


def number(dim: int, cell: np.ndarray) -> np.ndarray:
    return (np.int64(dim) << (CELL_BITS + PART_BITS)) | (cell.astype(np.int64) << PART_BITS)


def placed(entries: DataFrame, cells) -> DataFrame:
    """v, ids, block: the cell of each entry."""

    def run(batches):
        for batch in batches:
            block = np.zeros(batch.num_rows, np.int64)
            for dim, at, v in by_length(batch.column(0)):
                block[at] = number(dim, cells.value[dim].of(v @ matrix_of(dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=["v", "ids", "block"])

    return in_batches(entries.select("v", "ids"), run, "v array<double>, ids array<long>, block long")


def visits(queries: DataFrame, cells, parts, bound: float, home: bool) -> DataFrame:
    """vec_id, v, within, block: the blocks in which queries search, their own cell's or all others that may hold a nearer one."""

    def run(batches):
        for batch in batches:
            rows, blocks = [], []
            within = batch.column(2).to_numpy(zero_copy_only=False)
            for dim, at, v in by_length(batch.column(1)):
                own = cells.value.get(dim)
                if own is None:
                    continue
                points = v @ matrix_of(dim)
                mine = own.of(points)
                for i, row in enumerate(at.tolist()):
                    found = mine[i : i + 1] if home else np.flatnonzero(own.distances(points[i]) < bound * within[row] ** 2)
                    for b in number(dim, found if home else found[found != mine[i]]).tolist():
                        n = parts.value.get(b, 1)
                        rows += [row] * n
                        blocks += range(b, b + n)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(blocks, pa.int64())], names=["vec_id", "v", "within", "block"])

    return in_batches(queries.select("vec_id", "v", "within"), run, "vec_id long, v array<double>, within double, block long")


def searched(entries: DataFrame, asked: DataFrame, k: int, bound: float) -> DataFrame:
    """query_id, vec_id, score: what the queries find in the blocks that they visit."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = entries.select("block", F.lit(0).alias("kind"), none("long").alias("vec_id"), none("double").alias("within"), "ids", "v")
    rows = rows.unionByName(asked.select("block", F.lit(1).alias("kind"), "vec_id", "within", none("array<long>").alias("ids"), "v"))
    rows = rows.repartition("block").sortWithinPartitions("block", "kind")

    def run(batches):
        now, ids, vectors, block = None, [], [], None
        for batch in batches:
            where, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(where) else []
            out = []
            for a, b in zip(edge[:-1], edge[1:]):
                part = batch.slice(a, b - a)
                if where[a] != now:
                    now, ids, vectors, block = where[a], [], [], None
                own = stacked(part.column(5), int(now >> (CELL_BITS + PART_BITS)))
                if kind[a] == 0:
                    ids += part.column(4).to_pylist()
                    vectors.append(own)
                elif ids:
                    if block is None:
                        block, vectors = Block(ids, np.concatenate(vectors)), []
                    for q, v, w in zip(part.column(2).to_pylist(), own, part.column(3).to_pylist()):
                        out += [(q, j, d) for d, j in block.search(q, v, k, bound, w)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return in_batches(rows, run, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows other than itself."""
    context = rows.sparkSession.sparkContext
    rows, queries = (usable(x, id_col, vector_col).distinct() for x in (rows, queries))
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = rows.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries, "entries")
    cells = context.broadcast(cells_of(entries))
    entries = materialize(placed(entries, cells), "placed")
    large = {r["block"]: -(-r["count"] // (2 * BLOCK_ROWS)) for r in entries.groupBy("block").count().filter(F.col("count") > 2 * BLOCK_ROWS).collect()}
    parts = context.broadcast(large)
    if large:
        share = rows.sparkSession.createDataFrame(list(large.items()), "block long, parts int")  # CELLS_MOST at most
        entries = entries.join(F.broadcast(share), "block", "left").withColumn("block", F.col("block") + F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))))
    bound = chi_square_bound(CONFIDENCE, PROJECTED)
    queries = queries.withColumn("within", F.lit(math.inf))
    found = materialize(ranked(searched(entries, visits(queries, cells, parts, bound, True), k, bound), k), "nearest")
    if all(len(c.low) == 1 for c in cells.value.values()):
        return found
    reached = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    again = queries.join(reached, "vec_id", "left").select("vec_id", "v", F.coalesce("reached", "within").alias("within"))
    more = searched(entries, visits(again, cells, parts, bound, False), k, bound)
    return ranked(found.select("query_id", "vec_id", "score").unionByName(more), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def recall(found: np.ndarray, exact: np.ndarray) -> float:
    """Share of exact neighbours (rows of ids by query) that were found."""
    return float(np.mean([len(set(a) & set(b)) / max(1, len(set(b))) for a, b in zip(found.tolist(), exact.tolist())])) if len(exact) else math.nan
