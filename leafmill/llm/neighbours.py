"""Approximate nearest neighbours by a few stable projections, indexed by kd-trees and searched outwards until a chi-square test holds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.scratch import written

#: Neighbours of a query; projections (an even number); chance that the test grants each neighbour at least; seed of the projections.
NEAREST, PROJECTIONS, CONFIDENCE, SEED = 10, 8, 0.99, 12
#: Points of a block, which is one task's kd-tree, and of a leaf of the tree; queries that one block meets at a time.
BLOCK, LEAF, QUERIES = 8192, 64, 2048
#: Rows whose projections place the cells, at most, and cells at most. The sample only sets borders: every row is in a cell, whatever it is.
SAMPLE, CELLS = 16384, 1024
#: Largest size of a projection that is told from larger ones, so that squares stay finite.
LARGEST = 1e150


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - total


def quantile(chance: float, degrees: int) -> float:
    """Where the distribution function reaches ``chance``."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < chance:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < chance else (low, mid)
    return high


def directions(dim: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """Normal random numbers: the squared distance of two projections, over that of the vectors, is chi-square with ``count`` degrees."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors in double precision; None for null, zero, or with a null or non-finite component."""
    flat = column.flatten()
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    values = np.array(flat.to_numpy(zero_copy_only=False), float)
    out = []
    for ok, a, b in zip(column.is_valid().to_pylist(), np.concatenate(([0], ends[:-1])), ends, strict=True):
        v = values[a:b]
        out.append(v if ok and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _projected(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """(id, dim, vec, spot): usable vectors as bytes of doubles, with their projections; others are left out."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in it:
            found = [(k, v) for k, v in enumerate(_vectors(batch.column(1))) if v is not None]
            spots = []
            for _, v in found:
                if len(v) not in made:
                    made[len(v)] = directions(len(v), count, seed)
                with np.errstate(over="ignore", invalid="ignore"):
                    spots.append(np.clip(np.nan_to_num(v @ made[len(v)], posinf=LARGEST, neginf=-LARGEST), -LARGEST, LARGEST))
            ids = batch.column(0).take(pa.array([k for k, _ in found], pa.int64()))
            columns = [pa.array([len(v) for _, v in found], pa.int32()), pa.array([v.tobytes() for _, v in found], pa.binary()), pa.array(spots, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "dim", "vec", "spot"])

    return rows.mapInArrow(batches, "id long, dim int, vec binary, spot array<double>")


class Borders:
    """Cells of the projected space: the upper levels of a kd-tree, placed by a sample of points."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cuts: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self.root = self._cut(sample, cells)

    def _cut(self, points: np.ndarray, cells: int) -> int:
        """Number of a cut, or of a cell as -1 - cell."""
        axis = int(np.argmax(points.max(0) - points.min(0))) if len(points) > 1 else 0
        at = float(np.median(points[:, axis])) if len(points) else 0.0
        low = points[:, axis] <= at if len(points) else np.zeros(0, bool)
        if cells < 2 or len(points) < 2 or low.all():
            self.cells += 1
            return -self.cells
        k = len(self.cuts)
        self.cuts.append((axis, at, 0, 0))
        self.cuts[k] = (axis, at, self._cut(points[low], cells // 2), self._cut(points[~low], cells - cells // 2))
        return k

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while (inner := at >= 0).any():
            for k in np.unique(at[inner]).tolist():
                axis, edge, low, high = self.cuts[k]
                mine = at == k
                at[mine] = np.where(points[mine, axis] <= edge, low, high)
        return -1 - at


class Tree:
    """A kd-tree over the projections of a block: cuts at medians of the widest axis, leaves of a few points, a box each."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int, int, int]] = []
        self._grow(0, len(points), leaf)

    def _grow(self, a: int, b: int, leaf: int) -> int:
        mine = self.points[self.order[a:b]]
        k, low, high = len(self.nodes), mine.min(0), mine.max(0)
        self.nodes.append((low, high, a, b, -1, -1))
        if b - a > leaf:
            axis, mid = int(np.argmax(high - low)), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(mine[:, axis], mid)]
            self.nodes[k] = (low, high, a, b, self._grow(a, a + mid, leaf), self._grow(a + mid, b, leaf))
        return k

    def outwards(self, spot: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared distance of the leaf's box, numbers of its points), nearest first."""
        todo = [(_to_box(spot, *self.nodes[0][:2]), 0)]
        while todo:
            away, k = heapq.heappop(todo)
            _, _, a, b, *below = self.nodes[k]
            if below[0] < 0:
                yield away, self.order[a:b]
            for child in below:
                if child >= 0:
                    heapq.heappush(todo, (_to_box(spot, *self.nodes[child][:2]), child))


def _to_box(spot: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    gap = np.maximum(low - spot, 0) + np.maximum(spot - high, 0)
    return float(gap @ gap)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, spot: np.ndarray, own: int, count: int, bound: float, edge: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the nearest points of a block that the search meets before it stops, nearest first, ties to the smaller id.

    Leaves come in order of their distance in the projected space. A point whose projection is farther than the root of
    ``edge`` times the distance of the count-th best point so far (or ``bound``, known from elsewhere) is nearer than
    that point with a chance of less than one less the confidence; so the search stops there.
    """
    best = (np.zeros(0, np.int64), np.zeros(0))
    reach = bound
    for away, at in tree.outwards(spot):
        if away > edge * reach * reach:
            break
        gap = tree.points[at] - spot
        at = at[(gap * gap).sum(1) <= edge * reach * reach]
        at = at[ids[at] != own]
        if not len(at):
            continue
        with np.errstate(over="ignore"):
            far = np.sqrt(((vectors[at] - query) ** 2).sum(1))
        got, dist = np.concatenate((best[0], ids[at])), np.concatenate((best[1], far))
        order = np.lexsort((got, dist))[:count]
        best = (got[order], dist[order])
        if len(order) == count:
            reach = min(reach, float(best[1][-1]))
    return best


def _met(pairs: DataFrame, count: int, edge: float) -> DataFrame:
    """(query_id, id, score): the nearest that each query finds in a block; blocks with their queries stand together in a partition, points first.

    A task holds a block of points and one batch of queries.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in it:
            key = np.stack([batch.column(k).to_numpy() for k in range(4)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part, mine = batch.slice(a, b - a), tuple(key[a].tolist())
                if mine != now:
                    now, held, block = mine, [], None
                asked = part.column(4).to_numpy()
                held += [part.filter(pa.array(asked == 0))] if (asked == 0).any() else []
                queries = part.filter(pa.array(asked == 1))
                if not queries.num_rows or not held:
                    continue
                if block is None:
                    points = pa.Table.from_batches(held)
                    spots = np.array(points.column(7).to_pylist(), float)
                    vectors = np.frombuffer(b"".join(points.column(6).to_pylist())).reshape(len(spots), -1)
                    block = Tree(spots), vectors, points.column(5).to_numpy()
                out = []
                for own, vec, spot, bound in zip(*(queries.column(k).to_pylist() for k in (5, 6, 7, 8)), strict=True):
                    ids, dist = search(block[0], block[1], block[2], np.frombuffer(vec), np.array(spot), own, count, bound, edge)
                    out.append((np.full(len(ids), own), ids, dist))
                columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])

    return pairs.mapInArrow(batches, "query_id long, id long, score double")


def nearest(vectors: DataFrame, asked, id_col: str = "vec_id", vector_col: str = "embedding", count: int = NEAREST, confidence: float = CONFIDENCE, projections: int = PROJECTIONS, block: int = BLOCK, queries: int = QUERIES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score): for each row that the condition ``asked`` names, the ``count`` nearest other rows by Euclidean distance.

    Every vector is projected onto a few normal random directions. A sample sets the borders of cells in the projected
    space; every row is in a cell, and a cell is cut into blocks of some ``block`` rows, so neither a dense cell nor copies of one
    vector make a large task. Each block has a kd-tree of its own. A query first searches one block of its cell; the distance
    that it gets there bounds its search, and it goes on to those blocks only whose box is near enough for the
    chi-square test. Queries that meet one block are dealt to several tasks if they are many.

    Each true neighbour is found with a chance of ``confidence`` at least. Distances are exact, on the original vectors in double
    precision, ties go to the smaller id; queries with fewer candidates get them all. Vectors that are null, zero, or
    hold null or non-finite components, and rows of null id, take no part; vectors of other lengths are no candidates. Ids are
    integers; a repeated id is a candidate for other ids as often as it occurs, never for itself, and is asked once, with the least of its vectors. An empty table gives no
    rows; other columns are left out, whatever their names. Distances beyond 1e154 in double vectors may be infinite.
    """
    spark = vectors.sparkSession
    edge = quantile(confidence, projections)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where("id is not null")
    points, _ = written(_projected(rows.select("id", "v"), projections, seed), "points")
    sizes = {r.dim: r.n for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    sample = points.select("dim", "spot").orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).collect()
    borders = {d: Borders(np.array([r.spot for r in sample if r.dim == d], float).reshape(-1, projections), min(CELLS, max(1, n // block))) for d, n in sizes.items()}

    def celled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims = batch.column(1).to_numpy()
            spots = np.array(batch.column(3).to_pylist(), float).reshape(len(dims), projections)
            cell = np.zeros(len(dims), np.int32)
            for d in np.unique(dims).tolist():
                cell[dims == d] = borders[d].cell(spots[dims == d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "dim", "vec", "spot", "cell"])

    placed = points.mapInArrow(celled, "id long, dim int, vec binary, spot array<double>, cell int")
    counts, _ = written(placed.groupBy("dim", "cell").agg(F.count("*").alias("n")), "cells")
    cells = {(r.dim, r.cell): max(1, -(-r.n // block)) for r in counts.collect()}  # at most CELLS rows for each length
    blocks = F.broadcast(spark.createDataFrame([(d, c, n) for (d, c), n in cells.items()], "dim int, cell int, blocks int"))
    dealt, _ = written(placed.join(blocks, ["dim", "cell"]).withColumn("block", F.expr("cast(pmod(xxhash64(id, vec), blocks) as int)")), "blocks")
    boxes_of = dealt.groupBy("dim", "cell").agg(*[F.min(F.get("spot", F.lit(k))).alias(f"l{k}") for k in range(projections)], *[F.max(F.get("spot", F.lit(k))).alias(f"h{k}") for k in range(projections)]).collect()
    boxes: dict[int, list] = {}
    for r in boxes_of:
        boxes.setdefault(r.dim, []).append((r.cell, cells[r.dim, r.cell], np.array(r[2 : 2 + projections]), np.array(r[2 + projections :])))

    wanted = rows.where("asked").select(F.col("id").alias("__id")).distinct()
    asking = dealt.join(wanted, dealt.id == wanted["__id"]).groupBy("id").agg(F.min(F.struct("dim", "vec", "spot", "cell")).alias("q"))
    asking, _ = written(asking.select("id", "q.*", F.lit(math.inf).alias("bound")), "queries")
    first, _ = written(_best(_met(_paired(dealt, asking.withColumn("block", F.lit(0)), queries), count, edge), count), "first")
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") == count, F.max("score")).alias("reach"))
    bounded = asking.drop("bound").join(bounds, asking.id == bounds.query_id, "left").select("id", "dim", "vec", "spot", "cell", F.coalesce("reach", F.lit(math.inf)).alias("bound"))

    def visits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "dim", "vec", "spot", "cell", "bound", "block"]
        for batch in it:
            for k, (dim, spot, home, bound) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 3, 4, 5)), strict=True)):
                at = [(c, b) for c, n, low, high in boxes[dim] if _to_box(np.array(spot), low, high) <= edge * bound * bound for b in range(n) if (c, b) != (home, 0)]
                if at:
                    same = batch.slice(k, 1).take(pa.array([0] * len(at)))
                    cell, number = (pa.array([x[i] for x in at], pa.int32()) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([*same.columns[:4], cell, same.column(5), number], names)

    going = bounded.mapInArrow(visits, "id long, dim int, vec binary, spot array<double>, cell int, bound double, block int")
    going, _ = written(going, "visits")
    found = first.drop("rank").unionByName(_met(_paired(dealt, going, queries), count, edge))
    return _best(found, count).select("query_id", "rank", "id", "score")


def _paired(dealt: DataFrame, going: DataFrame, queries: int) -> DataFrame:
    """Blocks with the queries that visit them, side by side; a block that more than ``queries`` visit is dealt to several tasks."""
    names = ["dim", "cell", "block", "turn", "asked", "id", "vec", "spot", "bound"]
    turns, _ = written(going.groupBy("dim", "cell", "block").agg(F.ceil(F.count("*") / queries).cast("int").alias("turns")), "turns")
    key = ["dim", "cell", "block"]
    points = dealt.join(turns, key).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(*key, "turn", F.lit(0).alias("asked"), "id", "vec", "spot", F.lit(math.inf).alias("bound"))
    asked = going.join(turns, key).withColumn("turn", F.expr("cast(pmod(xxhash64(id), turns) as int)")).select(*key, "turn", F.lit(1).alias("asked"), "id", "vec", "spot", "bound")
    return points.unionByName(asked).select(*names).repartition("dim", "cell", "block", "turn").sortWithinPartitions("dim", "cell", "block", "turn", "asked")


def _best(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each query, ranked from 1; Spark keeps that many a task before it shuffles."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= count).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The ten nearest others of every row whose vec_id is divisible by 100."""
    found = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")

