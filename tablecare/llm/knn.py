"""Exact top-k search by inner product: a KD-tree for each shard.

Vectors are split into cells by the first median splits of one coarse tree, fitted on a bounded sample, and cells into
shards of bounded size. Each shard's tree splits at medians of its widest side and keeps a tight box at every node. A
box bounds the inner product with a query by the sum over sides of the larger of query times low and query times high.
A query first searches a shard of the cell with its best bound. The kth score found there goes with it to every other
shard whose cell's bound is not below it, where it prunes nodes from the start.

Components are whole numbers held as doubles. Where all sums with a query stay below 2^53 inner products of doubles are
exact; else doubles choose, with the error that they can have, and Python's whole numbers decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .vectors import BLOCK_QUERIES, SHARD_ROWS, finite, matrix, top

#: Vectors in a leaf, rows that the coarse tree is fitted on, and its cells at most.
LEAF_ROWS, FIT_ROWS, MOST_CELLS = 64, 20_000, 1024
#: Queries that go through a tree together.
QUERIES_AT_ONCE = 8192
#: Components times SCALE are floored.
SCALE = 64
#: Hits of a shard: `more` orders scores that a long does not hold (their whole value in bytes, offset to be above zero).
OWN_HITS, MORE_BYTES = "query_id long, vec_id long, score long, more binary", 520
_MOST = (1 << 63) - 1


class Tree:
    """Median splits with tight boxes; children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.lexsort((ids,))
        self.x, self.ids = x[order], ids[order]
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        nodes = 2 ** (self.depth + 1) - 1
        self.low, self.high = np.zeros((nodes, x.shape[1])), np.zeros((nodes, x.shape[1]))
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)] * nodes
        self.rows[0] = np.arange(len(x))
        for i in range(nodes):
            rows = self.rows[i]
            part = self.x[rows]
            self.low[i], self.high[i] = part.min(axis=0), part.max(axis=0)
            if i < nodes // 2:
                side = int((self.high[i] - self.low[i]).argmax())
                half = np.argpartition(part[:, side], len(rows) // 2)
                self.rows[2 * i + 1], self.rows[2 * i + 2] = rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]
                self.rows[i] = np.zeros(0, np.int64)
        self.leaves = {i: self.x[r] for i, r in enumerate(self.rows) if i >= nodes // 2}
        self.most, self.visited = np.abs(x).max(initial=0), 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return bounds(queries, self.low, self.high)

    def search(self, query: np.ndarray, own: int, reach: np.ndarray, k: int, least: float) -> tuple[np.ndarray, list[int]]:
        """ids and scores of the k best rows other than `own` that are not below `least`; reach: the nodes' bounds."""
        with np.errstate(over="ignore"):
            most = self.most * np.abs(query).max(initial=0) * max(1, len(query))
            error = 0.0 if most < 2.0**53 else most * len(query) * 2.0**-50
        whole = None if not error else [int(x) for x in query]
        heap = [(-reach[0], 0)]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, object if error else float)
        while heap:
            bound, node = heappop(heap)
            if -bound < least:
                break
            if node in self.leaves:
                self.visited += 1
                rows = self.rows[node]
                if error:
                    with np.errstate(over="ignore", invalid="ignore"):
                        got = self.leaves[node] @ query
                        near = ~(got + error < least) & (self.ids[rows] != own)  # what overflows is near
                else:
                    got = self.leaves[node] @ query
                    near = (got >= least) & (self.ids[rows] != own)
                if near.any():
                    new = got[near]
                    if error:
                        new = np.empty(len(new), object)
                        new[:] = [sum(map(mul, whole, map(int, v))) for v in self.leaves[node][near].tolist()]
                    ids, scores = np.concatenate([ids, self.ids[rows[near]]]), np.concatenate([scores, new])
                    at = top(scores, ids, k)
                    ids, scores = ids[at], scores[at]
                    if len(ids) == k:
                        least = max(least, _below(scores[-1]))
            else:
                for child in (2 * node + 1, 2 * node + 2):
                    if reach[child] >= least:
                        heappush(heap, (-reach[child], child))
        return ids, [int(x) for x in scores] if error else scores.astype(np.int64).tolist()

    def exact(self, queries: np.ndarray) -> np.ndarray:
        """Whether all sums with a query are whole numbers that doubles hold."""
        with np.errstate(over="ignore"):
            return self.most * np.abs(queries).max(axis=1, initial=0) * max(1, queries.shape[1]) < 2.0**53

    def search_many(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score) of what search() gives, for queries that are exact, all together.

        In each round every query that is live goes to the leaf with its next best bound; a leaf meets all that come to
        it in one matrix product, and the kth scores that follow decide who is live in the next round.
        """
        leaves = np.array(sorted(self.leaves))
        reach = bounds(queries, self.low[leaves], self.high[leaves])
        order = np.argsort(-reach, axis=1, kind="stable")
        ids, scores = np.full((len(queries), k), _MOST), np.full((len(queries), k), -np.inf)
        kth, live = least.astype(float), np.arange(len(queries))
        for turn in range(len(leaves)):
            aim = order[live, turn]
            near = reach[live, aim] >= kth[live]
            live, aim = live[near], aim[near]
            if not len(live):
                break
            by = np.argsort(aim, kind="stable")
            cuts = np.flatnonzero(np.diff(aim[by])) + 1
            for some in np.split(live[by], cuts):
                leaf = leaves[order[some[0], turn]]
                self.visited += len(some)
                here = self.ids[self.rows[leaf]]
                got = queries[some] @ self.leaves[leaf].T
                got[own[some][:, None] == here] = -np.inf
                hit = (got >= kth[some][:, None]).any(axis=1)
                some, got = some[hit], got[hit]
                if len(some):
                    all_scores = np.concatenate([scores[some], got], 1)
                    all_ids = np.concatenate([ids[some], np.broadcast_to(here, got.shape)], 1)
                    at = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                    ids[some], scores[some] = np.take_along_axis(all_ids, at, 1), np.take_along_axis(all_scores, at, 1)
                    kth[some] = np.maximum(kth[some], scores[some, -1])
        row, place = np.nonzero(scores >= np.maximum(least[:, None], -np.finfo(float).max))
        return row, ids[row, place], scores[row, place].astype(np.int64)


def _below(score) -> float:
    """A double that is not above a whole number."""
    if isinstance(score, float):
        return score
    if abs(score) < 2**53:
        return float(score)
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return float(np.finfo(float).max) if score > 0 else -np.inf


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Highest inner product of each query with any point of each box, and what doubles may round off."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.maximum(np.abs(low), np.abs(high)).max(axis=1, initial=0) * np.abs(queries).max(axis=1, initial=0)[:, None] * queries.shape[1]
        reach = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T + most * max(1, queries.shape[1]) * 2.0**-50
    return np.nan_to_num(reach, nan=np.inf, posinf=np.inf, neginf=np.inf)


class Cells:
    """The coarse tree: sides and medians of its splits, heap order."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = max(0, min(int(np.log2(max(1, cells))), int(np.log2(max(1, len(sample))))))
        n = 2**self.depth - 1
        self.side, self.median = np.zeros(n, np.int64), np.zeros(n)
        parts = {0: sample}
        for i in range(n):
            x = parts.pop(i)
            if len(x):
                self.side[i] = int((x.max(axis=0) - x.min(axis=0)).argmax())
                self.median[i] = np.median(x[:, self.side[i]])
            right = x[:, self.side[i]] > self.median[i]
            parts[2 * i + 1], parts[2 * i + 2] = x[~right], x[right]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.side[node]] > self.median[node])
        return node - (2**self.depth - 1)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(64 x) of every component as a double, which holds it exactly, of the vectors that take part."""
    scaled = F.transform("embedding", lambda x: _floor(x.cast("double") * SCALE))
    return vectors.where(F.col("vec_id").isNotNull() & finite()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")).where(finite("v"))


def _floor(x):
    """The floor as a double; from 2^53 on every double is whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _hits(query_id: np.ndarray, vec_id: np.ndarray, scores: list[int]) -> pa.Table:
    more = [b"" if -_MOST <= s <= _MOST else (s + (1 << 8 * MORE_BYTES - 1)).to_bytes(MORE_BYTES, "big") for s in scores]
    held = [min(max(s, -_MOST - 1), _MOST) for s in scores]
    return pa.table([pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(held, pa.int64()), pa.array(more, pa.binary())], ["query_id", "vec_id", "score", "more"])


def search(vectors: DataFrame, k: int = 20, is_query=None, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query with all other vectors.

    vectors has vec_id and embedding; is_query chooses rows (default: vec_id divisible by 20). Vectors that are null,
    empty or hold null or non-finite components take no part (nor a double that 64-fold is infinite), nor do rows without
    a vec_id. Vectors of another length than a query's are no candidates of it. Rows that repeat a vec_id are candidates
    each, but never of a query with that vec_id; as queries they are one, with the smallest vector. Fewer candidates than
    k give all. Ties go to the smaller vec_id. Scores are ranked by their whole value; one that a long does not hold is
    returned as the nearest long.
    """
    spark = vectors.sparkSession
    is_query = F.pmod("vec_id", F.lit(20)) == 0 if is_query is None else is_query
    data = materialize(whole_numbers(vectors).withColumn("dims", F.size("v")), "vectors")
    parts = [_search(data.where(F.col("dims") == r.dims), is_query, r.dims, r.n, k, shard_rows, block) for r in data.groupBy("dims").agg(F.count("*").alias("n")).collect()]
    out = spark.createDataFrame([], OWN_HITS)
    for part in parts:
        out = out.union(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("more"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(data: DataFrame, is_query, dims: int, n: int, k: int, shard_rows: int, block: int) -> DataFrame:
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1e6 * min(1.0, FIT_ROWS / 2 / n)) + 1
    sample = matrix(data.where(share).select("v").limit(FIT_ROWS).toArrow()["v"], float).reshape(-1, dims)
    cells = Cells(sample, min(MOST_CELLS, -(-n // shard_rows)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cells.of(matrix(batch.column("v"), float))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32))], ["vec_id", "v", "cell"])

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, cell = matrix(batch.column("v"), float), batch.column("cell").to_numpy()
                for c in np.unique(cell):
                    own = x[cell == c]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, c, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(own.min(axis=0)), pa.array(own.max(axis=0)), pa.array(np.full(dims, len(own)))], ["cell", "side", "low", "high", "n"])

    rows = materialize(data.select("vec_id", "v").mapInArrow(placed, "vec_id long, v array<double>, cell int"), "cells")
    found = rows.mapInArrow(boxes, "cell int, side int, low double, high double, n long").groupBy("cell", "side").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    found = found.toPandas().sort_values(["cell", "side"])  # MOST_CELLS boxes at most
    own = found["cell"].to_numpy().reshape(-1, dims)[:, 0]
    low, high = (found[c].to_numpy(float).reshape(-1, dims) for c in ("low", "high"))
    salts = -(-found["n"].to_numpy().reshape(-1, dims)[:, 0] // shard_rows)
    parts = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(own, salts, strict=True) for x in pair]), F.col("cell"))
    shards = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), parts).cast("int"))
    queries = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    blocks = queries.count() // block + 1
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)).cast("int"))

    def aim(first: bool):
        """The shard where a query begins, or all others that may hold a better one."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                reach = bounds(matrix(batch.column("q"), float), low, high)
                ids, home = batch.column("query_id").to_numpy(), reach.argmax(axis=1)
                begin = ids % salts[home]
                if first:
                    row, cell, salt = np.arange(len(ids)), home, begin
                    least = np.full(len(ids), -np.inf)
                else:
                    least = batch.column("least").to_numpy(zero_copy_only=False)
                    row, cell = np.nonzero(reach >= least[:, None])
                    n = salts[cell]
                    salt = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, cell = np.repeat(row, n), np.repeat(cell, n)
                    other = (cell != home[row]) | (salt != begin[row])
                    row, cell, salt = row[other], cell[other], salt[other]
                    least = least[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("q").take(take), batch.column("block").take(take), pa.array(least.astype(float)), pa.array(own[cell].astype(np.int32)), pa.array(salt.astype(np.int32))], ["query_id", "q", "block", "least", "cell", "salt"])

        return work

    aimed = "query_id long, q array<double>, block int, least double, cell int, salt int"

    def visit(wanted: DataFrame) -> DataFrame:
        """Hits of queries in the shards they aim at: a shard meets its queries block by block."""
        keys = wanted.select(*[F.col(c).alias(c) for c in ("cell", "salt", "block")]).distinct()
        own = shards.select("vec_id", "v", *[F.col(c).alias(c) for c in ("cell", "salt")])
        return own.join(keys, ["cell", "salt"]).groupBy("cell", "salt", "block").cogroup(wanted.groupBy("cell", "salt", "block")).applyInArrow(descend, OWN_HITS)

    def descend(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        values: list[int] = []
        if left.num_rows and right.num_rows:
            x, q = matrix(left["v"], float), matrix(right["q"], float)
            tree = Tree(x, left["vec_id"].to_numpy())
            ids, least = right["query_id"].to_numpy(), right["least"].to_numpy()
            whole = tree.exact(q)
            for first in range(0, len(q), QUERIES_AT_ONCE):
                some = first + np.flatnonzero(whole[first : first + QUERIES_AT_ONCE])
                row, got, scores = tree.search_many(q[some], ids[some], k, least[some])
                found.append((ids[some[row]], got))
                values += scores.tolist()
            for i in np.flatnonzero(~whole):
                got, scores = tree.search(q[i], ids[i], tree.bounds(q[i : i + 1])[0], k, least[i])
                found.append((np.full(len(got), ids[i]), got))
                values += scores
        return _hits(*map(np.concatenate, zip(*found, strict=True)), values)

    def under(name: str):
        """A double that is not above a score held as a long: doubles hold 53 bits, and the least long stands for all below it too."""
        x = F.col(name).cast("double")
        return F.when(F.abs(x) < 2.0**53, x).when(F.col(name) > -_MOST - 1, x - F.abs(x) * 2.0**-52)

    begun = materialize(visit(queries.mapInArrow(aim(True), aimed)), "begun")
    kth = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = queries.join(kth, "query_id", "left").select("query_id", "q", "block", F.coalesce(under("kth"), F.lit(float("-inf"))).alias("least"))
    return begun.union(visit(rest.mapInArrow(aim(False), aimed)))
