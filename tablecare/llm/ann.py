"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes with error bounds.

A vector less the common centre is rotated at random and kept as the signs of its components (a packed bit each) with
two scalars: its length and the inner product of its direction with that of its code. From these a query's inner
product with the vector is estimated without bias, with an error that exceeds a known bound with small probability.
Vectors whose upper bound reaches the kth exact score found so far are reranked with their own components. A query
begins in one shard and carries the kth score found there to all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import BLOCK_QUERIES, HITS, SHARD_ROWS, best, finite, matrix, top

#: Width of the error bound in standard errors, and seed of the rotation.
WIDTH, SEED = 2.5, 7


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths, and inner products of directions with their codes'."""
    rest = (x - centre) @ turn.T
    length = np.linalg.norm(rest, axis=1)
    code = np.packbits(rest >= 0, axis=1)
    align = np.abs(rest).sum(axis=1) / np.sqrt(x.shape[1])
    return code, length, np.divide(align, length, out=np.ones_like(length), where=length > 0)


def estimate(code: np.ndarray, length: np.ndarray, align: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with coded vectors, and how far above the true ones may lie."""
    dims = queries.shape[1]
    turned = queries @ turn.T
    signs = np.unpackbits(code, axis=1, count=dims).astype(np.float32) * 2 - 1
    scale = np.maximum(np.abs(turned).max(axis=1, initial=0), np.finfo(float).tiny)[:, None]  # so that single precision holds any query
    raw = ((turned / scale).astype(np.float32) @ signs.T).astype(float) * scale / np.sqrt(dims)
    guess = (queries @ centre)[:, None] + raw / align * length
    spread = np.sqrt(np.maximum(0, 1 - align**2)) / align * length / np.sqrt(max(dims - 1, 1))
    return guess, width * np.linalg.norm(queries, axis=1)[:, None] * spread + 1e-6 * np.abs(guess)


def usable(vectors: DataFrame) -> DataFrame:
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & finite() & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v"), F.size("embedding").alias("dims"))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, dict[int, tuple[int, np.ndarray]]]:
    """(table of coded vectors in shards of bounded size, for each length of vectors its shards and centre)."""
    data = materialize(usable(vectors), "vectors")
    sizes = {r.dims: r.n for r in data.groupBy("dims").agg(F.count("*").alias("n")).collect()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("dims").to_numpy()
            for d in np.unique(kinds):
                x = matrix(batch.column("v").filter(pa.array(kinds == d)), float)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(x.sum(axis=0))], ["dims", "side", "total"])

    totals = {d: np.zeros(d) for d in sizes}
    for r in data.mapInArrow(sums, "dims int, side int, total double").groupBy("dims", "side").agg(F.sum("total").alias("total")).collect():
        totals[r.dims][r.side] = r.total / sizes[r.dims]
    known = {d: (-(-n // shard_rows), totals[d]) for d, n in sizes.items()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("dims").to_numpy()
            for d in np.unique(kinds):
                part = batch.filter(pa.array(kinds == d))
                bits, length, align = encode(matrix(part.column("v"), float), known[d][1], rotation(int(d)))
                ids = part.column("vec_id").to_numpy()
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                shard = (mixed % np.uint64(known[d][0])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), part.column("dims"), pa.array(shard), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(align)], ["vec_id", "v", "dims", "shard", "code", "length", "align"])

    return materialize(data.mapInArrow(code, "vec_id long, v array<double>, dims int, shard int, code binary, length double, align double"), "codes"), known


def search(vectors: DataFrame, k: int = 20, is_query=None, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES, width: float = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query among all other vectors, largest inner product first.

    vectors has vec_id and embedding; is_query chooses rows (default: vec_id divisible by 20). Vectors that are null,
    empty, zero or hold null or non-finite components take no part, nor do rows without a vec_id; vectors of another
    length than a query's are no candidates of it. Scores are exact, in double precision on the original components.
    Ties go to the smaller vec_id. Rows that repeat a vec_id are candidates
    each, but never of a query with it; as queries they are one, with the smallest vector.
    """
    is_query = F.pmod("vec_id", F.lit(20)) == 0 if is_query is None else is_query
    codes, known = index(vectors, shard_rows)
    queries = codes.where(is_query).groupBy(F.col("vec_id").alias("query_id"), "dims").agg(F.min("v").alias("q"))
    blocks = queries.count() // block + 1
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    if not known:
        return best(codes.selectExpr("vec_id AS query_id", "vec_id", "length AS score"), k)
    shards = F.element_at(F.create_map(*[F.lit(int(x)) for d, (n, _) in known.items() for x in (d, n)]), F.col("dims"))
    own = ["dims", "shard", "block"]

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            x, q = matrix(left["v"], float), matrix(right["q"], float)
            ids, query_ids, least = left["vec_id"].to_numpy(), right["query_id"].to_numpy(), right["least"].to_numpy()
            code = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(x), -1)
            length, align = left["length"].to_numpy(), left["align"].to_numpy()
            turn, centre = rotation(x.shape[1]), known[x.shape[1]][1]
            for first in range(0, len(q), 256):
                guess, more = estimate(code, length, align, q[first : first + 256], centre, turn, width)
                for i in range(len(guess)):
                    query, other = q[first + i], ids != query_ids[first + i]
                    upper = np.where(other, np.nan_to_num(guess[i] + more[i], nan=np.inf, posinf=np.inf, neginf=-np.inf), -np.inf)
                    # Highest bound first: the kth score rises with every group, and ends the search.
                    order, at, group, kth = np.argsort(-upper, kind="stable")[: int(other.sum())], 0, 4 * k, least[first + i]
                    best_ids, best_scores = np.zeros(0, np.int64), np.zeros(0)
                    while at < len(order) and not upper[order[at]] < kth:
                        some = order[at : at + group]
                        some = some[~(upper[some] < kth)]
                        best_ids, best_scores = np.concatenate([best_ids, ids[some]]), np.concatenate([best_scores, x[some] @ query])
                        keep = top(best_scores, best_ids, k)
                        best_ids, best_scores = best_ids[keep], best_scores[keep]
                        if len(best_ids) == k:
                            kth = max(kth, best_scores[-1])
                        at, group = at + group, 2 * group
                    out.append((np.full(len(best_ids), query_ids[first + i]), best_ids, best_scores))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    def visit(aimed: DataFrame) -> DataFrame:
        """Hits of queries in the shards they aim at; a shard goes to the blocks of queries that aim at it."""
        afresh = lambda df, names: df.select(*[F.col(c).alias(c) for c in names])  # noqa: E731  all come from one table
        met = afresh(codes, codes.columns).join(afresh(aimed, own).distinct(), ["dims", "shard"])
        return met.groupBy(*own).cogroup(afresh(aimed, aimed.columns).groupBy(*own)).applyInArrow(rerank, HITS.format(kind="double"))

    home = F.pmod(F.xxhash64("query_id", F.lit(1)), shards).cast("int")
    aimed = queries.select("query_id", "q", "dims", "block", shards.alias("shards"), home.alias("home"))
    begun = materialize(visit(aimed.select("query_id", "q", "dims", "block", F.col("home").alias("shard"), F.lit(float("-inf")).alias("least"))), "begun")
    kth = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = aimed.join(kth, "query_id", "left").select("query_id", "q", "dims", "block", F.coalesce("kth", F.lit(float("-inf"))).alias("least"), "home", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    return best(begun.union(visit(rest.where("shard != home").drop("home"))), k)
