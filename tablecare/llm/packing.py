"""Packing documents into sequences of bounded length: a configuration linear program over the length histogram.

The program has a column for every multiset of lengths that fits into a sequence. Where the histogram has many bars,
near lengths share a class, rounded up. The program is solved by multiplicative weights on the classes' coverage; the
column that the weights ask for comes from a knapsack dynamic program that prices a piece at its class's weight over
its demand. Amounts are rounded down, what they leave is solved again, and a class column becomes columns of lengths
by taking each class's pieces longest first. Room that rounding up left in a sequence is filled best fit from what no
column has taken yet, so later columns need fewer sequences. All of this works on the histogram, which has at most
`capacity` bars whatever the input; Spark gives the pieces of each length their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, text_pieces
from .tokens import crc_of, encoder, with_end

#: Tokens of a sequence, rounds of multiplicative weights in each pass, and the weights' step.
CAPACITY, ROUNDS, STEP = 2048, 400, 0.25
#: Classes of near lengths; pieces under this share of a sequence are kept to fill the room that classes leave.
CLASSES, FILLER = 128, 1 / 8
#: Shares of the program's sequences, the emptiest, that are packed again with what it leaves.
REPACKED = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4)
#: Groups that pieces of one length are ranked in: a length may hold a third of all pieces.
RANK_BUCKETS, ROWS_A_BUCKET = 256, 100_000


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length (ascending) stands in the most valuable multiset that fits."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fits[room]:
            worth = best[room - lengths[:k]] + values[:k]
            i = int(worth.argmax())
            if worth[i] > best[room]:
                best[room], took[room] = worth[i], i
    counts, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= lengths[took[room]]
    return counts


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[np.ndarray, float]]:
    """Columns and amounts by multiplicative weights: a class's price is its weight over its demand, and falls as it is covered."""
    covered, amounts, columns = np.zeros(len(lengths)), {}, {}
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        column = np.zeros(len(lengths), np.int64)
        # A class that lags behind the others is worth more; lengths break ties between what is equally covered.
        column[open_] = knapsack(lengths[open_], np.exp(-covered[open_] / step) / demand[open_] + 1e-9 * lengths[open_], capacity)
        column = np.minimum(column, np.ceil(demand)).astype(np.int64)
        used = column > 0
        amount = min(step * float((demand[used] / column[used]).min()), float(((1 - covered[used]) * demand[used] / column[used]).max()))
        covered[used] += amount * column[used] / demand[used]
        key = column.tobytes()
        columns[key] = column
        amounts[key] = amounts.get(key, 0.0) + amount
    return sorted(((columns[k], n) for k, n in amounts.items()), key=lambda c: -c[1])


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """What is left, longest first: a sequence takes the longest that still fits, and is repeated while supplies last."""
    left, out = left.copy(), []
    while len(live := np.flatnonzero(left)):
        column = np.zeros(len(lengths), np.int64)
        _top_up(lengths, left, column, capacity, live)
        used = column > 0
        times = int((left[used] // column[used]).min())
        left -= times * column
        out.append((column, times))
    return out


def _top_up(lengths: np.ndarray, left: np.ndarray, column: np.ndarray, room: int, top: np.ndarray) -> None:
    """Add to a column the longest of the lengths `top` that fit, as many as there are."""
    while len(top := top[lengths[top] <= room]):
        i = top[-1]
        n = min(int(left[i] - column[i]), room // int(lengths[i]))
        column[i] += n
        room -= n * int(lengths[i])
        top = top[:-1]


class _Supply:
    """Pieces of each length that no sequence has yet, and the class of each length."""

    def __init__(self, lengths: np.ndarray, supply: np.ndarray, capacity: int):
        self.lengths, self.left, self.capacity = lengths, supply.copy(), capacity
        unit = 1 if len(lengths) <= CLASSES else -(-capacity // CLASSES)
        self.rooms = capacity // unit
        #: Classes in units of the capacity; filler has none.
        self.size = -(-lengths // unit)
        self.size[lengths < FILLER * capacity if unit > 1 else np.zeros(len(lengths), bool)] = 0
        self.size[self.size > self.rooms] = 0  # no class column holds it: best fit does
        self.columns: dict[bytes, list] = {}

    def demand(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(self.size, weights=self.left, minlength=self.rooms + 1)
        n[0] = 0
        return np.flatnonzero(n), n[n > 0]

    def take(self, classes: np.ndarray, counts: np.ndarray, times: int) -> None:
        """Fill up to `times` sequences with so many pieces of each class, longest first.

        Where classes are rounded up, the piece of the smallest class is whatever fits the room that is really left best.
        """
        while times:
            column, run = np.zeros(len(self.lengths), np.int64), times
            for at, (c, n) in enumerate(zip(classes, counts, strict=True)):
                if at == 0 and self.rooms < self.capacity and counts.sum() > 1:
                    n -= 1
                own = np.flatnonzero((self.size == c) & (self.left > 0))[::-1]
                for i in own:
                    if not n:
                        break
                    k = min(int(n), int(self.left[i]))
                    column[i] = k
                    n -= k
                if n:
                    return
            room = self.capacity - int(column @ self.lengths)
            _top_up(self.lengths, self.left, column, room, np.flatnonzero(self.left - column))
            used = column > 0
            run = min(run, int((self.left[used] // column[used]).min()))
            self.left -= run * column
            self.columns.setdefault(column.tobytes(), [column, 0])[1] += run
            times -= run


def program(lengths: np.ndarray, supply: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """(columns of lengths with how many sequences each, what they leave). Each pass solves what is left and rounds it down.

    A pass whose amounts are all below one takes its largest column once, so that every pass places something.
    """
    held = _Supply(lengths, supply, capacity)
    while True:
        sizes, demand = held.demand()
        if len(sizes) == 0 or demand.sum() < 2:
            break
        found = fractional(sizes, demand, held.rooms, rounds, step)
        whole = [(column, int(amount)) for column, amount in found if amount >= 1]
        few = not whole
        # Long pieces first: short ones fit in more places.
        for column, times in sorted(whole or [(column, 1) for column, _ in found], key=lambda c: -int(np.flatnonzero(c[0])[-1])):
            used = column > 0
            left = np.bincount(held.size, weights=held.left, minlength=held.rooms + 1)[sizes[used]]
            times = min(times, int((left // column[used]).min()))
            if times:
                held.take(sizes[used], column[used], times)
        if few:
            break
    return [(column, times) for column, times in held.columns.values()], held.left


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP) -> tuple[list[tuple[dict[int, int], int]], int]:
    """([(length -> how many, how many sequences like this)] that together hold the histogram exactly, pieces placed by the program).

    Best fit places what the program leaves, together with the emptiest of the program's sequences. Of the shares tried,
    and best fit alone, the one with the fewest sequences in all stands, and of equals the one with the most pieces placed
    by the program.
    """
    lengths = np.array(sorted(histogram), np.int64)
    supply = np.array([histogram[int(n)] for n in lengths], np.int64)
    columns, left = program(lengths, supply, capacity, rounds, step) if len(lengths) else ([], supply)
    plans = [(best_fit(lengths, supply, capacity), 0)]
    plans += [_repacked(lengths, columns, left, capacity, share) for share in REPACKED]
    best, placed = min(plans, key=lambda p: (sum(n for _, n in p[0]), -p[1]))
    return [({int(lengths[i]): int(c[i]) for i in np.flatnonzero(c)}, n) for c, n in best], placed


def _repacked(lengths: np.ndarray, columns: list[tuple[np.ndarray, int]], left: np.ndarray, capacity: int, share: float) -> tuple[list[tuple[np.ndarray, int]], int]:
    """(all columns, pieces in the program's): the emptiest share of the program's sequences joins what is left, best fit."""
    kept, left, out = [], left.copy(), int(share * sum(n for _, n in columns))
    for column, times in sorted(columns, key=lambda c: int(c[0] @ lengths)):
        gone = min(out, times)
        out -= gone
        left += gone * column
        if times > gone:
            kept.append((column, times - gone))
    return kept + best_fit(lengths, left, capacity), int(sum(n * c.sum() for c, n in kept))


def slots(columns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, pieces a sequence and first offset of every column that has it."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for column, times in columns:
        offset = 0
        for length, n in sorted(column.items(), reverse=True):
            out.setdefault(length, []).append((rank.get(length, 0), sequence, n, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in out.items()}


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32. Only the first piece of a cut one is shorter."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for row, to, data, offsets in text_pieces(batch.column("text")):
                ids, ends = with_end(*encode(data, offsets))
                sizes = np.diff(ends)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(to - row), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                stop = sizes[doc] - (pieces[doc] - 1 - piece) * capacity
                start = np.maximum(stop - capacity, 0)
                crc = [crc_of(ids[a:b]) for a, b in zip(ends[doc] + start, ends[doc] + stop, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, to - row).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = RANK_BUCKETS, rounds: int = ROUNDS) -> DataFrame:
    """sequence_id and offset for every row of pieces (doc_id, piece, start, length, ids_crc32; a table that reads the same each time)."""
    bars = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    plan = slots(solve({int(r.length): int(r.n) for r in bars}, capacity, rounds)[0])
    buckets = max(buckets, sum(r.n for r in bars) // ROWS_A_BUCKET)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    before = (
        keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).select(*pieces.columns, "rank")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    first, start, n, at = plan[int(length[rows[0]])]
                    k = np.searchsorted(first, rank[rows], "right") - 1
                    inside = rank[rows] - first[k]
                    sequence[rows] = start[k] + inside // n[k]
                    offset[rows] = at[k] + inside % n[k] * length[rows]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(work, ", ".join([*names, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Place all documents (doc_id, text) in as few sequences of at most capacity tokens as the program finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; a piece is ids start to start + length of its
    document, the end id included. A null or empty text is one piece with the end id alone. A repeated row or id gives
    pieces of its own; ids may be null. No rows give no rows. Other columns of docs are not read.
    """
    return place(materialize(cut(docs, tokenizer, capacity), "pieces"), capacity)
