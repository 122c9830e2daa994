"""Periodic runs of words: stretches in which words one period apart are the same, found text by text from left to right.

A diagonal is a lag q together with the number of words in a row, up to the present one, that equal the word q before
them. Each word lengthens the diagonals on which it goes on; a diagonal that it ends, if long enough, is a run and is
emitted at once: its stretch is the matched words and the q words before them.

Which earlier occurrences open a diagonal keeps this sparse. A word has one for each level L = 1, 2, 4, ...: the last
earlier place of the L words that end here. It opens the diagonal of its lag if L / 2 < lag <= L. In a stretch of at
least three periods with smallest period q, the last earlier place of q words or more is exactly q words before, so
every run is met at the one level with L / 2 < q <= L. At a level no two diagonals are active together (two periods of
one stretch of L words and more would have a common divisor that is a nearer lag), and a diagonal opens when exactly L
words have matched. So a word costs a few steps a level whatever the text: a word that is every second word of a long
text has as many diagonals as a rare one. A lag that is a multiple of the smallest period never opens.

All texts of a piece of a batch go through a level at once, as arrays; words that stand at no repeated place of L words
don't go to the next level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, column, ragged, runs, slices, text_pieces, unused

#: A run has this many words at least, and its period stands in it this many times at least.
LEAST_WORDS, LEAST_TIMES = 6, 4

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(codes: np.ndarray, row: np.ndarray, words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Runs as rows (row, start, length, period), ordered; codes: a number for each word, row: its text, in ascending order.

    Starts count within all the words given. times must be 3 or more.
    """
    if times < 3:
        raise ValueError("a run is told from a chance repeat by three periods or more")
    n = len(codes)
    first = np.searchsorted(row, row, "left") if n else np.zeros(0, np.int64)  # where each word's text begins
    total = np.searchsorted(row, row, "right") - first if n else first
    at, names = np.arange(n), codes.astype(np.int64)  # places whose last L words repeat or may repeat, and a number for these words
    level, found = 1, []
    while len(at):
        order = np.argsort(names, kind="stable")
        before, here = order[:-1], order[1:]
        same = (names[before] == names[here]) & (row[at[before]] == row[at[here]])
        lag = np.zeros(len(at), np.int64)
        lag[here[same]] = at[here[same]] - at[before[same]]
        open_ = np.flatnonzero((lag > level // 2) & (lag <= level))
        if len(open_):
            place, q = at[open_], lag[open_]
            begins = np.append(True, (np.diff(place) != 1) | (np.diff(q) != 0) | (np.diff(row[place]) != 0))
            begin = np.flatnonzero(begins)
            matched = level + np.diff(np.append(begin, len(open_))) - 1
            q, place = q[begin], place[begin]
            long_ = matched + q >= np.maximum(words, times * q)
            found.append(np.stack([row[place], place - level + 1 - q, matched + q, q], 1)[long_])
        # On to the next level: both halves of its words must repeat in the text, and a run of its lags must fit in.
        again = np.zeros(len(at), bool)
        again[before[same]] = again[here[same]] = True
        again &= total[at] >= times * (level + 1)
        dense = np.cumsum(np.append(0, names[order[1:]] != names[order[:-1]]))
        number = np.empty(len(at), np.int64)
        number[order] = dense
        half = np.full(n, -1, np.int64)
        half[at[again]] = number[again]
        at = at[again]
        at = at[at - first[at] >= 2 * level - 1]
        at = at[half[at - level] >= 0]
        names = half[at - level] * (int(dense[-1]) + 1) + half[at]
        level *= 2
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def collapse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int, found: np.ndarray) -> pa.Array:
    """Each row's words joined by one space, without those that stand in a run after its first period."""
    covers = np.zeros(len(starts) + 1, np.int64)
    np.add.at(covers, found[:, 1] + found[:, 3], 1)
    np.add.at(covers, found[:, 1] + found[:, 2], -1)
    keep = np.cumsum(covers[:-1]) == 0
    starts, ends, row = starts[keep], ends[keep], row[keep]
    size = ends - starts + 1  # with the space after it, but for a row's last word
    after = np.cumsum(size)
    out = np.append(data, np.uint8(0x20))[ragged(starts, size)]
    out[after - 1] = 0x20
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    out = np.delete(out, after[last] - 1)
    offsets = np.zeros(rows + 1, np.int64)
    np.add.at(offsets, row + 1, size - last)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(np.cumsum(offsets)), pa.py_buffer(out))


def find(docs: DataFrame, text: str = "text", words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """The table with three more columns: n_words, runs (start, length, period by start, then period) and collapsed.

    A run is a stretch of `words` words or more in which its smallest period stands `times` times or more and that no
    neighbouring word extends; words end at white space and count from 0. collapsed joins by one space the words that
    no run contains after its first period. A null or empty text has no words, no runs and an empty collapsed text.
    Every row has one row, repeated ones too; columns of these names are left alone (the new ones get underscores).
    """
    n_words, found, collapsed, own = unused(docs, "n_words", "runs", "collapsed", "own_runs")

    @F.arrow_udf(f"struct<n_words: bigint, runs: array<{RUN}>, collapsed: string>")
    def scan(texts: pa.Array) -> pa.Array:
        parts = [_scan(to - row, data, offsets, words, times) for row, to, data, offsets in text_pieces(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], _RESULT)

    scan = scan.asNondeterministic()  # so that it is not evaluated once for each column made of it
    return docs.withColumn(own, scan(column(text))).withColumns({n: F.col(f"{own}.{k}") for n, k in ((n_words, "n_words"), (found, "runs"), (collapsed, "collapsed"))}).drop(own)


_RESULT = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _scan(rows: int, data: np.ndarray, offsets: np.ndarray, words: int, times: int) -> pa.Array:
    starts, ends, row = runs(data, offsets, NON_SPACE)
    found = find_runs(slices(data, starts, ends).dictionary_encode().indices.to_numpy(), row, words, times)
    counts = np.bincount(row, minlength=rows)
    before = np.cumsum(counts) - counts
    each = np.cumsum(np.append(0, np.bincount(found[:, 0], minlength=rows)))
    structs = pa.StructArray.from_arrays([pa.array(found[:, 1] - before[found[:, 0]]), pa.array(found[:, 2]), pa.array(found[:, 3])], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(each, pa.int32()), structs)
    return pa.StructArray.from_arrays([pa.array(counts), lists, collapse(data, starts, ends, row, rows, found).cast(pa.string())], ["n_words", "runs", "collapsed"])
