"""Passages that repeat across documents: sliding spans of sentences and windows of words, hashed, joined globally,
removed but for the first.

A sentence ends before white space that follows `.`, `!` or `?` (quotes and brackets may stand between) or holds a
line end.

A span is a run of at least SENTENCES sentences and WORDS words with no sentence to spare at its end, or none at its
start. Sentence spans do not see a passage without so many whole sentences, or pasted into the middle of others, so a
span is also a window of WORDS words whose hash is the least, and of equals the last, of WORDS windows that start one
after another. Of any 2 * WORDS - 1 words the least window hangs on them alone, so all places of a passage of so many
words share a window wherever its ends fall in sentences, and windows taken leave no gap between them: at most
WORDS - 1 words at either end of a passage stay.

A hash is over a span's words in lower case (A-Z), without white space. Of the places of a hash the first, by doc_id and
then by place, stays; words that any other place covers go, but for places that overlap the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, byte_set, column, drop_table, lower_ascii, materialize, mixed, runs, text_pieces, unused, word_codes

#: Sentences and words of a span at least.
SENTENCES, WORDS = 2, 25

_STOP = byte_set((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
_INNER = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LINE = byte_set((0x0A, 0x0D))
_BASE = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        x = np.full(n + 1, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Sentences:
    """Words and sentences of a run of texts: sentence s is words first[s] to first[s + 1], in text row[s]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        self.starts, ends, word_row = runs(data, offsets, NON_SPACE)
        n = len(self.starts)
        lowered = lower_ascii(data)
        self.codes = [word_codes(lowered, self.starts, ends, seed) for seed in (0, 1)]
        begins = np.zeros(n, bool)
        if n:
            begins[0] = True
            begins[1:] = word_row[1:] != word_row[:-1]
            # A stop after the last letter or digit of the word before.
            at = np.arange(len(data))
            bounds = np.ravel(np.column_stack([self.starts, ends]))
            bounds = bounds[:-1] if bounds[-1] == len(data) else bounds
            last = lambda marks: np.maximum.reduceat(np.where(marks, at, -1), bounds)[::2]
            stopped = last(_STOP[data]) > last(_INNER[data])
            lines = np.concatenate([[0], np.cumsum(_LINE[data])])
            begins[1:] |= stopped[:-1] | (lines[self.starts[1:]] > lines[ends[:-1]])
        self.first = np.append(np.flatnonzero(begins), n)
        self.row = word_row[self.first[:-1]]
        #: Words before each text's first, and the words of all.
        self.words = np.searchsorted(word_row, np.arange(len(offsets)))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First sentence and sentence after the last of every span."""
        count = len(self.row)
        at = np.arange(count)
        # Fewest sentences from here on, or up to here, that have the words.
        ahead = np.maximum(np.searchsorted(self.first, self.first[:-1] + WORDS, "left"), at + SENTENCES)
        back = np.minimum(np.searchsorted(self.first, self.first[1:] - WORDS, "right") - 1, at + 1 - SENTENCES)
        begin, end = np.concatenate([at, back]), np.concatenate([ahead, at + 1])
        ok = (begin >= 0) & (end <= count)
        begin, end = begin[ok], end[ok]
        ok = self.row[begin] == self.row[end - 1]
        both = np.unique(begin[ok] * (count + 1) + end[ok])
        return both // (count + 1), both % (count + 1)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of each span's words."""
        return self.word_hashes(self.first[begin], self.first[end])

    def word_hashes(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of the words from a to b."""
        out = []
        for code, base in zip(self.codes, _BASE, strict=True):
            power, inverse = _power(base, len(code))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:-1], dtype=np.uint64)])
            out.append(mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)).view(np.int64))
        return out

    def windows(self) -> np.ndarray:
        """First words of the windows taken."""
        left = np.repeat(self.words[1:], np.diff(self.words)) - np.arange(len(self.starts))
        count = len(left) - WORDS + 1
        if count < WORDS:
            return np.zeros(0, np.int64)
        at = np.arange(count)
        least = self.word_hashes(at, at + WORDS)[0]

        def smaller(to: int) -> None:
            """Each least value and its place also covers what begins `to` later."""
            nonlocal at, least
            later = least[to:] <= least[:-to]
            at, least = np.where(later, at[to:], at[:-to]), np.where(later, least[to:], least[:-to])

        held = 1
        while held < WORDS:
            step = min(held, WORDS - held)
            smaller(step)
            held += step
        return np.unique(at[left[: len(at)] >= 2 * WORDS - 1])


def _spans(docs: DataFrame) -> DataFrame:
    """h1, h2, id, copy, begin, n (words) for every span of docs (id, copy, text); copy tells apart texts under one identifier."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, offsets in text_pieces(batch.column("text")):
                found = Sentences(data, offsets)
                begin, end = found.spans()
                windows = found.windows()
                begin, end = np.concatenate([found.first[begin], windows]), np.concatenate([found.first[end], windows + WORDS])
                if not len(begin):
                    continue
                at = np.searchsorted(found.words, begin, "right") - 1
                h1, h2 = found.word_hashes(begin, end)
                own = [batch.column(c).slice(row, to - row).take(pa.array(at)) for c in ("id", "copy")]
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), *own, pa.array((begin - found.words[at]).astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["h1", "h2", "id", "copy", "begin", "n"])

    return docs.mapInArrow(work, "h1 long, h2 long, id long, copy long, begin int, n int")


def repeated(docs: DataFrame) -> DataFrame:
    """id, copy, spans (begin, n in words) that non-first places of repeated spans cover, and first_ids, one row a document."""
    spans = materialize(_spans(docs), "spans")
    # Written, so that a hash that very many places share is only a skewed side of a plain join, which Spark splits.
    often = materialize(spans.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h1", "h2"), "often")
    hits = materialize(spans.join(often, ["h1", "h2"], "left_semi"), "repeated")  # few of all
    drop_table(spans)
    drop_table(often)
    place = F.struct("id", "copy", "begin")
    firsts = materialize(hits.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h1", "h2", "first"), "firsts")
    first = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.copy") == F.col("copy"))
    hit = hits.join(firsts, ["h1", "h2"]).where(~(first & (F.col("begin") < F.col("first.begin") + F.col("n"))))
    return hit.groupBy("id", "copy").agg(F.collect_set(F.struct("begin", "n")).alias("spans"), F.sort_array(F.collect_set("first.id")).alias("first_ids"))


def remove_repeats(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with repeated passages cut out of text, and <prefix>n_removed, <prefix>removed, <prefix>first_ids.

    docs has doc_id (an integer), text and any other columns; new columns replace others of their names. removed lists
    the (begin, n) of the runs of words that went, n_removed counts the sentences that lose words, and first_ids lists,
    ascending, the documents where the removed spans stand first. A null text stays null; a text that loses nothing
    stays as it is to the byte; one that loses all becomes empty. Rows with the same doc_id and text count as one
    document, so none of them is another's repeat. No rows give no rows.
    """
    id_, copy, mark_id, mark_copy, spans, first, cut = unused(docs, "id", "copy", "mark_id", "mark_copy", "spans", "first", "cut")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), copy: F.xxhash64("text")})
    marks = repeated(docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("copy"), "text"))
    marks = materialize(marks, "marks").select(F.col("id").alias(mark_id), F.col("copy").alias(mark_copy), F.col("spans").alias(spans), F.col("first_ids").alias(first))

    @F.arrow_udf("struct<text: string, n_removed: int, removed: array<struct<begin: int, n: int>>>")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out, gone, removed = [], [], []
        for row, to, data, offsets in text_pieces(texts):
            if not len(data):
                out += [None] * (to - row)
                gone += [0] * (to - row)
                removed += [[]] * (to - row)
                continue
            found = Sentences(data, offsets)
            for k in range(row, to):
                marks, base, n = spans[k], found.words[k - row], int(found.words[k - row + 1] - found.words[k - row])
                if not marks.is_valid:
                    out.append(None)
                    gone.append(0)
                    removed.append([])
                    continue
                covered = np.zeros(n, bool)
                for m in marks.as_py():
                    covered[m["begin"] : m["begin"] + m["n"]] = True
                begin = np.append(found.starts[base : base + n], offsets[k - row + 1])
                # The first words of runs that stay or go, and the end.
                turns = np.concatenate([[0], np.flatnonzero(covered[1:] != covered[:-1]) + 1, [n]])
                head = data[offsets[k - row] : begin[0]].tobytes()
                out.append((head + b"".join(data[begin[a] : begin[b]].tobytes() for a, b in zip(turns, turns[1:], strict=False) if not covered[a])).decode())
                gone.append(len(np.unique(np.searchsorted(found.first, base + np.flatnonzero(covered), "right"))))
                removed.append([{"begin": int(a), "n": int(b - a)} for a, b in zip(turns, turns[1:], strict=False) if covered[a]])
        kinds = [pa.string(), pa.int32(), pa.list_(pa.struct([("begin", pa.int32()), ("n", pa.int32())]))]
        return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip((out, gone, removed), kinds, strict=True)], ["text", "n_removed", "removed"])

    without = without.asNondeterministic()  # so that a filter on what it gives does not evaluate it twice
    # Only marked texts go to Python.
    marked = F.when(F.col(spans).isNotNull(), F.col("text"))
    joined = keyed.join(marks, F.col(id_).eqNullSafe(F.col(mark_id)) & (F.col(copy) == F.col(mark_copy)), "left").withColumn(cut, without(marked, F.col(spans)))
    more = {f"{prefix}n_removed": F.col(f"{cut}.n_removed"), f"{prefix}removed": F.col(f"{cut}.removed"), f"{prefix}first_ids": F.coalesce(F.col(first), F.array().cast("array<long>"))}
    return joined.withColumns({"text": F.coalesce(f"{cut}.text", "text"), **more}).drop(id_, copy, mark_id, mark_copy, spans, first, cut)


def keep_first_passages(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out, and n_chars as it then is; rows left without a word by the cut go."""
    prefix = "cut_"
    while {f"{prefix}{n}".lower() for n in ("n_removed", "removed", "first_ids")} & {c.lower() for c in docs.columns}:
        prefix += "_"
    cut = remove_repeats(docs, prefix)
    lost = F.col(f"{prefix}n_removed") > 0
    whole = cut.where(~lost | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return whole.select(*[n_chars.alias(c) if c == "n_chars" else column(c) for c in docs.columns])
