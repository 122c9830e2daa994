"""Scoring of documents by language models learned from the corpus: prediction by partial matching, and word counts.

The byte model is a trie of contexts of up to ORDER bytes, pretrained on the training documents. A symbol is predicted
in the longest context that training has seen; where it never followed there, the model escapes (method C: distinct
symbols against occurrences) to the next shorter context with the symbols already ruled out excluded from its counts,
and at last to a uniform choice of the bytes never seen. A symbol that followed a context also followed each of its
suffixes, so what is excluded at a context depends on the next longer one only, and a symbol's probability depends on
the symbol and ORDER bytes before it alone. The trie is therefore a table of byte strings of ORDER + 1, counted and
priced by Spark; a document's score is the sum over its byte strings.

Words are told apart by 63 bits of a hash, so word counts are exact up to its collisions.

Prices of the FREQUENT_KEYS most frequent strings and words at most are broadcast; occurrences of all others are
joined with theirs. Counting and looking up go by a key's place in an array; keys that share a place are kept exactly, by
sorting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NON_SPACE, crc_of_id, drop_table, lower_ascii, materialize, runs, text_pieces, word_codes

#: Bytes of the longest context; added to every word count; entries broadcast at most.
ORDER, SMOOTHING, FREQUENT_KEYS = 5, 0.1, 1_000_000
#: Bytes that no UTF-8 text holds: what stands before a text, and the symbol that ends it.
BEFORE, END = 0xFE, 0xFF
#: Symbols: all bytes but BEFORE.
SYMBOLS = 255
#: Text is worked on in pieces of so many bytes, whose arrays stay near the processor.
PIECE_BYTES = 1 << 18
#: Places for keys in a task's table of counts (a power of two); keys that found theirs taken are given out at so many.
PLACES, HELD_KEYS = 1 << 21, 800_000

_WORD = np.uint64(1 << 63)  # marks a word's key: negative as a signed number
_END_KEY = (np.uint64(xxhash.xxh64_intdigest(b"")) | _WORD).view(np.int64)
_NO_KEY = 1 << 62  # neither a string nor a word


def strings(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The string of ORDER + 1 bytes that ends at each symbol (the end included), and the texts' offsets in them."""
    rows = np.arange(len(offsets) - 1) * (order + 1)
    symbol = np.ones(len(data) + (order + 1) * len(rows), bool)
    for k in range(order):
        symbol[offsets[:-1] + rows + k] = False
    ends = offsets[1:] + rows + order
    inner = symbol.copy()
    inner[ends] = False
    padded = np.full(len(symbol) + 7, BEFORE, np.uint8)
    padded[7:][inner] = data
    padded[7:][ends] = END
    eight = np.ndarray((len(symbol),), ">u8", padded, strides=(1,))  # the 8 bytes up to each place
    code = eight.astype(np.uint64)
    code &= np.uint64((1 << 8 * (order + 1)) - 1)
    return code[symbol].view(np.int64), offsets + np.arange(len(offsets))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each place's word, ends of texts last, and the place's text."""
    starts, ends, row = runs(data, offsets, NON_SPACE)
    rows = len(offsets) - 1
    return np.append((word_codes(data, starts, ends) | _WORD).view(np.int64), np.full(rows, _END_KEY)), np.append(row, np.arange(rows))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in any order, and each value's place among them."""
    found = pa.array(values).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def places(keys: np.ndarray, among: int) -> np.ndarray:
    """The place of each key among so many (a power of two)."""
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - among.bit_length())).view(np.int64)


class Lookup:
    """Values of keys, the most wanted keys first: a key whose place an earlier one has is searched for among the others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = places(keys, among := 1 << max(2 * len(keys), 2).bit_length())
        self.keys, self.values = np.full(among, _NO_KEY), np.zeros(among)
        self.keys[at[::-1]] = keys[::-1]  # of keys with one place the last one written stays
        own = self.keys[at] == keys
        self.values[at[own]] = values[own]
        left = np.flatnonzero(~own)
        left = left[np.argsort(keys[left])]
        self.other_keys, self.other_values = np.append(keys[left], _NO_KEY), np.append(values[left], 0.0)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each, 0 for what is not there, and the indexes of what is not there."""
        at = places(wanted, len(self.keys))
        found = self.values[at]
        left = np.flatnonzero(self.keys[at] != wanted)
        some, which = distinct(wanted[left])
        at = np.searchsorted(self.other_keys[:-1], some)
        here = self.other_keys[at] == some
        found[left] = np.where(here, self.other_values[at], 0.0)[which]
        return found, left[~here[which]]


def count(docs: DataFrame, among: int = PLACES) -> DataFrame:
    """key, n, n_train: occurrences of every byte string and word in docs (text, _train), and those in training rows.

    A task counts a key at its place of `among`, which the first key that comes there keeps; others are sorted now and then.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts = np.full(among, _NO_KEY), np.zeros((2, among), np.int64)
        others: tuple[list[np.ndarray], ...] = ([], [])

        def out(keys: np.ndarray, n: np.ndarray, n_train: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(pa.array, (keys, n, n_train))), ["key", "n", "n_train"])

        def given_out() -> Iterator[pa.RecordBatch]:
            for own, held in enumerate(others):
                if held:
                    keys, n = np.unique(np.concatenate(held), return_counts=True)
                    held.clear()
                    yield out(keys, n, n * own)

        for batch in batches:
            for own in (0, 1):
                for _, _, data, offsets in text_pieces(batch.column("text").filter(pc.equal(batch.column("_train"), bool(own))), PIECE_BYTES):
                    data = lower_ascii(data)
                    for keys in (strings(data, offsets)[0], words(data, offsets)[0]):
                        at = places(keys, among)
                        found = kept[at]
                        free = np.flatnonzero(found == _NO_KEY)
                        kept[at[free]] = keys[free]
                        found[free] = kept[at[free]]
                        np.add.at(counts[own], at, 1)
                        left = np.flatnonzero(found != keys)
                        if len(left):
                            np.subtract.at(counts[own], at[left], 1)
                            others[own].append(keys[left])
            if sum(map(len, others[0])) + sum(map(len, others[1])) > HELD_KEYS:
                yield from given_out()
        yield from given_out()
        at = np.flatnonzero(kept != _NO_KEY)
        yield out(kept[at], counts[:, at].sum(axis=0), counts[1, at])

    # A task gives out a key once or nearly so: keys are dealt before they are grouped, not grouped twice.
    given = docs.select("text", "_train").mapInArrow(work, "key long, n long, n_train long")
    return given.repartition("key").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def prices(totals: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[DataFrame]]:
    """(key, n, value: a byte string's log10 probability, a word's training count; the tables that it still reads).

    A level's table has every string of its length that ends one of the keys, with its training count. Strings that share
    a context, or all bytes but the first, are 256 at most, so every window here is small and no key is hot.
    """
    # Down: the count of a string is that of all strings one byte longer that end in it.
    tables = []
    level = totals.where("key >= 0").select(F.col("key").alias("s"), "n", F.col("n_train").alias("c"))
    for k in range(order, -1, -1):
        tail = F.col("s").bitwiseAND(F.lit((1 << 8 * k) - 1))
        level = materialize(level.withColumn("shorter", F.sum("c").over(W.partitionBy(tail)) if k else F.lit(0).cast("long")), f"level{k}")
        tables.append(level)
        level = level.groupBy(tail.alias("s")).agg(F.max("shorter").alias("c"))
    # Up: what a context has (occurrences, symbols, and the shorter context's count of those symbols), and what a string
    # that never followed it costs from the next shorter context on.
    below, used = None, []
    for k in range(order + 1):
        context = W.partitionBy(F.shiftright("s", 8))
        seen = F.col("c") > 0
        stats = {"total": F.sum("c").over(context), "symbols": F.count(F.when(seen, 1)).over(context), "gone": F.coalesce(F.sum(F.when(seen, F.col("shorter"))).over(context), F.lit(0))}
        rows, done, used = tables[order - k].withColumns(stats), used, [tables[order - k]]
        if below is None:
            rows = rows.withColumn("rest", F.when(~seen, -F.log10(F.greatest(SYMBOLS - F.col("symbols"), F.lit(1)).cast("double"))))
        else:
            rows = materialize(rows, f"context{k}")
            used += [rows, below]
            one = below.select(F.col("s").alias("t"), F.col("c").alias("less"), F.col("total").alias("all"), F.col("symbols").alias("kinds"), F.col("rest").alias("further"))
            missed = rows.where(~seen).join(one, F.col("s").bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("t"), "left")
            fresh = F.col("kinds") - F.col("symbols")
            room = (F.col("all") - F.col("gone") + fresh).cast("double")
            rest = F.when(F.col("less") > 0, F.log10(F.col("less") / room)).otherwise(F.when(fresh > 0, F.log10(fresh / room)).otherwise(0.0) + F.col("further"))
            rows = rows.where(seen).withColumn("rest", F.lit(None).cast("double")).unionByName(missed.withColumn("rest", rest).select(*rows.columns, "rest"))
        below = materialize(rows, f"priced{k}") if k < order else rows
        for table in done:
            drop_table(table)
    whole = (F.col("total") + F.col("symbols")).cast("double")
    escape = F.when(F.col("symbols") > 0, F.log10(F.col("symbols") / whole)).otherwise(0.0)
    value = F.when(F.col("c") > 0, F.log10(F.col("c") / whole)).otherwise(escape + F.col("rest"))
    priced = below.select(F.col("s").alias("key"), "n", value.alias("value"))
    return priced.union(totals.where("key < 0").select("key", "n", F.col("n_train").cast("double"))), used


def frequent(table: DataFrame, most: int = FREQUENT_KEYS) -> int:
    """The smallest power of two such that at most `most` keys occur as often."""
    sizes = {r.power: r.keys for r in table.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("keys")).collect()}
    power, kept = max(sizes, default=0) + 1, 0
    while power and kept + sizes.get(power - 1, 0) <= most:
        power -= 1
        kept += sizes.get(power, 0)
    return 2**power


def score(docs: DataFrame, train: object = None, most: int = FREQUENT_KEYS) -> DataFrame:
    """Scores of all rows of docs (doc_id, text), learned from those where the column `train` holds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row. score is log10 of the
    byte model's probability of the lower-cased text (A-Z) and its end; base_score that of its words under smoothed
    word counts. A null or empty text is its end alone. Repeated rows and identifiers each keep a row; a null
    identifier is a training row under the default. Without training rows every symbol is as likely as any other and
    base_score is 0. No rows give no rows.
    """
    spark = docs.sparkSession
    train = F.coalesce(F.pmod(crc_of_id(), F.lit(10)) != 0, F.lit(True)) if train is None else F.coalesce(train, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", train.alias("_train"), F.xxhash64("text").alias("_copy"), F.xxhash64("doc_id", "text").alias("_deal"))
    totals = materialize(count(docs), "counts")
    n_train, vocabulary = totals.where("key < 0").agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    priced, used = prices(totals)
    table = materialize(priced, "prices")
    for gone in (*used, totals):
        drop_table(gone)
    least = frequent(table, most)
    top = table.where(F.col("n") >= least).select("key", "value", F.floor(F.log2("n")).cast("byte").alias("power")).toArrow()  # `most` rows at most
    order = np.argsort(-top["power"].to_numpy(), kind="stable")
    shared = spark.sparkContext.broadcast((top["key"].to_numpy()[order], top["value"].to_numpy()[order]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_prices = Lookup(*shared.value)

        def rare(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Distinct (row, key) with how often."""
            own, code = np.unique(key, return_inverse=True)
            cell, n = np.unique(row * len(own) + code, return_counts=True) if len(own) else (np.zeros(0, np.int64),) * 2
            return cell // max(len(own), 1), own[cell % max(len(own), 1)], n

        for batch in batches:
            for row, to, data, offsets in text_pieces(batch.column("text"), PIECE_BYTES):
                rows, data = to - row, lower_ascii(data)
                code, ends = strings(data, offsets)
                price, missed = known_prices.find(code)
                total = np.add.reduceat(price, ends[:-1])  # every text has a symbol, its end
                more = [rare(np.searchsorted(ends, missed, "right") - 1, code[missed])]
                found, text = words(data, offsets)
                c, missed = known_prices.find(found)
                known = np.ones(len(found), bool)
                known[missed] = False
                base = np.log10((c + SMOOTHING) / (n_train + SMOOTHING * (vocabulary + 1)))
                more.append(rare(text[missed], found[missed]))
                own, key, tf = (np.concatenate(x) for x in zip(*more, strict=True))
                which = np.concatenate([np.arange(rows), own])
                pad = lambda x: np.concatenate([x, np.zeros(len(own), x.dtype)])
                ids, copies, train_, deal = (batch.column(x).slice(row, rows).take(pa.array(which)) for x in ("doc_id", "_copy", "_train", "_deal"))
                kinds = np.concatenate([np.zeros(rows, bool), np.ones(len(own), bool)])
                yield pa.RecordBatch.from_arrays(
                    [ids, copies, train_, pa.array(kinds), pc.if_else(pa.array(kinds), pa.array(pad(np.zeros(rows, np.int64)) + np.concatenate([np.zeros(rows, np.int64), key])), deal), pa.array(np.concatenate([np.zeros(rows, np.int64), tf])),
                     *(pa.array(pad(x)) for x in (np.bincount(text, minlength=rows), np.bincount(text, weights=known & (c > 0), minlength=rows).astype(np.int64), np.bincount(text, weights=np.where(known, base, 0), minlength=rows), total))],
                    ["doc_id", "_copy", "_train", "rare", "key", "tf", "n_tokens", "n_known", "base", "score"],
                )

    scored = docs.mapInArrow(work, f"doc_id {kind}, _copy long, _train boolean, rare boolean, key long, tf long, n_tokens long, n_known long, base double, score double")
    others = table.where(F.col("n") < least).select("key", F.lit(True).alias("rare"), "value")
    joined = scored.join(others, ["key", "rare"], "left")
    is_word = F.col("rare") & (F.col("key") < 0)
    whole = F.lit(n_train + SMOOTHING * (vocabulary + 1))
    by = joined.groupBy("doc_id", "_copy").agg(
        F.count_if(~F.col("rare")).alias("rows"), F.any_value("_train").alias("train"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(is_word & (F.col("value") > 0), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(is_word, F.col("tf") * F.log10((F.coalesce("value", F.lit(0.0)) + SMOOTHING) / whole)).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(F.col("rare") & (F.col("key") >= 0), F.col("tf") * F.col("value")).otherwise(0.0)).alias("score"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return by.select(
        "doc_id", (~F.col("train")).alias("held_out"), (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"), each.alias("_row"),
    ).drop("_row")
