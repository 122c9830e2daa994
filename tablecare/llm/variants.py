"""Spelling variants: words that differ by one letter and where one is far more frequent, for a whole vocabulary.

Letters are hashed to a few symbols. The one-edit neighbourhood of a reduced word holds the reduced form of every word
one edit away, and is far smaller than that of the word itself (8 symbols in place of some 90 letters). The reduced
neighbours of all words are joined with the reduced vocabulary by key, and pairs are checked on the words themselves
inside the join, so that no unverified pair leaves it.

A pair is found from one side: of a neighbourhood's replacements those by a higher symbol (the other word of the pair
has the lower one), the reduced word itself (the replaced letters may have one symbol), and the deletions (insertions
are the other word's deletions). Words are counted before anything is joined, so that no key has more rows than there
are different words with one reduced form.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: Symbols that letters are hashed to, at most ten.
SYMBOLS = 8
#: Letters of a word: A to Z in either case, and Latin-1's from U+00C0 on, as they stand.
LETTERS = "A-Za-zÀ-ÿ"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHABET = _LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: A word's form is this many times as frequent.
RATIO = 5


def words(docs: DataFrame, least: int, *keep: str) -> DataFrame:
    """The kept columns and one row for each run of at least `least` letters, `word`, A to Z in lower case; null texts have none."""
    found = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    return docs.select(*keep, found.alias("word")).withColumn("word", F.translate("word", _UPPER, _LOWER))


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word in symbols '0', '1', ...; a letter outside the alphabet counts as symbol 0."""
    known = F.translate(word, _ALPHABET, "".join(str(zlib.crc32(c.encode()) % symbols) for c in _ALPHABET))
    return F.regexp_replace(known, "[^0-9]", "0")


def _keys(symbols: int) -> Column:
    """Hashes of the reduced word, then of its replacements by higher symbols and of its deletions, each once."""
    r = F.col("reduced")
    left, right = lambda i: F.substring(r, F.lit(1), i - 1), lambda i: F.substring(r, i + 1, F.lit(1 << 30))
    places = F.sequence(F.lit(1), F.char_length(r))
    every = F.array(*[F.lit(str(s)) for s in range(symbols)])
    up = F.flatten(F.transform(places, lambda i: F.transform(F.filter(every, lambda s: s > F.substring(r, i, F.lit(1))), lambda s: F.xxhash64(F.concat(left(i), s, right(i))))))
    down = F.transform(places, lambda i: F.xxhash64(F.concat(left(i), right(i))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(r)), up, down))


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words exactly one insertion, deletion or replacement apart, each pair once.

    vocabulary: word, n; words are distinct and not null.
    """
    if not 2 <= symbols <= 10:
        raise ValueError("2 to 10 symbols")
    held = vocabulary.select("word", "n", reduced(F.col("word"), symbols).alias("reduced"))
    asked = held.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.posexplode(_keys(symbols)).alias("place", "key"))
    known = held.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.xxhash64("reduced").alias("key"))
    once = (F.col("place") > 0) | (F.col("a") < F.col("b"))  # words of one reduced form meet twice
    return asked.join(known, (asked.key == known.key) & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def group(found: DataFrame, least_letters: int = 6, least_count: int = 5, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every distinct word of a table with a column `word`.

    Words of fewer letters (code points) than least_letters or fewer rows than least_count take no part, null neither.
    n_near counts the words one edit away. form is the most frequent of them (ties: the first in code-point order), if
    it is at least `ratio` times as frequent, else null. root follows forms to the last; a word without form is its own.
    An empty table has no words.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    counted = found.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = materialize(counted.where(F.col("n") >= least_count), "vocabulary")
    pairs = near_pairs(vocabulary, symbols)
    sides = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.lit(None).cast("long").alias("n"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("word")).alias("near")) for x, y in (("a", "b"), ("b", "a"))])).alias("s")).select("s.*")
    none = F.lit(None).cast("struct<less: bigint, word: string>").alias("near")
    gathered = vocabulary.select("word", "n", none).union(sides).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("near"))
    near = -F.col("near.less") >= ratio * F.col("n")
    linked = materialize(gathered.select("word", "n", "n_near", F.when(near, F.col("near.word")).alias("form"), F.when(near, -F.col("near.less")).alias("form_n")), "variants")
    drop_table(vocabulary)

    # A form is ratio times as frequent as its word, so chains are short; each round doubles the links that are followed.
    most = linked.agg(F.max("n")).first()[0] or 1
    longest = max(1, int(math.log(max(most / least_count, 1), ratio)) + 1)
    root = linked.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(longest))):
        further = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, root = root, materialize(root.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        if i:
            drop_table(before)
    return linked.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
