import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablecare.llm import queries, variants

from .support import frame, rows


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v.encode("utf-32-be")), default=None) for w, vs in near.items()}
    form = {w: v if v is not None and counts[v] >= ratio * counts[w] else None for w, v in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def found(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary(seed):
    rng = random.Random(seed)
    letters = "abcdeéÿ×z"
    counts = Counter()
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
        n = rng.choice([5, 6, 30, 200, 900])
        for _ in range(rng.randint(1, 9)):
            i = rng.randrange(len(w))
            counts[rng.choice([w, w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])] = n
            n = max(1, n // rng.choice([1, 5, 7]))
    return counts


@pytest.mark.parametrize(("seed", "symbols"), [(1, 8), (2, 2), (3, 10), (4, 8)])
def test_groups_equal_brute_force(spark, seed, symbols):
    counts = vocabulary(seed)
    table = spark.createDataFrame([(w, n) for w, n in counts.items()] + [(None, 50)], "word string, n int")
    words = table.select("word", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("word")
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = variants.group(words, symbols=symbols)
    assert got.count() == len(want) and found(got) == brute(want)


def test_a_chain_of_forms_ends_at_its_root(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "akjihg": 15625}
    words = spark.createDataFrame(list(counts.items()), "word string, n int").select("word", F.explode(F.sequence(F.lit(1), F.col("n")))).select("word")
    assert {r.root for r in variants.group(words).collect()} == {"akjihg"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abéÿ", min_size=2, max_size=7), st.data())
def test_a_reduced_neighbour_is_in_the_half_neighbourhood_of_one_of_the_two(word, data):
    i = data.draw(st.integers(0, len(word) - 1))
    other = data.draw(st.sampled_from([word[:i] + word[i + 1 :], word[:i] + "z" + word[i + 1 :], word[:i] + "ö" + word[i:]]))
    symbol = lambda w: "".join(str(zlib.crc32(c.encode()) % 8) for c in w)

    def keys(r):
        return {r, *(r[:k] + r[k + 1 :] for k in range(len(r))), *(r[:k] + str(s) + r[k + 1 :] for k in range(len(r)) for s in range(int(r[k]) + 1, 8))}

    a, b = symbol(word), symbol(other)
    assert (b in keys(a)) + (a in keys(b)) == (2 if a == b else 1)


def test_words_of_texts_with_nulls_and_clashing_columns(spark):
    df = frame(spark, clash=True)
    got = Counter(r.word for r in variants.words(df, 6, "doc_id").collect())
    want = Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for r in rows() for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or "") if len(w) >= 6)
    assert got == want and variants.words(df, 6).columns == ["word"]


def test_no_words(spark):
    assert variants.group(spark.createDataFrame([], "word string")).count() == 0
    assert variants.group(variants.words(frame(spark, []), 6)).count() == 0


def test_planted_slips(spark):
    words = [(i, w) for i in range(2000) for w in ("abcdéfg", "hijklm")] + [(None, "abcdéfg")]
    out = queries.with_planted_slips(spark.createDataFrame(words, "doc_id long, word string")).collect()
    for (doc_id, w), r in zip(words, out, strict=True):
        h = zlib.crc32(f"{doc_id}:{w}".encode())
        i = h % len(w)
        assert r.word == (w[:i] + w[i + 1 :] if doc_id is not None and h % 199 == 0 else w)
    assert any(len(r.word) == 6 and r.word.startswith("abc") for r in out)
