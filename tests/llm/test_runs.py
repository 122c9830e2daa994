import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablecare.llm import queries, runs

from .support import frame, rows, same_columns


def brute(words, least=6, times=4):
    """Every lag's maximal matches, by definition; a stretch whose words have a smaller period is that one's run."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(least, times * q) and not any(all(words[k] == words[k - p] for k in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
            i = j + 1 if j == i else j
    return sorted(out)


def collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def numbered(texts):
    numbers: dict = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
    return codes, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


stretch = st.lists(st.sampled_from("abc"), min_size=1, max_size=7)
repeated = st.builds(lambda part, times, cut: (part * times)[: max(1, len(part) * times - cut)], stretch, st.integers(1, 7), st.integers(0, 6))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(repeated, stretch), max_size=8).map(lambda parts: [w for p in parts for w in p]), max_size=5), st.sampled_from([(6, 4), (1, 3), (12, 3)]))
def test_runs_equal_brute_force(texts, limits):
    codes, row = numbered(texts)
    before = np.cumsum([0, *map(len, texts)])
    got = [(r, s - before[r], n, q) for r, s, n, q in runs.find_runs(codes, row, *limits).tolist()]
    assert got == [(r, *x) for r, t in enumerate(texts) for x in brute(t, *limits)]


def test_a_long_text_costs_its_length_times_levels():
    rng = np.random.default_rng(1)
    noise = np.where(rng.random(1 << 20) < 0.5, 0, rng.integers(1, 1000, 1 << 20))  # every second word is one word
    block = rng.integers(0, 1000, 100_000)
    codes = np.concatenate([noise, np.tile(block, 5), np.zeros(300_000, np.int64)])
    found = runs.find_runs(codes, np.zeros(len(codes), np.int64)).tolist()
    assert [1 << 20, 500_000, 100_000] in [x[1:] for x in found] and any(q == 1 and n >= 300_000 for _, _, n, q in found)


def test_few_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.int64), np.zeros(9, np.int64), 6, 2)


def test_every_row_with_nulls_repeats_and_clashing_columns(spark):
    extra = [(300, "a b " * 5 + "x", None, "s", 1), (301, "é é é é é é é é é é é é", None, None, 1), (None, "z z z z z z z", None, None, 1)]
    df = frame(spark, rows() + extra, clash=True)
    out = runs.find(df)
    got = out.collect()
    assert same_columns(df, out) and len(got) == len(rows() + extra)
    for r in got:
        words = split(r.text)
        want = brute(words)
        assert (r[-3], [tuple(x) for x in r[-2]], r.collapsed) == (len(words), want, collapsed(words, want))
    assert runs.find(frame(spark, [])).count() == 0


def planted(doc_id, text):
    words = split(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = planted(d["doc_id"], d["text"])
        r = got[d["doc_id"]]
        if len(words) > 3000:  # the definition is tried on the rest
            continue
        found = brute(words)
        some += bool(found)
        start, length, period = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        want = (len(found), start, length, period, 1000 * length // period if found else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(collapsed(words, found)))
        assert tuple(r)[1:] == want
    assert some > 5
