import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablecare.llm import packing, token_files
from tablecare.llm.common import byte_view, text_pieces
from tablecare.llm.queries import tokenizer_path
from tablecare.llm.tokens import Encoder

from .support import frame, rows

import pyarrow as pa
from tokenizers import Tokenizer

PLAIN = Tokenizer.from_file(tokenizer_path())
PLAIN.encode_special_tokens = True
OWN = Encoder(tokenizer_path())


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab Z'.,!&s\n\t\r 1é  \x1c<|>"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_cached_encoding_equals_plain(texts):
    ids, ends = OWN.encode(*byte_view(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [plain(t) for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_places_every_piece(spark):
    data = rows()
    out = packing.pack(frame(spark, clash=True), tokenizer_path(), 256).collect()
    want = []
    for doc_id, text, *_ in data:
        ids = [*plain(text), 0]
        first = len(ids) % 256 or 256
        at, k = 0, 0
        while at < len(ids):
            n = first if k == 0 else 256
            want.append((doc_id, k, at, n, crc(ids[at : at + n])))
            at, k = at + n, k + 1
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(w[3] for w in want)
    assert len(by) <= 1.05 * -(-total // 256) + 1


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=12))
def test_solver_holds_the_histogram(histogram):
    seen = {}
    columns, placed = packing.solve(histogram, 64)
    assert 0 <= placed <= sum(histogram.values())
    for column, times in columns:
        assert times > 0 and sum(k * v for k, v in column.items()) <= 64
        for k, v in column.items():
            seen[k] = seen.get(k, 0) + v * times
    assert seen == histogram


def test_knapsack_is_exact():
    lengths, values = np.array([3, 5, 7]), np.array([4.0, 7.0, 10.1])
    best = max(4 * a + 7 * b + 10.1 * c for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23)
    assert packing.knapsack(lengths, values, 23) @ values == pytest.approx(best)


def sequences(lengths, supply):
    return sum(n for _, n in packing.best_fit(lengths, supply, 2048))


def test_linear_program_beats_best_fit_where_it_matters():
    h = {500: 4000, 600: 4000, 700: 4000, 811: 4000, 905: 4000}
    columns, placed = packing.solve(h)
    assert placed == 20_000 and sum(n for _, n in columns) < sequences(np.array(list(h)), np.array(list(h.values())))


def test_program_places_most_pieces_of_the_given_documents():
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].combine_chunks()
    h = Counter()
    for _, _, data, offsets in text_pieces(table):
        for n in (np.diff(OWN.encode(data, offsets)[1]) + 1).tolist():
            h.update([2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0))
    columns, placed = packing.solve(h)
    tokens = sum(k * n for k, n in h.items())
    assert sum(n for _, n in columns) == -(-tokens // 2048)
    assert placed > 0.5 * sum(h.values())


def test_a_small_table_of_pieces_gives_the_same_ids():
    small = Encoder(tokenizer_path(), slots=256)
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].combine_chunks()
    for _, _, data, offsets in text_pieces(table, 1 << 16):
        for ours, theirs in zip(small.encode(data, offsets), OWN.encode(data, offsets), strict=True):
            assert np.array_equal(ours, theirs)
    assert small.pieces <= 256


def test_files_read_back(spark):
    data = rows()
    folder = token_files.write(frame(spark, clash=True), tokenizer_path())
    got = token_files.read(spark, folder).orderBy("start").collect()
    at, want = 0, []
    for doc_id, text, *_ in sorted(data, key=lambda r: (r[0], r[1] or "")):
        ids = [*plain(text), 0]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    found = token_files.lookup(spark, folder, [5, 203, 999]).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in found) == sorted([(5, (*plain(data[5][1]), 0))] * 3 + [(203, (*plain("x"), 0))])


def test_files_of_nothing(spark):
    assert token_files.read(spark, token_files.write(frame(spark, []), tokenizer_path())).count() == 0


def test_shard_binary_search():
    shard = token_files.ShardBuilder(block_bytes=200)
    keys = [-(2**40), -3, 0, 1, 1, 7, 2**50]
    for i, k in enumerate(keys):
        shard.add(token_files.key_of(k, int(i == 4)), np.arange(70_000 if k == 7 else 40, dtype=np.uint32))
    read = token_files.Shard.of(shard.finish())
    assert [token_files.id_of(k) for k, _ in read] == keys and len(read.index) == 3
    assert len(read.get(1)) == 2 and len(read.get(7)[0]) == 70_000 and not read.get(2)
    with pytest.raises(ValueError):
        token_files.Shard.of(shard.finish()[:-1] + b"x")


def test_lookup_reads_only_what_it_needs(spark, monkeypatch):
    shard = token_files.ShardBuilder(block_bytes=4000)
    for k in range(0, 2000, 2):
        shard.add(token_files.key_of(k), np.full(50, k, np.uint32))
    data, reads = shard.finish(), []

    def read(at, n):
        reads.append((at, n))
        return data[at : at + n]

    file = token_files.Shard(len(data), read)
    opened = len(reads)
    absent = [k for k in range(1, 2000, 2) if not file.get(k)]
    assert len(absent) == 1000 and len(reads) - opened < 100  # the filter lets about 1 % through
    del reads[:]
    assert [int(x[0]) for x in file.get(1000)] == [1000] and len(reads) <= 2 and sum(n for _, n in reads) < len(data) // 10

    monkeypatch.setattr(token_files, "SHARD_BYTES", 1)
    texts = [(k, f"text {k}", None, None, 0) for k in range(400)] + [(None, "none", None, None, 0)]
    folder = token_files.write(frame(spark, texts), tokenizer_path())
    rows_ = token_files._manifest(spark, folder).collect()
    assert all(r.first_key <= r.last_key for r in rows_) and sum(r.entries for r in rows_) == 401
    hit = next(r for r in rows_ if r.first_key <= token_files.key_of(77)[: token_files.ID_BYTES] <= r.last_key)
    place = folder.removeprefix("file://")
    for r in rows_:  # files that hold none of the wanted identifiers aren't opened
        if r.file != hit.file:
            with open(f"{place}/{r.file}", "wb") as out:
                out.write(b"broken")
    assert [(r.doc_id, r.ids) for r in token_files.lookup(spark, folder, [77, 5000, -1]).collect()] == [(77, [*plain("text 77"), 0])]
    assert token_files.lookup(spark, folder, []).count() == 0


def test_files_of_null_identifiers(spark):
    data = [(None, "b c", None, None, 0), (-(2**63), "x", None, None, 0), (None, "a", None, None, 0), (None, None, None, None, 0), (7, "y", None, None, 0)]
    folder = token_files.write(frame(spark, data), tokenizer_path())
    got = token_files.read(spark, folder).orderBy("start").collect()
    at, want = 0, []
    ordered = frame(spark, data).selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy("doc_id", "h").collect()
    assert [r.doc_id for r in ordered] == [None, None, None, -(2**63), 7]
    for doc_id, text, _ in ordered:
        ids = [*plain(text), 0]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert sorted(tuple(r.ids) for r in token_files.lookup(spark, folder, [None]).collect()) == sorted((*plain(t), 0) for t in (None, "a", "b c"))
    only = token_files.write(frame(spark, data[:1]), tokenizer_path())
    assert [r.doc_id for r in token_files.read(spark, only).collect()] == [None]
