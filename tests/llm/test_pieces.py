import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tablecare.llm import pieces, queries
from tablecare.llm.common import byte_view

from .support import frame, rows, same_columns

MODEL = queries.tokenizer_path("piece_bpe_32k.model")
PLAIN = SentencePieceProcessor(model_file=MODEL)
OWN = pieces.PieceEncoder(MODEL)
SMALL = pieces.PieceEncoder(MODEL, slots=64)  # its table of parts is emptied all the time


def own(encoder, texts):
    ids, ends = encoder.encode(*byte_view(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


awkward = st.text(alphabet=st.one_of(st.sampled_from("ab  thein Z'.,!=-/*#▁\n\t\r1é日本語\x00<s>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=500, deadline=None)
@given(st.lists(awkward, max_size=5))
def test_encoding_equals_the_library(texts):
    want = [PLAIN.encode(t) for t in texts]
    assert own(OWN, texts) == want and own(SMALL, texts) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(259, 31999), max_size=25))
def test_joined_pieces_equal_the_library(ids):
    text = "".join(PLAIN.id_to_piece(i) for i in ids).replace(pieces.SPACE, " ")
    assert own(OWN, [text]) == [PLAIN.encode(text)]


@pytest.mark.parametrize("alphabet", ["ab", "e rt", "=", "- ", "▁ ", "0a", "lo l", "ÃÂ", "的一 "])
def test_texts_of_few_letters_equal_the_library(alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    assert own(OWN, texts) == [PLAIN.encode(t) for t in texts]


def test_backtracking_meets_failed_places():
    """Without a look back the longest pieces alone would give other sequences."""
    words = [w for r in rows() for w in (r[1] or "").split(" ")]
    greedy = 0
    for w in set(words):
        text, out, at = pieces.SPACE + w, [], 0
        while at < len(text):
            n = next(k for k in range(len(text) - at, 0, -1) if k == 1 or text[at : at + k] in OWN.merges.scores)
            out.append(text[at : at + n])
            at += n
        greedy += out != OWN.merges.pieces(text)
        assert OWN.merges.pieces(text) == OWN.merges.merged(text)
    assert greedy


def test_a_long_text_without_cuts():
    text = "".join(random.Random(3).choice("abcdefghijklmnop") for _ in range(200_000))
    assert own(OWN, [text]) == [PLAIN.encode(text)]


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    df = frame(spark, clash=True)
    out = pieces.encode(df, MODEL)
    name = out.columns[-1]
    assert same_columns(df, out) and sorted((r.doc_id, r[name]) for r in out.collect()) == sorted((d, PLAIN.encode(t or "", add_eos=True)) for d, t, *_ in rows())
    back = pieces.decode(out, MODEL, name)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert pieces.decode(pieces.encode(frame(spark, []), MODEL), MODEL).count() == 0
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(None,), ([2],)], "ids array<int>"), MODEL).collect()] == [None, ""]


def test_query_equals_the_library(spark, sf):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for d in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        ids = PLAIN.encode(d["text"] or "", add_eos=True)
        want.append((d["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(PLAIN.decode(ids))))
    assert sorted(map(tuple, queries.op13_sentencepiece(spark, sf).collect())) == sorted(want)
