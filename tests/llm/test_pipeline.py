from collections import Counter

import corpus_pipeline
from tablecare.llm.common import materialize
from tablecare.llm.queries import tokenizer_path

from .support import frame, rows, same_columns
from .test_near_copies import brute_kept
from .test_tokens import plain


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf), name))
    assert all(df.columns == columns for df in kept[:-1])
    ids = [Counter(r.doc_id for r in df.select("doc_id").collect()) for df in kept]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False))
    # Near copies: one of each brute-force group.
    after = [(r.doc_id, r.text) for r in kept[1].collect()]
    assert sorted(ids[2].elements()) == brute_kept(after)
    assert max(ids[3].values()) == 1 and set(ids[4]) == set(ids[3]) and max(ids[4].values()) <= 2
    # Packing: every piece of every row, no overlap.
    text = {r.doc_id: r.text for r in kept[4].collect()}
    want = Counter({d: n * (len(plain(text[d])) + 1) for d, n in ids[4].items()})
    got, ends = Counter(), {}
    for r in kept[5].collect():
        got[r.doc_id] += r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert got == want
    for parts in ends.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_awkward_rows_and_nothing(spark, sf):
    for data in (rows(), []):
        docs = frame(spark, data, clash=True)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), name)
            if name != "pack":
                assert docs.columns == columns and same_columns(docs, docs)
        assert (docs.count() > 0) == bool(data)
