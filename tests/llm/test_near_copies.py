import random
import re

from tablecare.llm import simhash

from .support import frame, prose, rows
from .test_text_models import low


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(data):
    """doc_ids that stay by the components of all pairs at a Jaccard similarity of 0.8 or more."""
    sets, part = [shingles(t) for _, t, *_ in data], list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if part[i] != part[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    return sorted({min(d[0] for d, q in zip(data, part, strict=True) if q == p) for p in set(part)})


def edited(n=40):
    """Texts of 150 words and copies with words replaced: similarities on both sides of 0.8."""
    rng, out = random.Random(8), []
    for i in range(n):
        words = [f"{w}{rng.randint(0, 99)}" for w in prose(rng, "en", 150).split()]
        out.append((1000 + 10 * i, " ".join(words), "en", "s1", 1))
        for k in range(1, 4):
            for at in rng.sample(range(150), rng.randint(1, 3)):
                words[at] = f"new{rng.randint(0, 9999)}"
            out.append((1000 + 10 * i + k, " ".join(words), "en", "s1", 1))
    return out


def test_near_copies_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for data in (rows() + edited(), docs):
        got = simhash.keep_one(frame(spark, data, clash=True))
        assert sorted(r.doc_id for r in got.collect()) == brute_kept(data)


def tiny():
    """Texts of 5 to 14 words and copies that lack the first or the last: sets of one to ten shingles."""
    rng, out = random.Random(5), []
    for i in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 14))]
        out += [(5000 + 3 * i, " ".join(words), "en", "s1", 1), (5001 + 3 * i, " ".join(words[1:]), "en", "s1", 1), (5002 + 3 * i, " ".join(words[:-1]), "en", "s1", 1)]
    return out


def test_groups_of_many_parts_and_tiles(spark):
    data = edited(6) + tiny()
    for part_texts, tile_rows in ((2, 2048), (256, 5)):
        got = simhash.keep_one(frame(spark, data), part_texts=part_texts, tile_rows=tile_rows)
        assert sorted(r.doc_id for r in got.collect()) == brute_kept(data)
    assert simhash.keep_one(frame(spark, [])).count() == 0
    lone = simhash.keep_one(frame(spark, [(None, "a b c d e f", None, None, 0), (None, "a b c d e f", None, "x", 0), (3, None, None, None, 0), (None, "", None, None, 0)]))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in lone.collect()) == [(False, 3, None), (True, None, "a b c d e f")]
