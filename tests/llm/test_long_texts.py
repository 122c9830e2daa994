"""One text of 20 MB through every operator on texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tablecare.llm import langid, licenses, lm, mixing, packing, pieces, runs, simhash, substrings, token_files, variants
from tablecare.llm.queries import tokenizer_path

from .support import SCHEMA, prose

MEGABYTES = 20


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    part = "MIT License. " + prose(rng, "en", 3000) + "\n"
    short = [(i, prose(rng, "en", 80), "en", f"s{i % 2}", 1) for i in range(20)]
    df = spark.createDataFrame([*short, (99, part, "en", "s1", 1)], SCHEMA)
    times = (MEGABYTES << 20) // len(part)
    return df.withColumn("text", F.when(F.col("doc_id") == 99, F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(times)), lambda i: F.concat(F.lit("Part "), i.cast("string"), F.lit(". "), F.col("text"))))).otherwise(F.col("text")))


def long_row(df):
    return df.where("doc_id = 99").first()


def test_the_text_is_long(docs):
    assert docs.agg(F.max(F.octet_length("text"))).first()[0] >= 0.95 * (MEGABYTES << 20)


def test_scan_and_language(docs):
    n = docs.where("doc_id = 99").select(F.regexp_count("text", F.lit("MIT License"))).first()[0]
    r = long_row(licenses.scan(docs))
    assert r.n_base == n and r.base_labels == "mit"
    assert long_row(langid.identify(docs, langid.fit(docs))).lang_pred == "en"


def test_pack_and_files(spark, docs):
    packed = packing.pack(docs, tokenizer_path()).where("doc_id = 99").agg(F.sum("length")).first()[0]
    read = long_row(token_files.read(spark, token_files.write(docs, tokenizer_path())))
    assert packed == read.n_tokens > 1_000_000


def test_scores(docs):
    r = long_row(lm.score(docs))
    assert r.n_tokens > 1_000_000 and r.score < 0


def test_near_copies_and_passages(docs):
    assert simhash.near_duplicates(docs).count() == 21 and simhash.keep_one(docs).count() == 21
    r = long_row(substrings.remove_repeats(docs.select("doc_id", "text")))
    assert 0 < len(r.text) < 1 << 20 and r.n_removed > 1000


def test_mixing(docs):
    got = mixing.mix(docs).where("doc_id = 99").agg(F.min("tokens")).first()[0]
    assert got > 1_000_000


def test_runs_words_and_pieces(docs):
    text = "concat(text, repeat(' tick tock', 100000))"
    r = long_row(runs.find(docs.selectExpr("doc_id", f"{text} AS text")))
    assert (r.runs[-1].length, r.runs[-1].period) == (200_000, 2) and r.collapsed.endswith(" tick tock") and r.n_words > 1_000_000
    assert variants.words(docs.where("doc_id = 99"), 6).count() > 500_000
    model = tokenizer_path("piece_bpe_32k.model")
    r = pieces.decode(pieces.encode(docs, model), model).where("doc_id = 99").selectExpr("size(ids) AS n", "decoded = text AS same").first()
    assert r.n > 1_000_000 and r.same


def test_a_long_text_of_short_notices(spark):
    """Some 600,000 detections in one text."""
    n = 600_000
    df = spark.range(1).selectExpr("id AS doc_id", f"repeat('mit license, apache-2.0; ', {n}) AS text")
    began = time.time()
    r = licenses.scan(df).selectExpr("n_base", "size(detections) AS n", "labels").first()
    assert r.n_base == n and r.n >= n and "mit" in r.labels and time.time() - began < 60
