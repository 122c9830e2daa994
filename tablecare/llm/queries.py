"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, knn, langid, licenses, lm, mixing, packing, pieces, runs, simhash, substrings, token_files, variants
from .common import crc_of_id, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"), k=20)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "tokens", "pass", "block", "start", F.round("weight", 6).alias("weight"), F.round("exponent", 6).alias("exponent"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text as it stays, its sentences, those removed and the documents that hold them first."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) in which every tenth (by crc32 of its identifier) repeats a stretch of words from a chosen place to its end."""
    h = crc_of_id()
    g = F.floor(h / 10)
    chosen = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", chosen.alias("words"), g.alias("g")).withColumn("n", F.size("words"))
    split = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    split = split.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return split.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ordered = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    found = found.select("doc_id", "runs", "collapsed", ordered.alias("long"))
    length, period = -F.col("long.less"), F.col("long.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("long.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_slips(words: DataFrame) -> DataFrame:
    """Words (doc_id, word), some of them (by crc32 of both) without one letter."""
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "word").cast("binary"))
    at = (h % F.char_length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return words.select(F.when(F.col("doc_id").isNotNull() & (h % 199 == 0), less).otherwise(F.col("word")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = 6  # shorter runs of letters give no word, with a letter less neither
    return variants.group(with_planted_slips(variants.words(table(spark, sf_dir, "documents"), least, "doc_id")), least_letters=least)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text"), model)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_top_k, op2_license_scan, op3_best_fit_packing, op4_ppm_scoring, op5_language_id, op6_simhash_near_dedup, op7_source_mixing, op8_token_files, op9_substring_dedup, op10_one_bit_ann,
              op11_periodic_runs, op12_spelling_variants, op13_sentencepiece)
}

ORACLES: dict[str, str] = {
    "op1_exact_top_k": """
WITH parts AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
usable AS (SELECT vec_id FROM parts GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
flat AS (SELECT vec_id, i, CAST(floor(64 * x) AS BIGINT) AS x FROM parts WHERE vec_id IN (SELECT vec_id FROM usable)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x) AS score
  FROM flat q JOIN flat c ON q.vec_id % 20 = 0 AND c.i = q.i AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
""",
    "op7_source_mixing": r"""
WITH RECURSIVE
docs AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS k, 1 + coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
sizes AS (SELECT k, CAST(sum(tokens) AS BIGINT) AS size FROM docs GROUP BY k),
logs AS (SELECT k, size, ln(size / (SELECT sum(size) FROM sizes)) AS l FROM sizes),
ends AS (SELECT max(l) AS most, min(l) AS least, (SELECT sum(size) FROM sizes) AS total FROM logs),
halving AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN exp((1 - (low + high) / 2) * (most - least)) <= 2.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN exp((1 - (low + high) / 2) * (most - least)) <= 2.0 THEN (low + high) / 2 ELSE high END
  FROM halving, ends WHERE i < 40),
found AS (SELECT high AS a FROM halving WHERE i = 40),
scale AS (SELECT sum(exp(a * l)) AS z FROM logs, found),
plan AS (
  SELECT k, size, a AS exponent, exp(a * l) / z AS weight,
         CAST(round(total * exp((1 - a) * most) * z * (exp(a * l) / z)) AS BIGINT) AS budget,
         CAST(ceil(size / 250000.0) AS BIGINT) AS blocks
  FROM logs, found, scale, ends),
passes AS (
  SELECT d.*, p.size, p.exponent, p.weight, p.budget, CAST('0x' || substr(md5('mix:' || d.doc_id), 1, 8) AS BIGINT) % p.blocks AS block, g.pass
  FROM docs d JOIN plan p USING (k), LATERAL (SELECT unnest(range(0, CAST(ceil(p.budget / CAST(p.size AS DOUBLE)) AS BIGINT))) AS pass) g),
held AS (SELECT k, pass, block, sum(tokens) AS n FROM passes GROUP BY k, pass, block),
before AS (SELECT k, pass, block, coalesce(sum(n) OVER (PARTITION BY k, pass ORDER BY md5('mix:' || pass || ':' || k || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM held),
starts AS (
  SELECT p.*, p.pass * p.size + b.n + coalesce(sum(p.tokens) OVER (PARTITION BY p.k, p.pass, p.block ORDER BY md5('mix:' || p.pass || ':' || p.doc_id), p.doc_id, p.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM passes p JOIN before b ON b.k = p.k AND b.pass = p.pass AND b.block = p.block)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, CAST(pass AS INTEGER) AS pass, CAST(block AS BIGINT) AS block, CAST(start AS BIGINT) AS start, round(weight, 6) AS weight, round(exponent, 6) AS exponent
FROM starts WHERE start < budget
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) AS r FROM documents),
lower AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM found GROUP BY ALL),
hexed AS (SELECT *, hex(encode(concat(doc_id, ':', w))) AS x FROM lower),
hashed AS (
  SELECT w, n, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) END AS h
  FROM hexed, crc),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % len(w)) || substr(w, h % len(w) + 2) ELSE w END AS word, n FROM hashed),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, unnest(range(len(word))) AS i FROM vocabulary),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM places),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN vocabulary b ON a.d = b.word
  UNION SELECT b.word, a.word FROM less a JOIN vocabulary b ON a.d = b.word),
counted AS (SELECT v.word, any_value(v.n) AS n, count(o.word) AS n_near, min({'less': -o.n, 'word': o.word}) FILTER (o.word IS NOT NULL) AS best FROM vocabulary v LEFT JOIN near USING (word) LEFT JOIN vocabulary o ON o.word = near.other GROUP BY v.word),
formed AS (SELECT word, n, n_near, CASE WHEN -best.less >= 5 * n THEN best.word END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n FROM counted),
chain AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
""",
}
