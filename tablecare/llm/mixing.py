"""Mixing sources to target weights by temperature, with DataFrame functions alone.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources alike) and 1 (as they
are). The exponent is bisected: the least one whose weights stay within a repetition limit, or the greatest one whose
weights reach a target entropy. Weights become budgets in tokens. A source's stream is its blocks of documents in a
keyed permutation, and each block's documents in one, anew for every pass; documents that start before the budget is
used up are in the mix. Blocks bound every sort of documents, and the blocks of a pass are ordered in BUCKETS parts by
the first digits of their keys, whatever a source's size.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, drop_table, materialize, own_prefix

#: Most passes over a source against the least repeated one, tokens of a block, halvings of the exponent, key.
MAX_REPEATS, BLOCK_TOKENS, HALVINGS, SEED = 2.0, 250_000, 40, "mix"
#: Exponents that a target entropy is tried at in one pass over the sources.
GRID = 64
#: Hexadecimal digits of a key that parts of a pass's blocks go by.
BUCKET_DIGITS = 4


def tokens(text: str = "text") -> Column:
    """Words between white space, and one for the end; 1 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def by_repeats(one: DataFrame, max_repeats: float, halvings: int) -> DataFrame:
    """one (most, least: the largest and smallest logarithm of a share) with the least exponent that keeps within a repetition limit."""

    def halve(at: Column, _: Column) -> Column:
        mid = (at["low"] + at["high"]) / 2
        holds = F.exp((1 - mid) * (F.col("most") - F.col("least"))) <= max_repeats  # the limit holds from some exponent on
        return F.struct(F.when(holds, at["low"]).otherwise(mid).alias("low"), F.when(holds, mid).otherwise(at["high"]).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return one.withColumn("exponent", F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve)["high"])


def by_entropy(logs: DataFrame, one: DataFrame, target_entropy: float, halvings: int) -> DataFrame:
    """one with the greatest exponent whose weights reach an entropy: logs (a row a source) are summed at GRID exponents a round."""
    state = one.withColumns({"low": F.lit(0.0), "high": F.lit(1.0)})
    for _ in range(ceil(halvings / log2(GRID))):
        at = [F.col("low") + (F.col("high") - F.col("low")) * (i / GRID) for i in range(1, GRID)]
        sums = [x for i, a in enumerate(at) for x in (F.sum(F.exp(a * F.col("log"))).alias(f"z{i}"), F.sum(F.exp(a * F.col("log")) * F.col("log")).alias(f"s{i}"))]
        found = logs.crossJoin(F.broadcast(state.select("low", "high"))).groupBy("low", "high").agg(*sums)  # one row
        entropy = [F.log(F.col(f"z{i}")) - a * F.col(f"s{i}") / F.col(f"z{i}") for i, a in enumerate(at)]
        reached = sum((F.when(h >= target_entropy, 1).otherwise(0) for h in entropy[1:]), F.when(entropy[0] >= target_entropy, 1).otherwise(0))  # it falls with the exponent
        width = (F.col("high") - F.col("low")) / GRID
        found = found.select((F.col("low") + width * reached).alias("new_low"), (F.col("low") + width * (reached + 1)).alias("new_high"))
        state = one.crossJoin(F.broadcast(found)).withColumnsRenamed({"new_low": "low", "new_high": "high"})  # one row each
    return state.withColumnRenamed("low", "exponent").drop("high")


def weights(sizes: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, halvings: int = HALVINGS) -> DataFrame:
    """_key, size, exponent, weight, budget, blocks, passes for every source of sizes (a table of _key, size), one row a source.

    Sources meet in sums alone, so there may be as many as there are documents.
    """
    total = sizes.agg(F.sum("size").alias("all"), F.max("size").alias("largest"), F.min("size").alias("smallest")).where("all IS NOT NULL")
    share = lambda c: F.log(F.col(c) / F.col("all"))
    one = total.select("all", share("largest").alias("most"), share("smallest").alias("least"))
    logs = sizes.crossJoin(F.broadcast(total.select("all"))).withColumn("log", share("size"))  # one row
    one = by_repeats(one, max_repeats, halvings) if target_entropy is None else by_entropy(logs, one, target_entropy, halvings)
    scale = logs.crossJoin(F.broadcast(one.select("exponent"))).agg(F.sum(F.exp(F.col("exponent") * F.col("log"))).alias("scale"))  # one row
    each = logs.drop("all").crossJoin(F.broadcast(one)).crossJoin(F.broadcast(scale))  # one row each
    weight = F.exp(F.col("exponent") * F.col("log")) / F.col("scale")
    # Without a budget the whole is as large as it takes for each source to be read once at least.
    whole = F.lit(float(total_tokens)) if total_tokens is not None else F.col("all") * F.exp((1 - F.col("exponent")) * F.col("most")) * F.col("scale")
    out = each.select("_key", "size", "exponent", weight.alias("weight"), F.round(whole * weight).cast("long").alias("budget"))
    return out.withColumns({"blocks": F.ceil(F.col("size") / block_tokens).cast("long"), "passes": F.ceil(F.col("budget") / F.col("size")).cast("int")})


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, prefix: str = "") -> DataFrame:
    """docs once for each time that a row is in the mix, with <prefix>tokens, pass, block, start, weight, exponent.

    docs has doc_id, text, source and any others; the new columns replace columns of their names. `start` counts the
    tokens before it in its source's stream. A null source is a source of its own. Null and empty texts have one
    token. Give either a repetition limit or a target entropy (natural logarithm; one above that of equal weights gives
    exponent 0). Without total_tokens no row is left out. Repeated rows each take a place; rows without an identifier
    are dealt to blocks by their text. No rows give no rows.
    """

    def mark(*parts) -> Column:
        return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))

    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("null"), F.xxhash64("text").cast("string")))
    dealt = F.conv(F.substring(mark(name), 1, 8), 16, 10).cast("long")
    # What documents weigh and where they are dealt: one pass over the texts, small rows.
    slim = materialize(docs.select(key.alias("_key"), dealt.alias("dealt"), tokens().alias("size")).groupBy("_key", "dealt").agg(F.sum("size").alias("size")), "sizes")
    sources = materialize(slim.groupBy("_key").agg(F.sum("size").alias("size")), "sources")
    plan = materialize(weights(sources, max_repeats, target_entropy, total_tokens, block_tokens), "weights")
    drop_table(sources)

    held = slim.join(plan.select("_key", "blocks", "passes"), "_key").groupBy("_key", F.pmod("dealt", F.col("blocks")).alias("block")).agg(F.sum("size").alias("held"), F.any_value("passes").alias("passes"))
    held = held.select("_key", "block", "held", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass")).where("pass >= 0")
    held = held.withColumn("mark", mark(F.col("pass"), F.col("_key"), F.col("block"))).withColumn("bucket", F.substring("mark", 1, BUCKET_DIGITS))
    earlier = lambda *order: W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    buckets = held.groupBy("_key", "pass", "bucket").agg(F.sum("held").alias("held")).select("_key", "pass", "bucket", F.coalesce(F.sum("held").over(earlier("bucket").partitionBy("_key", "pass")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("held").over(earlier("mark", "block").partitionBy("_key", "pass", "bucket")), F.lit(0))
    before = held.withColumn("inside", inside).join(buckets, ["_key", "pass", "bucket"]).select("_key", "pass", "block", (F.col("first") + F.col("inside")).alias("before"))

    p = own_prefix(docs)
    renamed = lambda df: df.select(*[F.col(c).alias(p + c.removeprefix("_")) for c in df.columns])
    at = lambda c: F.col(p + c)
    placed = docs.withColumns({f"{p}key": key, f"{p}tokens": tokens(), f"{p}name": name, f"{p}dealt": dealt}).join(renamed(plan), f"{p}key")
    placed = placed.withColumn(f"{p}block", F.pmod(at("dealt"), at("blocks")))
    placed = placed.withColumn(f"{p}pass", F.explode(F.when(at("passes") > 0, F.sequence(F.lit(0), at("passes") - 1)).otherwise(F.array().cast("array<int>"))))
    own = [f"{p}key", f"{p}pass", f"{p}block"]
    inner = W.partitionBy(*own).orderBy(f"{p}mark", "doc_id", f"{p}tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn(f"{p}mark", mark(at("pass"), at("name"))).withColumn(f"{p}inside", F.coalesce(F.sum(at("tokens")).over(inner), F.lit(0)))
    placed = placed.join(renamed(before), own).withColumn(f"{p}start", at("pass") * at("size") + at("before") + at("inside")).where(at("start") < at("budget"))
    new = {f"{prefix}{n}": at(n) for n in ("tokens", "pass", "block", "start", "weight", "exponent")}
    return placed.withColumns(new).select(*[column(c) for c in docs.columns if c not in new], *[column(n) for n in new])


def mixed(docs: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The rows of docs as often as they are in the mix, with the columns of docs."""
    return mix(docs, max_repeats, prefix=own_prefix(docs) + "mix_").select(*[column(c) for c in docs.columns])
