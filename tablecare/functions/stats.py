"""Aggregates: quantiles by averaging at jumps, skewness, kurtosis and the dependence of gaps."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, nextafter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

#: Share of the rows on either side of a quantile that the first look leaves open, and counted values that end the search.
WINDOW, FEW_VALUES = 2e-4, 20_000
#: Accuracy of the sketches that open windows: an error in rank of one row in so many.
ACCURACY = 20_000


def quantile(expression: str, p: float, exact: bool = True, accuracy: int = 10_000) -> Column:
    """The p-quantile that averages the two neighbours where n * p is whole (type 2), or an approximate one.

    As an exact aggregate it holds all distinct values of a group: for groups of bounded size. `group_quantiles` and `quantiles` have no bound.
    """
    if not exact:
        return F.expr(f"approx_percentile({expression}, {p}, {accuracy})")
    return F.expr(f"(percentile_disc({p}) WITHIN GROUP (ORDER BY {expression}) + percentile_disc({1 - p}) WITHIN GROUP (ORDER BY {expression} DESC)) / 2")


def group_quantiles(df: DataFrame, keys: list[str], value: Column, ps: tuple[float, ...]) -> DataFrame:
    """keys, n, q0, q1, ...: how many numbers each group has and their p-quantiles (type 2), exact, for groups of any size.

    All groups are ranked together: counts of (key, number) are range-partitioned, each partition's totals are summed up
    key by key, and running counts within a partition then tell which numbers stand at the wanted ranks. A group that
    fills many partitions is many tasks' work; a task holds one partition's counts at most. Null is a key like others;
    groups without a number have no row.
    """
    spark = df.sparkSession
    own = [f"k{i}" for i in range(len(keys))]
    cells = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, own, strict=True)], value.alias("v")).where("v IS NOT NULL")
    counts = cells.groupBy(*own, "v").agg(F.count("*").alias("c"))
    ranged = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *own, "v")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    of_key, so_far = W.partitionBy(*own), lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("part", *own).agg(F.sum("c").alias("held"))
    totals = totals.withColumns({"before": F.coalesce(F.sum("held").over(so_far(of_key.orderBy("part"))), F.lit(0)), "n": F.sum("held").over(of_key)}).drop("held")
    totals = totals.select(*[F.col(c).alias(f"{c}_") for c in ("part", *own)], "before", "n")
    met = ranged.join(totals, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("part", *own)])
    first = F.col("before") + F.coalesce(F.sum("c").over(so_far(W.partitionBy("part", *own).orderBy("v"))), F.lit(0))
    met = met.withColumn("first", first).withColumn("last", F.col("first") + F.col("c"))
    at = lambda rank: (F.col("first") < rank) & (rank <= F.col("last"))
    ranks = [(F.ceil(F.col("n") * p), F.col("n") + 1 - F.ceil(F.col("n") * (1 - p))) for p in ps]
    wanted = [F.when(at(r), F.col("v")).alias(f"{side}{i}") for i, pair in enumerate(ranks) for side, r in zip("lh", pair, strict=True)]
    hits = met.select(*own, "n", *wanted).where(F.coalesce(*[f"{side}{i}" for i in range(len(ps)) for side in "lh"]).isNotNull())
    found = hits.groupBy(*own).agg(F.max("n").alias("n"), *[((F.max(f"l{i}") + F.max(f"h{i}")) / 2).alias(f"q{i}") for i in range(len(ps))])
    return found.select(*[F.col(k).alias(c) for k, c in zip(own, keys, strict=True)], "n", *[f"q{i}" for i in range(len(ps))])


@dataclass
class _Search:
    """The value at one rank of one column: below `low` are `before` rows; the value is in [low, high]."""

    column: int
    rank: int
    low: float = float("-inf")
    high: float = float("inf")
    value: float | None = field(default=None)


def quantiles(wide: DataFrame, names: list[str], ps: tuple[float, ...], exact: bool = True) -> dict[str, tuple[int, list[float | None]]]:
    """For each column of finite numbers: how many it has, and its quantiles (type 2; null without numbers).

    Exact without a large buffer: sketches give a narrow window around each wanted rank, one pass counts what lies
    before the window and the values in it, and a window with many values is narrowed again. The driver receives some
    numbers a column and FEW_VALUES counted values a window at most.
    """
    if not names:
        return {}
    sketch = lambda c, at: F.expr(f"approx_percentile(`{c}`, array({', '.join(map(repr, at))}), {ACCURACY})")
    around = [min(1.0, max(0.0, p + d)) for p in ps for d in (-WINDOW, WINDOW)]
    first = wide.agg(*[x for i, c in enumerate(names) for x in (F.count(c).alias(f"k{i}"), sketch(c, around if exact else list(ps)).alias(f"q{i}"))]).first()
    sizes = [first[f"k{i}"] for i in range(len(names))]
    if not exact:
        return {c: (n, list(first[f"q{i}"]) if n else [None] * len(ps)) for i, (c, n) in enumerate(zip(names, sizes, strict=True))}
    found: dict[tuple[int, int], _Search] = {}
    for i, n in enumerate(sizes):
        for j, p in enumerate(ps):
            for rank in {ceil(n * p), n + 1 - ceil(n * (1 - p))} if n else ():
                found[i, rank] = _Search(i, rank, first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1])
    if found and max(sizes) * 2 * (WINDOW + 1 / ACCURACY) <= FEW_VALUES:
        _count_all(wide, names, list(found.values()))
    while open_ := [s for s in found.values() if s.value is None]:
        _look(wide, names, open_)
    at = lambda i, rank: found[i, rank].value
    return {c: (n, [(at(i, ceil(n * p)) + at(i, n + 1 - ceil(n * (1 - p)))) / 2 if n else None for p in ps]) for i, (c, n) in enumerate(zip(names, sizes, strict=True))}


def _count_all(wide: DataFrame, names: list[str], searches: list[_Search]) -> None:
    """Settle what lies in its window, in one pass, for windows that sketches leave few different values in."""
    windows = sorted({(s.column, s.low, s.high) for s in searches})
    column = lambda w: F.col(f"`{names[w[0]]}`")
    cell = lambda k, w: F.when(column(w) <= F.lit(w[2]), F.struct(F.lit(k).alias("k"), F.when(column(w) >= F.lit(w[1]), column(w)).alias("v")))
    cells = F.filter(F.array(*[cell(k, w) for k, w in enumerate(windows)]), lambda x: x.isNotNull())
    held: dict[int, list[tuple[float, int]]] = {}
    for r in wide.select(F.inline(cells)).groupBy("k", "v").agg(F.count("*").alias("n")).collect():
        held.setdefault(r.k, []).append((float("-inf") if r.v is None else r.v, r.n))
    for k, w in enumerate(windows):
        for s in (s for s in searches if (s.column, s.low, s.high) == w):
            left = s.rank
            for v, n in sorted(held.get(k, [])):
                left -= n
                if left <= 0:
                    s.value = v if v != float("-inf") else None
                    break


def _look(wide: DataFrame, names: list[str], searches: list[_Search]) -> None:
    """Settle searches whose window holds few values; narrow the others, or move them aside."""
    windows = sorted({(s.column, s.low, s.high) for s in searches})
    column = lambda w: F.col(f"`{names[w[0]]}`")
    inside = lambda w: column(w).between(F.lit(w[1]), F.lit(w[2]))
    counts = wide.agg(*[x for k, w in enumerate(windows) for x in (F.count_if(column(w) < F.lit(w[1])).alias(f"b{k}"), F.count_if(inside(w)).alias(f"i{k}"))]).first()
    wanted = {w: [s for s in searches if (s.column, s.low, s.high) == w] for w in windows}
    few, many = [], []
    for k, w in enumerate(windows):
        before, held = counts[f"b{k}"], counts[f"i{k}"]
        within = False
        for s in wanted[w]:
            if s.rank <= before:
                s.low, s.high = float("-inf"), nextafter(w[1], float("-inf"))
            elif s.rank > before + held:
                s.low, s.high = nextafter(w[2], float("inf")), float("inf")
            elif w[1] == w[2]:
                s.value = w[1]
            else:
                within = True
        if within:
            (few if held <= FEW_VALUES else many).append(k)
    if few:
        cells = F.filter(F.array(*[F.when(inside(windows[k]), F.struct(F.lit(k).alias("k"), column(windows[k]).alias("v"))) for k in few]), lambda x: x.isNotNull())
        values: dict[int, list[tuple[float, int]]] = {k: [] for k in few}
        for r in wide.select(F.inline(cells)).groupBy("k", "v").agg(F.count("*").alias("n")).collect():
            values[r.k].append((r.v, r.n))
        for k in few:
            for s in wanted[windows[k]]:
                left = s.rank - counts[f"b{k}"]
                if s.value is None and 0 < left <= counts[f"i{k}"]:
                    for v, n in sorted(values[k]):
                        left -= n
                        if left <= 0:
                            s.value = v
                            break
    if many:
        cuts = wide.agg(*[F.percentile_approx(F.when(inside(windows[k]), column(windows[k])), [x / 64 for x in range(65)], 1000).alias(f"s{k}") for k in many]).first()
        for k in many:
            at, before, held = cuts[f"s{k}"], counts[f"b{k}"], counts[f"i{k}"]
            for s in wanted[windows[k]]:
                if s.value is None and before < s.rank <= before + held and (s.low, s.high) == windows[k][1:]:
                    place = int((s.rank - before) / held * 64)
                    s.low, s.high = at[max(0, place - 1)], at[min(64, place + 2)]
                    if (s.low, s.high) == windows[k][1:]:  # one value may fill nearly all: try it, then the rest on either side
                        s.low = s.high = at[32]


def skewness(c: Column) -> Column:
    """Sample skewness G1; null for fewer than three values or equal ones."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column) -> Column:
    """Sample excess kurtosis G2; null for fewer than four values or equal ones."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))
