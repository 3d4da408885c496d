"""Statistics of experiment tables: dispersion, pairs, ranks and corrections."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import masks


def long_form(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "value")


def oriented(metric: Column, value: Column) -> Column:
    """Ratios are best at 1: their distance from it."""
    return F.when(metric == "std_ratio", F.abs(value - 1)).otherwise(value)


def averages_in_order(df: DataFrame, by: list[str], values: dict[str, str], order: list[str]) -> DataFrame:
    """Averages (by name, of a column each) whose sums go through a group's rows in the given order, which must be total.

    Sums of floating numbers depend on their order in the last digits, which tell equal averages apart and settle ties of rounding. A sum of the sums of
    tasks would differ with the number of files and tasks, and from run to run.
    """
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.select(*by, *(F.avg(c).over(whole).alias(n) for n, c in values.items()))
    return rows.groupBy(*by).agg(*(F.max(n).alias(n) for n in values))


def dispersion(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    p = lambda q: F.percentile(value, F.lit(q))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.countDistinct(value).alias("n_values"), p(0.5).alias("median"), p(0.25).alias("q1"), p(0.75).alias("q3"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def trimmed_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean without the least and the greatest value, for four values or more: from sums, so no group is sorted."""
    s, n = F.sum(value), F.count(value)
    return df.groupBy(*by).agg(F.when(n >= 4, (s - F.min(value) - F.max(value)) / (n - 2)).otherwise(F.try_divide(s, n)).alias("trimmed"), n.alias("n"))


def paired(df: DataFrame, unit: list[str], method: str, value: str, one: str, other: str) -> DataFrame:
    """Units that both methods have, with d = one - other."""
    pick = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    return df.where(F.col(method).isin(one, other)).groupBy(*unit).agg(pick(one).alias("one"), pick(other).alias("other")).where("one IS NOT NULL AND other IS NOT NULL").withColumn("d", F.col("one") - F.col("other"))


def signed_ranks(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the average ranks of |d| by sign, without zeros, and the rank-biserial correlation.

    Ranks come from counts per distinct |d|: of equal ones, the middle of their places.
    """
    d = pairs.where("d <> 0").withColumn("a", F.abs("d"))
    points = d.groupBy(*by, "a").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    upto = Window.partitionBy(*by).orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("rank", F.sum("c").over(upto) - (F.col("c") - 1) / 2)
    sums = points.groupBy(*by).agg(F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("up"))).alias("w_minus"), F.sum("c").alias("n"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    return sums.withColumn("rank_biserial", (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")))


def holm(df: DataFrame, by: list[str], p: str = "p", order: list[str] = ()) -> DataFrame:
    """Step-down corrected p values; nulls stay null and don't count."""
    whole = Window.partitionBy(*by)
    run = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), *order)
    n = F.count(p).over(whole)
    raw = F.least(F.lit(1.0), (n - F.row_number().over(run) + 1) * F.col(p))
    rows = df.withColumn("_raw", raw)
    return rows.withColumn("holm", F.when(F.col(p).isNotNull(), F.max("_raw").over(run.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def against_baseline(df: DataFrame, by: list[str], method: str, value: str, base: str) -> DataFrame:
    """Change of each method's value against the baseline's, in percent."""
    b = df.where(F.col(method) == base).select(*by, F.col(value).alias("_base"))
    return df.join(b, by).withColumn("change_pct", F.try_divide(100 * (F.col(value) - F.col("_base")), F.col("_base"))).drop("_base")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts, the same in every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double")
    return bits / float(1 << 52)


def _poisson() -> tuple[float, ...]:
    bounds, p = [], math.exp(-1)
    total = p
    while total < 1 - 2**-52:
        bounds.append(total)
        p /= len(bounds)
        total += p
    return tuple(bounds)


#: Bounds of the distribution function of a Poisson variable of mean 1, up to the last that a hashed number can reach.
POISSON = _poisson()


#: Tasks that resampling is dealt to at least; tables of units are small, and would be one task.
DRAW_TASKS = 64


def dealt(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The same rows, spread over many tasks whatever their size, for work that multiplies them."""
    return df.repartition(max(DRAW_TASKS, 4 * df.sparkSession.sparkContext.defaultParallelism), *columns)


def poisson_weight(seed: int, draw: Column, unit: Column) -> Column:
    """How often a unit counts in a draw: how many of POISSON's bounds its hashed number reaches. The first 13 hexadecimal digits are compared as text, which is the same as comparing numbers."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), unit.cast("string")))
    out = None
    for k, bound in enumerate(POISSON):
        below = digest < f"{math.ceil(bound * (1 << 52)):013x}"
        out = F.when(below, k) if out is None else out.when(below, k)
    return out.otherwise(len(POISSON))


def bootstrap_mean(df: DataFrame, by: list[str], unit: str, value: str, draws: int = 20_000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean, null for fewer than 3 units: in each draw a unit counts as often as a hashed Poisson number says.

    Units are dealt to many tasks with all their values, so that a unit's number is hashed once a draw; draws are rows, summed before they are shuffled, so that no group meets in one task.
    """
    held = df.where(F.col(value).isNotNull()).groupBy(F.col(unit).alias("_unit")).agg(F.collect_list(F.struct(*by, F.col(value).alias("_v"))).alias("_all"))
    rows = dealt(held, "_unit").select("_unit", "_all", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    rows = rows.select("_draw", poisson_weight(seed, F.col("_draw"), F.col("_unit")).alias("_w"), F.explode("_all").alias("_x")).select(*(F.col(f"_x.{c}").alias(c) for c in by), "_draw", "_w", "_x._v")
    means = rows.groupBy(*by, "_draw").agg(F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    tail = (1 - level) / 2
    enough = lambda p: F.when(F.max("_n") >= 3, F.percentile("_m", F.lit(p)))
    return means.groupBy(*by).agg(enough(tail).alias("low"), enough(1 - tail).alias("high"))


def sign_flips(df: DataFrame, by: list[str], unit: str, d: str = "d", draws: int = 200_000, exact_up_to: int = 16, seed: int = 7) -> DataFrame:
    """Two-sided permutation test of the mean difference; zeros don't count, and p is null for fewer than 6 pairs.

    Up to `exact_up_to` pairs all signs are tried; beyond, that many draws of hashed signs, 64 from each hash. Sums of draws are
    merged by partial aggregation, so that no group meets in one task.
    """
    rows = df.where(F.col(d) != 0)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum(d)).alias("_seen"))
    rows = rows.join(sizes, by)
    numbered = rows.where(F.col("n") <= exact_up_to).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(unit)) - 1)
    each = dealt(numbered).withColumn("_draw", F.explode(F.expr("sequence(0L, shiftleft(1L, cast(n as int)) - 1)")))
    bit = F.expr("(_draw >> _k) & 1")
    exact = each.groupBy(*by, "n", "_seen", "_draw").agg(F.abs(F.sum(F.when(bit == 1, F.col(d)).otherwise(-F.col(d)))).alias("_t"))
    blocks = -(-draws // 64)
    many = dealt(rows.where(F.col("n") > exact_up_to)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_signs", F.xxhash64(F.lit(seed), F.col("_block"), F.col(unit)))
    sums = many.groupBy(*by, "n", "_seen", "_block").agg(*(F.sum(F.when(F.expr(f"(_signs >> {i}) & 1") == 1, F.col(d)).otherwise(-F.col(d))).alias(f"_s{i}") for i in range(64)))
    drawn = sums.select(*by, "n", "_seen", (F.col("_block") * 64).alias("_first"), F.posexplode(F.array(*(F.abs(f"_s{i}") for i in range(64)))).alias("_i", "_t")).where(F.col("_first") + F.col("_i") < draws)
    tried = exact.select(*by, "n", "_seen", "_t").unionByName(drawn.select(*by, "n", "_seen", "_t"))
    out = tried.groupBy(*by, "n").agg(((F.count_if(F.col("_t") >= F.col("_seen") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return out.select(*by, "n", F.when(F.col("n") >= 6, F.col("p")).alias("p"))


def _wilcoxon(w_plus: float, n: int, ties: float, less: bool) -> float:
    if n == 0:
        return math.nan
    if n <= 50 and not ties:
        ways = [1.0] + [0.0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for at in range(len(ways) - 1, rank - 1, -1):
                ways[at] += ways[at - rank]
        low = sum(ways[: int(w_plus) + 1]) / 2.0**n
        high = sum(ways[int(w_plus) :]) / 2.0**n
        return low if less else min(1.0, 2 * min(low, high))
    z = (w_plus - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return 0.5 * math.erfc(-z / math.sqrt(2)) if less else math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def wilcoxon_p(w_plus: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p value of signed ranks: exact up to 50 pairs without ties, else by the normal distribution."""
    return pd.Series([_wilcoxon(w, int(k), t, False) for w, k, t in zip(w_plus, n, ties, strict=True)])


@F.pandas_udf(DoubleType())
def wilcoxon_p_less(w_plus: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    """The same, one-sided: small if differences tend to be below 0."""
    return pd.Series([_wilcoxon(w, int(k), t, True) for w, k, t in zip(w_plus, n, ties, strict=True)])


def p_floor(n: Column) -> Column:
    """The least two-sided p value that n pairs can give; null without any."""
    return F.when(n >= 1, F.least(F.lit(1.0), 2 / F.pow(F.lit(2.0), n)))


def finite_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation and median of what is finite, and how many values aren't."""
    good = F.when(masks.finite(F.col(value)), F.col(value))
    return df.groupBy(*by).agg(F.avg(good).alias("mean"), F.stddev_pop(good).alias("sd"), F.percentile(good, F.lit(0.5)).alias("median"), F.count_if(good.isNull()).alias("excluded"))


def off_by_more(df: DataFrame, by: list[str], stored: str, found: str, tolerance: float = 0.0051) -> DataFrame:
    """Stored values against recomputed ones: how many differ by more than the tolerance, and the greatest difference."""
    d = F.abs(F.col(stored) - F.col(found))
    return df.groupBy(*by).agg(F.count_if(d > tolerance).alias("off"), F.max(d).alias("most"), F.count(F.lit(1)).alias("n"))


def levels(pairs: DataFrame, by: dict[str, list[str]], one: str = "one", other: str = "other") -> DataFrame:
    """Paired differences at several levels: level, n, median_diff, share_better, rank_biserial, w and the least p that n pairs can give.

    by: level -> columns whose groups are its units; a group counts with the difference of its medians, so that what is repeated within it adds nothing.
    """
    out = None
    for level, keys in by.items():
        p = lambda c: F.percentile(c, F.lit(0.5))
        d = pairs.groupBy(*keys).agg(F.round(p(one) - p(other), 9).alias("d")).withColumn("level", F.lit(level))
        all_of = d.groupBy("level").agg(F.count("d").alias("n"), p("d").alias("median_diff"), F.avg((F.col("d") < 0).cast("double")).alias("share_better"))
        ranks = signed_ranks(d, ["level"]).select("level", "rank_biserial", F.least("w_plus", "w_minus").alias("w"))
        rows = all_of.join(ranks, "level", "left").withColumn("floor", p_floor(F.col("n")))
        out = rows if out is None else out.unionByName(rows)
    return out


def ordinal_ranks(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """df with rank 1, 2, ... by value; equal values rank in the given order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(value, *order)))


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: str, draws: int = 20_000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Percentile interval of the median of clusters' medians, null for fewer than 3 clusters.

    Each draw takes as many clusters as there are, by hashed numbers and with repeats. A row stands for one taking, so the work is draws times
    clusters; values have been summed up by cluster before.
    """
    medians = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    medians = medians.withColumns({"_i": F.row_number().over(Window.partitionBy(*by).orderBy(cluster)) - 1, "_k": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    takings = medians.select(*by, "_k", F.col("_i").alias("_slot"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    takings = takings.withColumn("_i", F.floor(uniform(F.lit(seed), F.col("draw"), F.col("_slot")) * F.col("_k")).cast("int"))
    found = takings.join(medians.select(*by, "_i", "_m"), [*by, "_i"]).groupBy(*by, "_k", "draw").agg(F.percentile("_m", F.lit(0.5)).alias("_d"))
    tail = (1 - level) / 2
    edge = lambda p: F.when(F.col("_k") >= 3, F.percentile("_d", F.lit(p)))
    return found.groupBy(*by, "_k").agg(edge(tail).alias("low"), edge(1 - tail).alias("high")).select(*by, F.col("_k").alias("clusters"), "low", "high")


def length_effects(df: DataFrame, by: list[str], length: str, value: str, excluded: tuple[float, ...] = (), tolerance: float = 1e-6) -> DataFrame:
    """By method: least and greatest of the values' trimmed means by length, the deviation between them, and their change per decade of length.

    Lengths within the tolerance of excluded ones are left out, as the caller asks.
    """
    for x in excluded:
        df = df.where(F.abs(F.col(length) - x) > tolerance)
    rows = trimmed_mean(df, [*by, length], value)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("lengths"), F.min("trimmed").alias("least"), F.max("trimmed").alias("most"), F.stddev_samp("trimmed").alias("sd"), F.regr_slope("trimmed", F.log10(length)).alias("per_decade"))
