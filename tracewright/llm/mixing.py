"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources splits a token budget. At each node the budget goes to the children by
weight, but to none more than it can hold (its tokens times the number of epochs): what a child can't hold goes to
its siblings by weight, and only what all of them can't hold goes to the siblings of their parent. Each leaf then
takes whole epochs of its documents and, of the last epoch, the prefix of a seeded order that its budget covers: a
document at the edge is taken if at least half of it is inside.

Cases: a null text has no tokens, and a document without tokens is taken where the prefix reaches it; null languages
and sources are nodes of their own; leaves without tokens get no budget; equal ids are ordered by token count, and
repeated rows are taken one by one; an empty table gives no rows; other columns are passed through. The sources of one language of a
domain are put in order by one task, so that there may be some ten millions of them, with any number of documents each.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, bucket_of, col, key_text, rows_of, with_totals_before, written

#: The share of the budget of each domain, in the order of their numbers.
DOMAIN_WEIGHTS = (0.4, 0.3, 0.2, 0.1)


def domain_of(source: Column, domains: int = len(DOMAIN_WEIGHTS)) -> Column:
    """The domain that a source belongs to: hashed, as the tables name none."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 7), 16, 10).cast("long")
    return (hashed % domains).cast("int")


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fill(nodes: DataFrame, parent: list[str], budget: str, capacity: str, weight: str, out: str, name: str) -> DataFrame:
    """Splits the budget of each parent among its children: the least of capacity and level * weight, at one level for all.

    Children are ordered by capacity / weight. Those up to some place are full; the level is what is left over the
    weights of the rest, at the first place where it doesn't exceed that child's own capacity / weight. Past that place
    it only falls, so that it is the greatest of those that fit.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("_ratio"), F.col(name))
    whole = Window.partitionBy(*parent)
    df = nodes.withColumn("_ratio", F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf"))))
    df = df.withColumn("_full", F.coalesce(F.sum(capacity).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("_rest", F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("_level", F.when(F.col("_rest") > 0, (F.col(budget) - F.col("_full")) / F.col("_rest")))
    df = df.withColumn("_fit", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
    given = F.when(F.col("_fit").isNull(), F.col(capacity)).otherwise(F.least(F.col(capacity), F.greatest(F.col("_fit"), F.lit(0.0)) * F.col(weight)))
    return df.withColumn(out, given).drop("_ratio", "_full", "_rest", "_level", "_fit")


def weight_of(name: str, weights: Mapping | None) -> Column:
    """The target weight of a node by its name: 1 for all without weights, and for one that they don't state (write null as None)."""
    out = F.lit(1.0)
    for value, w in (weights or {}).items():
        out = F.when(F.col(name).eqNullSafe(F.lit(value)), F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int, domain_weights: tuple[float, ...] = DOMAIN_WEIGHTS, lang_weights: Mapping | None = None, source_weights: Mapping | None = None) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds `given`, the tokens that each leaf is to supply.

    Domains have the stated weights (others none); languages and sources under one parent have those of the mappings, else equal ones.
    """
    caps = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double"))
    weight = F.lit(0.0)
    for i, w in reversed(list(enumerate(domain_weights))):
        weight = F.when(F.col("domain") == i, F.lit(float(w))).otherwise(weight)
    one = Window.partitionBy("root")
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("root", F.lit(0)).withColumn("w", weight)
    domains = domains.withColumn("budget", budget.cast("double")) if budget is not None else domains
    domains = domains.withColumn("budget", F.least(F.col("budget"), F.sum("cap").over(one)))
    domains = fill(domains, ["root"], "budget", "cap", "w", "d_given", "domain").select("domain", "d_given")
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain").withColumn("w", weight_of("lang", lang_weights))
    langs = fill(langs, ["domain"], "d_given", "cap", "w", "l_given", "lang").select("domain", "lang", "l_given")
    leaf = caps.alias("a").join(langs.alias("b"), F.col("a.domain").eqNullSafe(F.col("b.domain")) & F.col("a.lang").eqNullSafe(F.col("b.lang"))).select("a.*", "b.l_given").withColumn("w", weight_of("source", source_weights))
    return fill(leaf, ["domain", "lang"], "l_given", "cap", "w", "given", "source").select("domain", "lang", "source", "tokens", "given")


def mix(df: DataFrame, share: float, epochs: int = 1, seed: int = 0, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None, **weights) -> DataFrame:
    """The copies that the mixture takes of each row: _id, text_hash, domain, lang, source, tokens, copies.

    share: the budget over all tokens of df. epochs: how often a document can be taken at most. domain: the number of a row's domain,
    if not hashed from its source. weights: domain_weights, lang_weights and source_weights, as in leaf_budgets. Only ids, labels
    and token counts are shuffled, and each leaf is ordered in buckets of its seeded hash.
    """
    kinds = len(weights.get("domain_weights", DOMAIN_WEIGHTS))
    number = domain_of(col(source).cast("string"), kinds) if domain is None else domain.cast("int")
    rows = df.select(col(key).alias("_id"), F.xxhash64(col(text).cast("string")).alias("text_hash"), col(lang).cast("string").alias("lang"), col(source).cast("string").alias("source"), token_count(col(text)).alias("tokens"), number.alias("domain"))
    rows = written(rows, "mixing-rows")
    leaves = rows.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"))
    everything, n = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    budgets = leaf_budgets(leaves, F.lit(float(share) * everything), epochs, **weights)
    budgets = budgets.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens") + 1e-9)).otherwise(0).cast("long"))
    budgets = budgets.withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens"))
    leaf = ["domain", "lang", "source"]
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in leaf]
    rows = rows.alias("l").join(budgets.alias("r"), on).select("l.*", "r.whole", "r.rest", "r.given")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), key_text("_id")))
    rows = rows.withColumn("_hash", order).withColumn("_bucket", bucket_of(F.col("_hash"), bucket_bits(n)))
    rows = with_totals_before(rows, leaf, "_bucket", [F.col(c) for c in ("_hash", "_id", "tokens", "text_hash")], F.col("tokens"), "before")
    last = (F.col("given") > 0) & (F.col("whole") < epochs) & (F.col("before") + F.col("tokens") / 2 <= F.col("rest") + 1e-6)
    return rows.withColumn("copies", F.col("whole") + F.when(last, 1).otherwise(0)).select("_id", "text_hash", *leaf, "tokens", F.col("copies").cast("long").alias("copies"))


def mixture(df: DataFrame, share: float, epochs: int = 1, seed: int = 0, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df that the mixture takes, a row that it takes several times as several rows."""
    taken = mix(df, share, epochs, seed, key, text, **options).groupBy("_id", "text_hash").agg(F.sum("copies").alias("copies")).where("copies > 0")
    return rows_of(df, written(taken.withColumnRenamed("_id", "doc_id"), "mixture"), key, text)
