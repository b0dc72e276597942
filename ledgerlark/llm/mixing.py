"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree (say domain, language, source) by the weights of sibling
nodes.  A node takes at most what lies below it times ``max_epochs``; what it can't take goes
to its siblings by weight, and only what a whole family can't take is missed by its parent's
siblings, since every level is filled with the capacities of whole subtrees.  Each leaf gives
whole epochs and a token-prefix of one more, in an order seeded per leaf.

A leaf's prefix is found in two steps, token sums of hash buckets of about ``BUCKET_ROWS``
rows and then the rows inside a bucket, so a leaf with a third of all rows is no single task.

Defined cases: null node names are a node of their own; null text has no tokens (such rows go
with whole epochs, or before the prefix ends); equal rows are told apart by no order but are
equal; unlisted nodes weigh ``default_weight``; an empty table gives an empty result; columns of
the input stay, ``epoch`` comes in and replaces one of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .native import words
from .storage import save

BUCKET_ROWS = 1000


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _weight(level: int, name: Column, weights, default: float) -> Column:
    table = weights[level] if level < len(weights) else {}
    out = F.lit(float(default))
    for key, value in table.items():
        out = F.when(name.eqNullSafe(F.lit(key)), F.lit(float(value))).otherwise(out)
    return out


def _fill(nodes: DataFrame, parents: DataFrame | None, depth: int, budget: float) -> DataFrame:
    """Budgets of sibling nodes: each gets ``least(capacity, level * weight)`` with the level
    at which the family's budget is spent."""
    up = [f"l{i}" for i in range(depth)]
    if parents is None:
        nodes = nodes.withColumn("family", F.lit(float(budget)))
    else:
        above = parents.select(*[F.col(c).alias(f"p_{c}") for c in up], F.col("budget").alias("family"))
        nodes = nodes.join(above, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in up]).drop(*[f"p_{c}" for c in up])
    ratio = F.col("capacity") / F.col("weight")
    order = [F.asc("ratio"), *[F.asc_nulls_first(f"l{i}") for i in range(depth + 1)]]
    family = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(0))
    before = family.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = family.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.where("weight > 0").withColumn("ratio", ratio)
    nodes = nodes.withColumn("at", (F.col("family") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.max(F.when(F.col("ratio") >= F.col("at"), F.col("at"))).over(family)
    return nodes.withColumn("budget", F.least(F.col("capacity"), F.coalesce(level, F.col("ratio")) * F.col("weight"))).drop("ratio", "at", "family")


def budgets(docs: DataFrame, levels: list[Column], tokens: Column, weights, total_tokens: float | None = None, max_epochs: int = 4, default_weight: float = 1.0) -> DataFrame:
    """One row per leaf: ``l0..`` (its path), ``rows``, ``tokens`` and ``budget``."""
    names = [f"l{i}" for i in range(len(levels))]
    leaves = save(docs.select(*[c.alias(n) for c, n in zip(levels, names)], tokens.alias("t")).groupBy(*names).agg(F.count("*").alias("rows"), F.sum("t").alias("tokens")))
    if total_tokens is None:
        total_tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    filled = None
    for depth in range(len(levels)):
        nodes = leaves.groupBy(*names[: depth + 1]).agg((F.sum("tokens") * float(max_epochs)).alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(depth, F.col(names[depth]), weights, default_weight))
        filled = _fill(nodes, filled, depth, total_tokens)
    spent = filled.select(*[F.col(n).alias(f"f_{n}") for n in names], "budget")
    return save(leaves.join(spent, [F.col(n).eqNullSafe(F.col(f"f_{n}")) for n in names]).drop(*[f"f_{n}" for n in names]))


def mix(docs: DataFrame, levels: list[Column], tokens: Column, weights=(), total_tokens: float | None = None, max_epochs: int = 4, seed: int = 0, default_weight: float = 1.0) -> DataFrame:
    """The chosen rows of ``docs``, once for each epoch they are chosen in, with ``epoch`` from 0."""
    columns = docs.columns
    leaf = budgets(docs, levels, tokens, weights, total_tokens, max_epochs, default_weight)
    names = [f"m_l{i}" for i in range(len(levels))]
    keyed = docs.select(F.struct(*columns).alias("m_row"), *[c.alias(n) for c, n in zip(levels, names)], tokens.cast("long").alias("m_t"))
    # leaves are as many as sources; a join and no broadcast hint, so that Spark checks their size
    same = [F.col(n).eqNullSafe(F.col(f"l{i}")) for i, n in enumerate(names)]
    keyed = keyed.join(leaf, same).drop(*[f"l{i}" for i in range(len(levels))])
    # the hash of the row orders the epochs; equal rows tie, and are equal
    place = F.xxhash64(F.lit(seed), *names, F.xxhash64("m_row"))
    keyed = (
        keyed.withColumn("m_place", place)
        .withColumn("m_leaf", F.xxhash64(*names))
        .withColumn("m_full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("int"))
        .withColumn("m_rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("m_full") * F.col("tokens")).otherwise(F.lit(-1.0)))
        .withColumn("m_bucket", F.pmod(F.shiftright("m_place", 20), F.ceil(F.col("rows") / BUCKET_ROWS)))
        .drop("rows", "tokens", "budget")
    )
    bucket = keyed.groupBy("m_leaf", "m_bucket").agg(F.sum("m_t").alias("t"))
    ahead = Window.partitionBy("m_leaf").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = save(bucket.select(F.col("m_leaf").alias("b_leaf"), F.col("m_bucket").alias("b_bucket"), F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("b_before")))
    inside = Window.partitionBy("m_leaf", "m_bucket").orderBy("m_place").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("m_upto", F.sum("m_t").over(inside)).join(bucket, (F.col("m_leaf") == F.col("b_leaf")) & (F.col("m_bucket") == F.col("b_bucket")))
    copies = F.col("m_full") + (F.col("b_before") + F.col("m_upto") <= F.col("m_rest")).cast("int")
    chosen = keyed.withColumn("m_copies", copies).where("m_copies > 0")
    return chosen.withColumn("m_epoch", F.explode(F.sequence(F.lit(0), F.col("m_copies") - 1))).select(*[F.col(f"m_row.{c}") for c in columns if c != "epoch"], F.col("m_epoch").alias("epoch"))


#: Target weights of the production mix: domains, languages, sources (equal).
DOMAINS = {"web": 0.5, "books": 0.3, "forums": 0.2}
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
WEIGHTS = (DOMAINS, LANGUAGES, {})


def domain(source: Column) -> Column:
    """The domain of a source by its number: 0 to 9 web, 10 to 14 books, others forums."""
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return F.when(number <= 9, "web").when(number <= 14, "books").otherwise("forums")


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    return mix(docs, [domain(F.col("source")), F.col("lang"), F.col("source")], n_words(F.col("text")), WEIGHTS, seed=seed)
