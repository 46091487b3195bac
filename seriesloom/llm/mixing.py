"""Mixing sources to target weights: hierarchical token budgets and seeded prefixes.

The tree is domain, language, source. A node's budget is split among its children by weight; what a child cannot use
goes to its siblings by weight, and only what the whole family cannot use was given to the node's own siblings before,
because a node's capacity is that of its leaves together. Each leaf then takes whole epochs of its documents and, of one
more epoch in that epoch's seeded order, the prefix that fits.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

NONE = "(none)"
LEAF = ("domain", "tree_lang", "tree_source")
WORD = r"[^\x20\x09-\x0D]+"


def leaf_name(c: Column) -> Column:
    """A level's name in the tree: nulls are a name of their own, which no real name can be."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"^(\\*\(none\))", r"\\$1"), F.lit(NONE))


def weight_of(key: Column, weights: Mapping[str, float]) -> Column:
    """The weight named for a key, 1 for every other key."""
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(key == name, F.lit(float(w))).otherwise(out)
    return out


def water_fill(children: DataFrame, parent: list[str], key: str, budget: str, out: str) -> DataFrame:
    """Add `out`: each child's part of its parent's budget, by `weight`, none above its `capacity`.

    The share that all children above the water line get for a unit of weight is found from running sums in the order of
    capacity by weight: a child is full if all children up to it are full within the budget.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    family = Window.partitionBy(*parent)
    earlier = family.orderBy("_ratio", key).rowsBetween(Window.unboundedPreceding, -1)
    sums = children.withColumn("_ratio", ratio).select(
        "*", F.coalesce(F.sum("capacity").over(earlier), F.lit(0)).alias("_used"),
        (F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))).alias("_open"),
    )
    full = F.when(F.col("weight") > 0, F.col("_used") + F.col("_ratio") * F.col("_open") <= F.col(budget)).otherwise(False)
    lines = sums.withColumn("_full", full).select(
        "*", F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(family).alias("_taken"),
        F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0.0)).over(family).alias("_rest"),
    )
    level = F.when(F.col("_rest") > 0, (F.col(budget) - F.col("_taken")) * F.col("weight") / F.col("_rest")).otherwise(0.0)
    part = F.when(F.col("_full"), F.col("capacity").cast("double")).otherwise(F.least(level, F.col("capacity").cast("double")))
    return lines.withColumn(out, part).drop("_ratio", "_used", "_open", "_full", "_taken", "_rest")


def leaf_budgets(leaves: DataFrame, total: Column, domain_weights: Mapping[str, float], lang_weights: Mapping[str, float], source_weights: Mapping[str, float], epochs: int) -> DataFrame:
    """Add `budget` (whole tokens) to rows (domain, tree_lang, tree_source, tokens)."""
    domain, lang, source = LEAF
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    langs = leaves.groupBy(domain, lang).agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy(domain).agg(F.sum("capacity").alias("capacity")).withColumn("root", F.lit(0))
    domains = domains.withColumn("weight", weight_of(F.col(domain), domain_weights)).withColumn("total", total)
    top = water_fill(domains, ["root"], domain, "total", "domain_budget").select(domain, "domain_budget")
    mid = langs.join(top, domain).withColumn("weight", weight_of(F.col(lang), lang_weights))
    mid = water_fill(mid, [domain], lang, "domain_budget", "lang_budget").select(domain, lang, "lang_budget")
    low = leaves.join(mid, [domain, lang]).withColumn("weight", weight_of(F.col(source), source_weights))
    low = water_fill(low, [domain, lang], source, "lang_budget", "part")
    return low.select(*LEAF, "tokens", F.floor(F.round("part", 6)).cast("long").alias("budget"))


def mix_copies(
    docs: DataFrame, domain: Column, share: float = 0.5, epochs: int = 2, seed: int = 8,
    domain_weights: Mapping[str, float] | None = None, lang_weights: Mapping[str, float] | None = None, source_weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """For every document the number of copies that the mixture takes, with its leaf's budget.

    `share` of all tokens (words divided by ASCII white space) is the budget, no leaf gives more than `epochs` times its
    tokens. A null domain, language or source is the leaf "(none)"; a null or empty text has no tokens and is taken
    only in whole epochs; a document longer than what is left of its leaf's budget ends the prefix. Rows of equal id are
    ordered by text checksum and are taken together where these agree too. An empty table gives no rows.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    named = [domain, docs["lang"], docs["source"]]
    slim = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), *[leaf_name(c).alias(n) for c, n in zip(named, LEAF, strict=True)],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.crc32(text.cast("binary")).alias("check"),
    )
    slim = stored(slim, "mix-docs")
    leaves = slim.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    all_tokens = slim.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    plan = leaf_budgets(leaves, F.lit(int(share * all_tokens)), domain_weights or {}, lang_weights or {}, source_weights or {}, epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(epochs)).cast("int")
    plan = plan.withColumn("whole_epochs", whole).withColumn("left", F.col("budget") - F.col("tokens") * F.col("whole_epochs"))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)), F.col("whole_epochs").cast("string")))
    drawn = slim.join(plan, list(LEAF)).withColumn("draw", order)
    # the running sum of a leaf of any size: sums of 4096 ranges of the draw first, then inside each range
    drawn = drawn.withColumn("range", F.substring("draw", 1, 3))
    sums = drawn.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("range_tokens"))
    leaf_order = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEAF, "range", F.coalesce(F.sum("range_tokens").over(leaf_order), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy(*LEAF, "range").orderBy("draw", "doc_id", "check")
    placed = drawn.join(sums, [*LEAF, "range"]).withColumn("ends", F.col("earlier") + F.sum("n_tokens").over(inside))
    extra = (F.col("left") > 0) & (F.col("ends") <= F.col("left"))
    return placed.select(
        "doc_id", "domain", F.col("tree_lang").alias("lang"), F.col("tree_source").alias("source"), "n_tokens",
        F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"), "whole_epochs", extra.alias("in_prefix"),
        (F.col("whole_epochs") + extra.cast("int")).alias("copies"), "check",
    )


def mix(docs: DataFrame, domain: Column, **how) -> DataFrame:
    """The mixed table: the rows of `docs`, each as many times as `mix_copies` says, all columns as they are, whatever their names.

    Rows of one id and text checksum that differ in their leaf get their own leaf's copies.
    """
    keys = ["id", "sum", *LEAF]
    taken = mix_copies(docs, domain, **how).where("copies > 0").groupBy("doc_id", "check", "domain", "lang", "source").agg(F.max("copies").alias("copies"))
    taken = taken.toDF(*keys, "copies")
    named = [domain, docs["lang"], docs["source"]]
    rows = docs.select(
        docs["doc_id"].cast("long").alias("id"), F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("sum"),
        *[leaf_name(c).alias(n) for c, n in zip(named, LEAF, strict=True)], F.struct("*").alias("row"),
    )
    same = [rows[k].eqNullSafe(taken[k]) for k in keys]
    joined = rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn"))
    return joined.select("row.*")
