"""Exact quantiles of groups of any size, by selection instead of sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of one bracket that are put in order at the end.
MOST_VALUES = 1_000_000
#: Parts into which a counting round cuts a bracket.
SLOTS = 256


def _hits(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row next to the targets of its group whose bracket does not end below it."""
    packed = targets.groupBy(*keys).agg(F.collect_list(F.struct("q", "side", "rank", "lo", "hi")).alias("_t"))
    joined = rows.join(packed, list(keys)) if keys else rows.withColumn("_t", packed.select("_t").scalar())
    near = F.filter("_t", lambda t: F.col("_x") <= t["hi"])
    return joined.select(*keys, "_x", F.explode(near).alias("t"))


def _at_rank(counted: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The counted parts that hold their target's rank; `n` is a part's number of rows."""
    upto = F.sum("n").over(Window.partitionBy(*keys, "q", "side").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    steps = counted.withColumn("_upto", upto)
    return steps.where((F.col("_upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("_upto"))).drop("_upto")


def narrowed(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One counting round: each bracket shrinks to the values of that one of its parts that holds the rank.

    Only counts and extremes of the parts are shuffled, combined inside the map tasks.
    """
    lo, hi = F.col("t.lo") / 2, F.col("t.hi") / 2  # halves, so that no difference overflows
    part = F.when(hi > lo, F.least(F.lit(SLOTS - 1), F.floor((F.col("_x") / 2 - lo) / (hi - lo) * SLOTS))).otherwise(0)
    slot = F.when(F.col("_x") < F.col("t.lo"), -1).otherwise(part).cast("int")
    parts = _hits(rows, targets, keys).groupBy(*keys, "t.q", "t.side", "t.rank", slot.alias("slot"))
    counted = parts.agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    return _at_rank(counted, keys, F.col("slot")).select(*keys, "q", "side", "rank", "lo", "hi", "n")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float], accuracy: int = 2000, most: int = MOST_VALUES
) -> DataFrame:
    """Linear-interpolated quantiles per group without holding a group in one task.

    A mergeable sketch first brackets each wanted rank (its rank error is at most n/accuracy). While a bracket may hold more than `most`
    rows of different values, a counting round cuts it to one of its 256 parts. The last pass counts the rows below
    each bracket and the distinct values inside it, and reads the order statistics from those. NaN counts as missing.
    """
    keys = list(by)
    eps = 2.0 / accuracy
    cuts: list[float] = []
    for p in probs.values():
        cuts += [max(0.0, p - eps), min(1.0, p + eps)]
    v = F.col(col).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_x"))
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_x", cuts, accuracy * 2).alias("_c"),
        F.min("_x").alias("_min"), F.max("_x").alias("_max"),
    )
    # in a small group a bracket may be narrower than one rank: take the whole range there
    small = F.col("_n") <= 2 * accuracy
    probes = []
    for i, (name, p) in enumerate(probs.items()):
        rank = F.lit(p) * (F.col("_n") - 1)
        lo = F.col("_min") if cuts[2 * i] == 0.0 else F.when(small, F.col("_min")).otherwise(F.col("_c")[2 * i])
        hi = F.col("_max") if cuts[2 * i + 1] == 1.0 else F.when(small, F.col("_max")).otherwise(F.col("_c")[2 * i + 1])
        probes += [
            F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), whole.alias("rank"), lo.alias("lo"), hi.alias("hi"), (rank - F.floor(rank)).alias("share"))
            for side, whole in ((0, F.floor(rank)), (1, F.ceil(rank)))
        ]
    # small tables, kept so that no pass runs twice; the planner sees their size
    ensure_checkpoint_dir(df.sparkSession)
    first = sketch.where("_n > 0").select(*keys, "_n", F.explode(F.array(*probes)).alias("t")).checkpoint()
    targets = first.select(*keys, "t.q", "t.side", "t.rank", "t.lo", "t.hi", (F.col("_n") * 5 / accuracy).alias("n"))
    while not targets.where((F.col("n") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
        targets = narrowed(rows, targets, keys).checkpoint()
    # below the bracket only the count matters: those rows collapse to one partial sum
    value = F.when(F.col("_x") >= F.col("t.lo"), F.col("_x"))
    counted = _hits(rows, targets, keys).groupBy(*keys, "t.q", "t.side", "t.rank", value.alias("x")).agg(F.count("*").alias("n"))
    found = _at_rank(counted, keys, F.col("x").asc_nulls_first()).select(*keys, "q", "side", "x")
    shares = first.where("t.side = 0").select(*keys, F.col("t.q").alias("q"), F.lit(2).alias("side"), F.col("t.share").alias("x"))
    at = lambda name, side: F.max(F.when((F.col("q") == name) & (F.col("side") == side), F.col("x")))
    wide = [(at(name, 0) + (at(name, 1) - at(name, 0)) * at(name, 2)).alias(name) for name in probs]
    both = found.unionByName(shares)
    return both.groupBy(*keys).agg(*wide) if keys else both.agg(*wide)
