"""Insight rows and headline signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any

# fixed values: words that mark a headline as risk or opportunity
RISK_WORDS = ("deficit", "slowdown", "recession", "turun", "anjlok", "defisit", "inflation")
OPPORTUNITY_WORDS = ("surplus", "growth", "naik", "tumbuh", "windfall", "profit")

# fixed values: thresholds on the latest indicator levels (indicator, side, limit, kind, message)
LEVEL_RULES = (
    ("Harga_Minyak_ICP", "above", 85.0, "opportunity", "high oil price"),
    ("Harga_Minyak_ICP", "below", 60.0, "risk", "low oil price"),
    ("Kurs_USD", "above", 16000.0, "opportunity", "weak currency lifts nominal trade revenue"),
    ("Kurs_USD", "above", 16000.0, "risk", "weak currency may shrink imports"),
    ("Inflasi", "above", 4.5, "risk", "high inflation weakens purchasing power"),
    ("Harga_Emas", "above", 2100.0, "opportunity", "gold rally supports mining"),
)

PER_SOURCE = 3
MAX_ITEMS = 140


def round_robin(items: DataFrame, order: Sequence[Column | str], source: str = "source", per_source: int = PER_SOURCE, limit: int | None = MAX_ITEMS) -> DataFrame:
    """First items of every source, taken in turns, with an overall limit.

    The rank filter is pushed below the shuffle by Spark (a window group limit), so a source with a
    third of all items sends only its first few per task.
    """
    w = Window.partitionBy(source).orderBy(*order)
    ranked = items.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= per_source)
    turns = ranked.orderBy("rank", source)
    return turns if limit is None else turns.limit(limit)


def by_category(items: DataFrame, category: str, name: str, default: str, first: int = 30) -> DataFrame:
    """First items of one category in feed order; a missing category counts as `default`."""
    picked = items.filter(F.coalesce(F.col(category), F.lit(default)).contains(name))
    return picked.orderBy("rank", "source").limit(first).orderBy("source", "rank")


def headline_signals(items: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return items.withColumns({"is_risk": contains_any(t, RISK_WORDS), "is_opportunity": contains_any(t, OPPORTUNITY_WORDS)})


def level_insights(levels: DataFrame, rules: DataFrame) -> DataFrame:
    """Messages of the rules (indicator, side, lim, kind, message) that the latest levels trigger."""
    hit = F.when(F.col("side") == "above", F.col("level") > F.col("lim")).otherwise(F.col("level") < F.col("lim"))
    return levels.join(rules, "indicator").filter(hit).select(
        "kind", F.concat("message", F.lit(" ("), "indicator", F.lit(")")).alias("message")
    )


def summary_insights(totals_by_period: DataFrame, ds: str = "ds", col: str = "total") -> DataFrame:
    """Total, run rate and peak month as rows."""
    best = F.max_by(F.col(ds), F.struct(F.col(col), -F.datediff(F.col(ds), F.lit("1970-01-01").cast("date"))))
    one = totals_by_period.agg(F.sum(col).alias("t"), F.avg(col).alias("m"), best.alias("p"), F.max(col).alias("v"))
    return one.select(
        F.explode(
            F.array(
                F.concat(F.lit("projected total "), F.format_number("t", 0), F.lit(", run rate "), F.format_number("m", 0), F.lit(" a month")),
                F.concat(F.lit("peak in "), F.date_format("p", "MMMM yyyy"), F.lit(" with "), F.format_number("v", 0)),
            )
        ).alias("message")
    ).select(F.lit("summary").alias("kind"), "message")


def headline_insights(first_items: DataFrame, text: str = "text") -> DataFrame:
    """One risk and one opportunity row when any of the given headlines carries such a word."""
    s = headline_signals(first_items, text).agg(F.max("is_risk").alias("r"), F.max("is_opportunity").alias("o"))
    rows = F.array(
        F.when(F.col("r"), F.struct(F.lit("risk").alias("kind"), F.lit("headlines are cautious").alias("message"))),
        F.when(F.col("o"), F.struct(F.lit("opportunity").alias("kind"), F.lit("headlines point to growth").alias("message"))),
    )
    return s.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("i")).select("i.kind", "i.message")
