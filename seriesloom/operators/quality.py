"""Data-quality reports and anomaly flags."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import score_severity, sigma_severity
from ..functions.text import thousands_text
from ..spec import DEFAULT, PanelSpec
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class Rule:
    """Allowed range of an indicator."""

    indicator: str
    low: float
    high: float
    critical: bool = False


# fixed values: the default range rules of the macro table
DEFAULT_RULES = (
    Rule("Pertumbuhan_Ekonomi", -15.0, 15.0, True),
    Rule("Inflasi", -5.0, 30.0, True),
    Rule("Kurs_USD", 8000.0, 25000.0, True),
    Rule("IHSG", 1000.0, 15000.0),
    Rule("Harga_Minyak_ICP", 10.0, 200.0),
    Rule("Harga_Batubara", 20.0, 600.0),
    Rule("Harga_CPO", 200.0, 3000.0),
    Rule("SBN_10Y", 1.0, 20.0, True),
    Rule("BI_Rate", 2.0, 15.0, True),
    Rule("Lifting_Minyak", 300.0, 1200.0),
    Rule("Lifting_Gas", 500.0, 2000.0),
    Rule("PMI_Manufaktur", 20.0, 80.0),
    Rule("Ekspor_Growth", -50.0, 100.0),
    Rule("Impor_Growth", -50.0, 100.0),
    Rule("Konsumsi_RT_Growth", -20.0, 20.0, True),
)


def _total(cols: Iterable[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for c in cols:
        out = out + c
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls over all columns, number of cells, share in percent. One pass, no shuffle of rows."""
    missing = _total(F.count_if(F.col(c).isNull()) for c in df.columns)
    cells = F.count("*") * len(df.columns)
    return df.agg(missing.alias("missing"), cells.alias("cells")).withColumn(
        "missing_pct", F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("cells")), F.lit(0.0))
    )


def completeness(df: DataFrame, ds: str = "ds") -> DataFrame:
    """Missing cells per (column, period) as rows, the input of a completeness chart."""
    cols = [c for c in df.columns if c != ds]
    flags = df.select(ds, *[F.col(c).isNull().cast("bigint").alias(c) for c in cols])
    return flags.unpivot([ds], cols, "column", "missing").groupBy("column", ds).agg(F.sum("missing").alias("missing"))


def indicator_report(df: DataFrame, as_of: Column, rules: Sequence[Rule] = DEFAULT_RULES, ds: str = "ds") -> DataFrame:
    """Score 0-100 of an indicator table: missing cells, range breaches, staleness; one aggregation pass."""
    have = set(df.columns)
    checks = [(r, kind, F.count_if(F.col(r.indicator) < r.low) if kind == "below" else F.count_if(F.col(r.indicator) > r.high))
              for r in rules if r.indicator in have for kind in ("below", "above")]
    missing = _total(F.count_if(F.col(c).isNull()) for c in df.columns)
    one = df.agg(
        F.count("*").alias("rows"),
        missing.alias("missing_count"),
        F.max(ds).alias("last_ds"),
        *[c.alias(f"_c{i}") for i, (_, _, c) in enumerate(checks)],
    )
    cells = F.col("rows") * len(df.columns)
    out = one.withColumn("outlier_count", _total(F.col(f"_c{i}") for i in range(len(checks)))).withColumns(
        {
            "missing_pct": F.coalesce(F.try_divide(F.col("missing_count") * 100.0, cells), F.lit(0.0)),
            "outlier_pct": F.coalesce(F.try_divide(F.col("outlier_count") * 100.0, cells), F.lit(0.0)),
            "days_old": F.datediff(as_of, "last_ds").cast("bigint"),
        }
    )
    stale = F.when(F.col("days_old") > 90, 20.0).when(F.col("days_old") > 35, 5.0).otherwise(0.0)
    score = 100.0 - F.least(F.col("missing_pct") * 2, F.lit(40.0)) - F.least(F.col("outlier_pct") * 5, F.lit(40.0)) - stale
    issues = F.filter(
        F.array(
            F.when(F.col("missing_count") > 0, F.format_string("%d missing values", "missing_count")),
            *[
                F.when(F.col(f"_c{i}") > 0, F.format_string(f"{r.indicator}: %d values {kind} {r.low if kind == 'below' else r.high}", f"_c{i}"))
                for i, (r, kind, _) in enumerate(checks)
            ],
            F.when(F.col("days_old") > 90, F.format_string("stale: last period %d days ago", "days_old"))
            .when(F.col("days_old") > 35, F.format_string("slightly old: last period %d days ago", "days_old")),
        ),
        lambda x: x.isNotNull(),
    )
    empty = F.col("rows") == 0
    final = F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(score, 1)))
    return out.withColumns({"score": final, "issues": F.when(empty, F.array(F.lit("table is empty"))).otherwise(issues)}).select(
        F.when(empty, "ERROR").when(F.col("score") < 50, "CRITICAL").when(F.col("score") < 80, "WARNING").otherwise("OK").alias("status"),
        "score", "missing_count", "outlier_count", "days_old", "issues",
    )


def indicator_state(long: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, ds: str = "ds") -> DataFrame:
    """(indicator, rows, missing, outliers, last_ds) of rows (indicator, ds, value); states of parts of a table can be merged."""
    v, name = F.col("value"), F.col("indicator")
    out = F.lit(False)
    for r in rules:
        out = out | ((name == r.indicator) & ((v < r.low) | (v > r.high)))
    return long.groupBy("indicator").agg(
        F.count("*").alias("rows"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.coalesce(out, F.lit(False))).alias("outliers"), F.max(ds).alias("last_ds")
    )


def merge_states(*states: DataFrame) -> DataFrame:
    both = states[0]
    for more in states[1:]:
        both = both.unionByName(more)
    return both.groupBy("indicator").agg(*[F.sum(c).alias(c) for c in ("rows", "missing", "outliers")], F.max("last_ds").alias("last_ds"))


def state_score(state: DataFrame, as_of: Column) -> DataFrame:
    """One row: status, score 0-100, missing and outlying cells, and days since the last period, by the rules of `indicator_report`."""
    one = state.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "missing", "outliers")], F.datediff(as_of, F.max("last_ds")).cast("bigint").alias("days_old"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, "rows"), F.lit(0.0))
    stale = F.when(F.col("days_old") > 90, 20.0).when(F.col("days_old") > 35, 5.0).otherwise(0.0)
    score = 100.0 - F.least(share("missing") * 2, F.lit(40.0)) - F.least(share("outliers") * 5, F.lit(40.0)) - stale
    empty = F.col("rows") == 0
    scored = one.withColumn("score", F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(score, 1))))
    status = F.when(empty, "ERROR").when(F.col("score") < 50, "CRITICAL").when(F.col("score") < 80, "WARNING").otherwise("OK")
    return scored.select(status.alias("status"), "score", "rows", "missing", "outliers", "days_old")


def history_report(df: DataFrame, as_of: Column, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Score 0-100 of a history table: missing cells and values that are not positive."""
    missing = _total(F.count_if(F.col(c).isNull()) for c in df.columns)
    one = df.agg(
        F.count("*").alias("rows"), missing.alias("missing_count"),
        F.count_if(spec.value <= 0).alias("outlier_count"), F.max(spec.ds).alias("last_ds"),
    ).withColumns(
        {
            "_m": F.coalesce(F.try_divide(F.col("missing_count") * 100.0, F.col("rows") * len(df.columns)), F.lit(0.0)),
            "_o": F.coalesce(F.try_divide(F.col("outlier_count") * 100.0, "rows"), F.lit(0.0)),
            "days_old": F.datediff(as_of, "last_ds").cast("bigint"),
        }
    )
    empty = F.col("rows") == 0
    score = F.greatest(F.lit(0.0), F.round(100.0 - F.least(F.col("_m") * 3, F.lit(40.0)) - F.least(F.col("_o"), F.lit(40.0)), 1))
    issues = F.filter(
        F.array(
            F.when(F.col("missing_count") > 0, F.format_string("%d missing cells", "missing_count")),
            F.when(F.col("outlier_count") > 0, F.format_string("%d values are zero or negative", "outlier_count")),
            F.when(F.col("days_old") > 45, F.lit("history may be outdated")),
        ),
        lambda x: x.isNotNull(),
    )
    return one.withColumns({"score": F.when(empty, 0.0).otherwise(score), "issues": issues}).select(
        F.when(empty, "ERROR").when(F.col("score") < 40, "CRITICAL").when(F.col("score") < 60, "WARNING").otherwise("OK").alias("status"),
        "score", "missing_count", "outlier_count", "days_old", "issues",
    )


def not_positive(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows whose value is zero or negative, with the issue and the suggested minimum."""
    return df.filter(spec.value <= 0).withColumns(
        {"issue": F.lit("value is not positive"), "suggested_min": F.lit(0.01)}
    )


def anomaly_z(df: DataFrame, threshold: float = 3.0, spec: PanelSpec = DEFAULT) -> DataFrame:
    w = spec.whole()
    std = F.stddev_samp(spec.y).over(w)
    z = F.when(std > 0, (spec.value - F.avg(spec.y).over(w)) / std)
    return df.withColumn("z", z).withColumn("is_z", F.coalesce(F.abs("z") > threshold, F.lit(False)))


def anomaly_iqr(df: DataFrame, k: float = 1.5, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Outside the quartile fences of the own series (series are bounded by the calendar)."""
    w = spec.whole()
    q = F.percentile(spec.y, [0.25, 0.75]).over(w)
    d = df.withColumn("_q", q)
    iqr = F.col("_q")[1] - F.col("_q")[0]
    out = (spec.value < F.col("_q")[0] - k * iqr) | (spec.value > F.col("_q")[1] + k * iqr)
    return d.withColumn("is_iqr", F.coalesce(out, F.lit(False))).drop("_q")


def iqr_outliers(df: DataFrame, by: Sequence[str], col: str, k: float = 1.5) -> DataFrame:
    """Fence outliers of raw rows in groups of any size: exact quantiles, then a join on the key."""
    q = exact_quantiles(df, by, col, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    fences = q.select(*by, (F.col("q1") - k * spread).alias("fence_lo"), (F.col("q3") + k * spread).alias("fence_hi"))
    return df.join(fences, list(by)).filter((F.col(col) < F.col("fence_lo")) | (F.col(col) > F.col("fence_hi")))


def vote(df: DataFrame, flags: Sequence[str], needed: int = 2, count_ensemble: bool = True) -> DataFrame:
    """Ensemble flag, score = votes / methods and severity.

    With `count_ensemble` the ensemble flag itself counts as one more method.
    """
    votes = F.lit(0).cast("bigint")
    for f in flags:
        votes = votes + F.col(f).cast("bigint")
    out = df.withColumn("votes", votes).withColumn("is_anomaly", F.col("votes") >= needed)
    if count_ensemble:
        score = (F.col("votes") + F.col("is_anomaly").cast("bigint")) / (len(flags) + 1)
    else:
        score = F.col("votes") / len(flags)
    return out.withColumn("score", score).withColumn("severity", score_severity(F.col("score")))


def decimals(value: Column, digits: int) -> Column:
    """A number that is not negative as text with a fixed number of decimals, halves up."""
    scaled = F.floor(value * 10**digits + 0.5).cast("bigint")
    whole, rest = F.floor(scaled / 10**digits).cast("bigint"), F.pmod(scaled, F.lit(10**digits))
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))


def explain(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Distance from the series mean in sigmas and percent, direction, severity and a sentence for every row."""
    w = spec.whole()
    d = df.withColumns({"_m": F.avg(spec.y).over(w), "_s": F.stddev_samp(spec.y).over(w)})
    off = F.abs(spec.value - F.col("_m"))
    d = d.withColumns(
        {
            "sigmas": F.when(F.col("_s") > 0, off / F.col("_s")).otherwise(0.0),
            "pct_off": F.when(F.col("_m") != 0, F.abs((spec.value - F.col("_m")) / F.col("_m") * 100)).otherwise(0.0),
            "direction": F.when(spec.value > F.col("_m"), "above").otherwise("below"),
        }
    ).withColumn("severity", sigma_severity(F.col("sigmas")))
    whole = lambda c: thousands_text(F.floor(c + 0.5))
    text = F.concat(
        decimals(F.col("sigmas"), 2), F.lit(" standard deviations "), F.col("direction"), F.lit(" average: value "), whole(spec.value), F.lit(", average "),
        whole(F.col("_m")), F.lit(", off by "), decimals(F.col("pct_off"), 1), F.lit("%, severity "), F.col("severity"),
        F.lit("; a data entry error, a special event, a seasonal effect or a change of policy may be behind it"),
    )
    return d.withColumn("explanation", text).drop("_m", "_s")


def review_advice(count: Column) -> Column:
    return (
        F.when(count == 0, F.array(F.lit("no anomalies, quality looks good")))
        .when(count <= 3, F.array(F.lit("few anomalies, review them by hand"), F.lit("look for events in those periods")))
        .otherwise(
            F.array(
                F.lit("many anomalies, quality may be poor"), F.lit("verify the source"), F.lit("check entry errors"),
                F.lit("remove outliers or use robust models"), F.lit("look for external causes"),
            )
        )
    )


def structure_problems(df: DataFrame, required: Sequence[str], min_rows: int = 12) -> list[str]:
    """Missing required columns and too few rows; reads at most `min_rows` rows."""
    problems = [f"missing column {c}" for c in required if c not in df.columns]
    if df.limit(min_rows).count() < min_rows:
        problems.append(f"fewer than {min_rows} rows")
    return problems
