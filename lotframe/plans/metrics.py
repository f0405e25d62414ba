"""Growth per lot and the metrics report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cagr, initial_value, lenient_date, lenient_number, years_held
from ..operators.series import beta_by_weight, beta_paired, beta_truncated, cagr_of_dated_values


def with_growth(lots: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Adds ``Years Held`` and ``CAGR``; absent input columns give nulls."""
    as_of = F.current_date() if as_of is None else as_of

    def text(field: str) -> Column:
        return F.col(f"`{field}`") if field in lots.columns else F.lit(None).cast("string")

    cost = initial_value(
        lenient_number(text("Total Cost")), lenient_number(text("Quantity")), lenient_number(text("Cost per Unit"))
    )
    acquired = lenient_date(text("Acquisition Date"))
    # Each cell is parsed in a projection of its own, since the growth names the results several times.
    parsed = lots.withColumns({"_cost_": cost, "_value_": lenient_number(text("Value")), "_acquired_": acquired})
    timed = parsed.withColumn("Years Held", years_held(F.col("_acquired_"), as_of))
    rate = cagr(F.col("_cost_"), F.col("_value_"), F.col("`Years Held`"))
    return timed.withColumn("CAGR", rate).drop("_cost_", "_value_", "_acquired_")


def with_beta(lots: DataFrame, portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds one ``Beta`` to every lot, as a scalar subquery."""
    beta = beta_truncated(portfolio, benchmark).agg(F.max("beta"))
    return lots.withColumn("Beta", beta.scalar())


def with_metrics(
    lots: DataFrame,
    settings: dict | None = None,
    portfolio: DataFrame | None = None,
    benchmark: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Metric columns as switched by the ``METRICS`` settings (on by default).

    ``Beta`` is there exactly if both return series are given.
    """
    settings = settings or {}
    if not settings.get("ENABLE", True):
        return lots
    if settings.get("COMPUTE_CAGR_PER_ROW", True):
        lots = with_growth(lots, as_of)
    if portfolio is not None and benchmark is not None:
        lots = with_beta(lots, portfolio, benchmark)
    return lots


def metrics_report(
    spark: SparkSession,
    positions: DataFrame | None = None,
    portfolio: DataFrame | None = None,
    benchmark: DataFrame | None = None,
    values: DataFrame | None = None,
    inputs: dict[str, str] | None = None,
    beta_column: str = "Beta",
    weight_column: str = "Value",
    fixed_growth: tuple[float, float, float] | None = None,
) -> DataFrame:
    """One row: ``metrics``, ``inputs``, ``config`` and ``diagnostics``.

    Beta from return series comes before beta from positions; growth from given
    begin, end and years before growth from dated values. Every input is one
    portfolio, i.e. a single series.
    """
    nothing = F.lit(None).cast("double")
    by_series = by_weight = growth = nothing
    if portfolio is not None and benchmark is not None:
        by_series = beta_paired(portfolio, benchmark, detect_scale=True).agg(F.max("beta")).scalar()
    if positions is not None:
        by_weight = beta_by_weight(positions, (), beta_column, weight_column).scalar()
    if fixed_growth is not None:
        growth = cagr(*[F.lit(float(number)) for number in fixed_growth])
    elif values is not None:
        growth = cagr_of_dated_values(values).agg(F.max("cagr")).scalar()
    found = spark.range(1).select(
        by_series.alias("by_series"), by_weight.alias("by_weight"), growth.alias("cagr")
    )
    return found.select(*_report_columns(inputs, beta_column, weight_column))


def _report_columns(inputs: dict[str, str] | None, beta_column: str, weight_column: str) -> list[Column]:
    """The report's parts from ``by_series``, ``by_weight`` and ``cagr``."""
    method = F.when(F.col("by_series").isNotNull(), "timeseries").when(F.col("by_weight").isNotNull(), "holdings")
    beta = F.coalesce("by_series", "by_weight")
    given = inputs or {}
    # The names of the report's input entries.
    names = ("holdings", "portfolio_returns", "benchmark_returns", "values_csv")
    return [
        F.struct(beta.alias("beta"), method.alias("beta_method"), F.col("cagr")).alias("metrics"),
        F.struct(*[F.lit(given.get(name)).cast("string").alias(name) for name in names]).alias("inputs"),
        F.struct(F.lit(beta_column).alias("BETA_COLUMN"), F.lit(weight_column).alias("BETA_WEIGHT_COLUMN")).alias("config"),
        F.struct((beta.isNotNull() | F.col("cagr").isNotNull()).alias("ok")).alias("diagnostics"),
    ]


def metrics_reports(
    positions: DataFrame | None = None,
    portfolio: DataFrame | None = None,
    benchmark: DataFrame | None = None,
    values: DataFrame | None = None,
    inputs: dict[str, str] | None = None,
    key: str = "series_id",
    beta_column: str = "Beta",
    weight_column: str = "Value",
) -> DataFrame:
    """A row as of :func:`metrics_report` for every portfolio, i.e. every ``key`` of any input.

    Every input has the key as a column. Each metric is one aggregate over its input; their rows, one per
    portfolio, meet in one more shuffle, so any number of portfolios costs what one does per row.
    """
    nothing = F.lit(None).cast("double")

    def part(rows: DataFrame, **known: Column) -> DataFrame:
        values_of = {name: known.get(name, nothing).alias(name) for name in ("by_series", "by_weight", "cagr")}
        return rows.select(F.col(f"`{key}`").cast("string").alias(key), *values_of.values())

    def by_id(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed(key, "series_id")

    parts = []
    if portfolio is not None and benchmark is not None:
        betas = beta_paired(by_id(portfolio), by_id(benchmark), detect_scale=True).withColumnRenamed("series_id", key)
        parts.append(part(betas, by_series=F.col("beta")))
    if positions is not None:
        parts.append(part(beta_by_weight(positions, (key,), beta_column, weight_column), by_weight=F.col("beta")))
    if values is not None:
        parts.append(part(cagr_of_dated_values(by_id(values)).withColumnRenamed("series_id", key), cagr=F.col("cagr")))
    if not parts:
        raise ValueError("a report needs positions, two return series or values")
    metrics = ("by_series", "by_weight", "cagr")
    found = reduce(DataFrame.unionByName, parts).groupBy(key).agg(*[F.max(name).alias(name) for name in metrics])
    return found.select(key, *_report_columns(inputs, beta_column, weight_column))
