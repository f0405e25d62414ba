"""Return and value series: alignment, beta, growth.

Series columns: ``series_id``, ``pos`` (0-based place in the file) and ``r`` or
``value``. A series may be longer than one task can hold: alignment joins on
(series, position) and everything else is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import lenient_date, years_between
from ..functions.growth import cagr
from ..functions.numbers import strict_number
from .prefix import attach_by_key, running_row_number

KEY = ["series_id", "pos"]

# Mean absolute return above which a series is in percent, and the
# variance of paired series that counts as none.
PERCENT_ABOVE = 1.0
NO_VARIANCE = 1e-18

POSITIONS_PER_BLOCK = 65_536


def _percent_factor(mean_abs: Column) -> Column:
    return F.when(mean_abs > PERCENT_ABOVE, 0.01).otherwise(1.0)


def scale_returns(returns: DataFrame) -> DataFrame:
    """Percent series become decimals; one decision per series."""
    means = returns.groupBy("series_id").agg(F.avg(F.abs("r")).alias("mean_abs"))
    with_mean = attach_by_key(returns, means, ["series_id"], F.col("pos"))
    scaled = F.when(F.col("mean_abs") > PERCENT_ABOVE, F.col("r") / 100).otherwise(F.col("r"))
    return with_mean.select("series_id", "pos", scaled.alias("r"))


def _sides(portfolio: DataFrame, benchmark: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    p = portfolio.select(*keys, F.col("r").alias("p"), F.lit(True).alias("in_p"))
    b = benchmark.select(*keys, F.col("r").alias("b"), F.lit(True).alias("in_b"))
    return p.join(b, list(keys), how)


def _beta(covariance: Column, variance: Column, floor: float) -> Column:
    return F.when(variance > floor, F.try_divide(covariance, variance))


def _variation(ddof: int) -> tuple[Column, Column]:
    """Covariance with, and variance of, ``b`` over complete pairs."""
    paired_b = F.when(F.col("p").isNotNull(), F.col("b"))
    n = F.count(F.when(paired_b.isNotNull(), 1))
    rescale = F.try_divide(n.cast("double"), (n - ddof).cast("double"))
    if ddof == 1:
        return F.covar_samp("p", "b"), F.var_samp(paired_b)
    return F.covar_pop("p", "b") * rescale, F.var_pop(paired_b) * rescale


def beta_paired(portfolio: DataFrame, benchmark: DataFrame, ddof: int = 1, detect_scale: bool = False) -> DataFrame:
    """Beta over positions where both series have a value.

    With ``detect_scale`` each series is first taken from percent to decimals.
    Scaling a series scales its moments, so one aggregation serves both; the
    means run over whole series, hence the full join.
    """
    sides = _sides(portfolio, benchmark, KEY, "full" if detect_scale else "inner")
    covariance, variance = _variation(ddof)
    pairs = F.count(F.when(F.col("p").isNotNull() & F.col("b").isNotNull(), 1))
    moments = sides.groupBy("series_id").agg(
        pairs.alias("n"),
        covariance.alias("cov"),
        variance.alias("var"),
        F.avg(F.abs("p")).alias("mean_p"),
        F.avg(F.abs("b")).alias("mean_b"),
    )
    scale_p = _percent_factor(F.col("mean_p")) if detect_scale else F.lit(1.0)
    scale_b = _percent_factor(F.col("mean_b")) if detect_scale else F.lit(1.0)
    beta = _beta(F.col("cov") * scale_p * scale_b, F.col("var") * scale_b * scale_b, NO_VARIANCE)
    return moments.select("series_id", "n", F.when(F.col("n") >= 2, beta).alias("beta"))


def beta_strict(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta of series of equal length without gaps, null otherwise."""
    sides = _sides(portfolio, benchmark, KEY, "full")
    covariance, variance = _variation(1)
    moments = sides.groupBy("series_id").agg(
        F.count("in_p").alias("n_p"),
        F.count("in_b").alias("n_b"),
        F.count(F.when(F.col("p").isNotNull() & F.col("b").isNotNull(), 1)).alias("n"),
        covariance.alias("cov"),
        variance.alias("var"),
    )
    whole = (F.col("n_p") == F.col("n_b")) & (F.col("n") == F.col("n_p")) & (F.col("n") >= 2)
    beta = F.when(whole, _beta(F.col("cov"), F.col("var"), 0.0))
    return moments.select("series_id", "n_p", "n_b", beta.alias("beta"))


def _compact(returns: DataFrame) -> DataFrame:
    """Positions counted anew over the rows that have a value."""
    present = returns.filter(F.col("r").isNotNull()).withColumn("_block", F.floor(F.col("pos") / POSITIONS_PER_BLOCK))
    return running_row_number(present, ["series_id"], "_block", ["pos"], "rank").drop("_block")


def beta_truncated(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta after each series dropped its own nulls, up to the shorter length.

    A null in one series moves its later values against the other series.
    """
    sides = _sides(_compact(portfolio), _compact(benchmark), ["series_id", "rank"], "inner")
    covariance, variance = _variation(1)
    moments = sides.groupBy("series_id").agg(
        F.count("*").alias("n"), covariance.alias("cov"), variance.alias("var")
    )
    beta = F.when(F.col("n") >= 2, _beta(F.col("cov"), F.col("var"), 0.0))
    # A NaN among the aligned values leaves the beta undefined.
    return moments.select("series_id", "n", F.when(~F.isnan(beta), beta).alias("beta"))


def beta_by_weight(
    positions: DataFrame,
    by: Sequence[str] = (),
    beta_column: str = "Beta",
    weight_column: str = "Value",
) -> DataFrame:
    """Weighted mean of position betas over rows with a beta and a positive weight.

    Falls back to a ``Weight`` column; without a usable column the result is null.
    """
    columns = positions.columns
    weight_column = weight_column if weight_column in columns else "Weight"
    if beta_column not in columns or weight_column not in columns:
        groups = positions.select(*by).distinct() if by else positions.sparkSession.range(1).select()
        return groups.select("*", F.lit(None).cast("double").alias("beta"))
    return _weighted(positions, by, beta_column, weight_column).select(*by, F.try_divide("_product", "_weight").alias("beta"))


def _weighted(positions: DataFrame, by: Sequence[str], beta_column: str, weight_column: str) -> DataFrame:
    """Sums of weights and of weighted betas over the usable rows, per group."""
    numbers = positions.select(
        *by, strict_number(F.col(f"`{beta_column}`")).alias("_b"), strict_number(F.col(f"`{weight_column}`")).alias("_w")
    )
    usable = (F.col("_w") > 0) & F.col("_b").isNotNull()
    weight, product = F.when(usable, F.col("_w")), F.when(usable, F.col("_w") * F.col("_b"))
    return numbers.groupBy(*by).agg(F.sum(weight).alias("_weight"), F.sum(product).alias("_product"))


def beta_by_levels(
    positions: DataFrame, by: Sequence[str], beta_column: str = "Beta", weight_column: str = "Value"
) -> DataFrame:
    """:func:`beta_by_weight` of every group and of every level above, in one pass over the positions.

    A level above has nulls for the keys that it leaves out; ``level`` counts those. Upper levels are rolled
    up from the sums of the groups, so each position is read and parsed once.
    """
    sums = _weighted(positions, by, beta_column, weight_column)
    rolled = sums.rollup(*by).agg(
        F.sum("_weight").alias("_weight"), F.sum("_product").alias("_product"), F.bit_count(F.grouping_id()).alias("level")
    )
    return rolled.select(*by, "level", F.try_divide("_product", "_weight").alias("beta"))


def cagr_of_series(values: DataFrame, periods_per_year: float) -> DataFrame:
    """Growth from the first to the last value at regular steps."""
    ends = values.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.min_by("value", "pos").alias("first"),
        F.max_by("value", "pos").alias("last"),
    )
    usable = (F.col("n") >= 2) & F.lit(periods_per_year > 0)
    years = (F.col("n") - 1) / F.lit(float(periods_per_year or 1))
    return ends.select("series_id", "n", F.when(usable, cagr(F.col("first"), F.col("last"), years)).alias("cagr"))


def cagr_of_dated_values(values: DataFrame, date_column: str = "date", value_column: str = "value") -> DataFrame:
    """Growth between the first and last complete row in file order.

    Years come from the two dates; if those do not advance, each row counts as a
    month. Dates and values are text or typed and read on the end rows only.
    """
    entry = F.struct(F.col(date_column).alias("date"), F.col(value_column).alias("value"))
    ends = (
        values.na.drop(subset=[date_column, value_column])
        .groupBy("series_id")
        .agg(F.count("*").alias("n"), F.min_by(entry, "pos").alias("first"), F.max_by(entry, "pos").alias("last"))
    )
    # Parsed in a projection of their own, since years and growth name them several times.
    parsed = ends.select(
        "series_id",
        "n",
        lenient_date(F.col("first.date")).alias("_begin"),
        lenient_date(F.col("last.date")).alias("_end"),
        strict_number(F.col("first.value")).alias("_from"),
        strict_number(F.col("last.value")).alias("_to"),
    )
    years = F.coalesce(years_between(F.col("_begin"), F.col("_end")), F.col("n") / 12)
    timed = parsed.withColumn("years", years)
    return timed.select("series_id", "n", "years", cagr(F.col("_from"), F.col("_to"), F.col("years")).alias("cagr"))
