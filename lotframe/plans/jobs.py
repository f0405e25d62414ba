"""Whole runs: report files in, canonical lots and metrics out."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.numbers import strict_number
from ..operators import canonical, clean
from ..operators.prefix import running_row_number
from ..sources.flat import read_flat
from ..sources.grid import read_grid
from ..sources.manifest import choose_entries, manifest_frame, path_exists
from ..sources.mapping import DEFAULT_SYNONYMS, load_mapping
from ..sources.sinks import run_timestamp, with_previous, write_lots, write_report
from ..sources.staging import discarding_stages, stage
from .ingest import ingest
from .metrics import metrics_report, with_metrics

log = logging.getLogger(__name__)


def read_reports(spark: SparkSession, entries: Iterable[str | dict], on_bad_file: str = "fail") -> DataFrame:
    """Parsed reports as a staged table, so that each file is parsed once."""
    return stage(read_grid(spark, entries, on_bad_file), "grid")


def lots_of_files(
    spark: SparkSession,
    entries: Iterable[str | dict],
    fields: Sequence[str] = canonical.FULL_FIELDS,
    synonyms: dict | None = None,
    keep_order: bool = False,
) -> DataFrame:
    """Canonical lots of the listed reports.

    ``keep_order`` sorts them by their first occurrence, in manifest order.
    """
    entries = list(entries)
    grid = read_reports(spark, entries)
    if not keep_order:
        return ingest(grid, fields, synonyms)
    lots = ingest(grid, fields, synonyms, keep_place=True)
    order = manifest_frame(spark, entries).select("file_no", F.col("path").alias("_path"))
    numbered = lots.join(order, F.col("first_seen.file") == F.col("_path"), "left")
    place = ["file_no", "first_seen.sheet_no", "first_seen.row_no"]
    return numbered.orderBy(*place).select(*map(clean.quoted, fields))


def _place() -> Column:
    """Order of a row in its file: file splits in order, then scan order within a split."""
    within = F.monotonically_increasing_id().alias("row")
    return F.struct("_metadata.file_path", "_metadata.file_block_start", within).alias("place")


def return_series(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """``returns(series_id, pos, r)`` of one file: the named, else the first column.

    ``pos`` follows file order: splits of one file are numbered in order and rows
    within a split by the scan.
    """
    raw = read_flat(spark, path)
    name = column if column in raw.columns else raw.columns[0]
    number = strict_number(F.col(f"`{name}`"))
    if column is not None and name != column:
        # The first column stands in as it is: one bad value makes the beta undefined.
        number = F.coalesce(number, F.lit(float("nan")))
    return _numbered(raw.select(_place(), number.alias("r")))


def value_series(spark: SparkSession, path: str, date_column: str = "Date", value_column: str = "Value") -> DataFrame:
    """``values(series_id, pos, date, value)`` of one file, as text."""
    raw = read_flat(spark, path)
    missing = {date_column, value_column} - set(raw.columns)
    if missing:
        raise KeyError(f"no column {sorted(missing)} in {path}")
    rows = raw.select(
        _place(), F.col(f"`{date_column}`").alias("date"), F.col(f"`{value_column}`").alias("value")
    )
    return _numbered(rows)


def _numbered(rows: DataFrame) -> DataFrame:
    """Positions from 0 in ``place`` order, counted per file split."""
    keyed = stage(
        rows.select(
            F.lit(0).cast("long").alias("series_id"),
            F.struct("place.file_path", "place.file_block_start").alias("split"),
            "*",
        ),
        "series",
    )
    numbered = running_row_number(keyed, ["series_id"], "split", ["place"], "pos")
    return numbered.withColumn("pos", F.col("pos") - 1).drop("split", "place")


def configured_synonyms(spark: SparkSession, settings: dict) -> dict:
    """The mapping file of the settings, else the default; an unreadable file gives an empty mapping."""
    path = settings.get("COLUMN_MAPPING") or settings.get("COLUMN_MAPPING_CONFIG")
    return load_mapping(spark, path) if path else DEFAULT_SYNONYMS


def run(
    spark: SparkSession,
    settings: dict,
    files: Iterable[str] | None = None,
    synonyms: dict | None = None,
    timestamp: str | None = None,
    append: bool = False,
    as_of: Column | None = None,
) -> str:
    """Reports of the settings, or the named files, to one output; returns its path.

    Metrics follow in the same plan, the output is written once.
    """
    fields = canonical.parse_fields(settings.get("OUTPUT_FIELDS"))
    entries = choose_entries(files, settings)
    folder = settings.get("OUTPUT_DIR") or "./out"
    stamp = timestamp or run_timestamp()
    config = settings.get("METRICS") or {}
    returns = config.get("RETURNS") or {}
    given = [returns.get(name) for name in ("PORTFOLIO_FILE", "BENCHMARK_FILE")]
    with discarding_stages(spark):
        if synonyms is None:
            synonyms = configured_synonyms(spark, settings)
        lots = lots_of_files(spark, entries, fields, synonyms, keep_order=not append)
        if append:
            lots = with_previous(lots, folder, stamp, fields)
        portfolio = benchmark = None
        if all(path and path_exists(spark, path) for path in given):
            column = returns.get("COLUMN", "return")
            portfolio, benchmark = (return_series(spark, path, column) for path in given)
        return write_lots(with_metrics(lots, config, portfolio, benchmark, as_of), folder, stamp)


def report(
    spark: SparkSession,
    folder: str,
    holdings: str | None = None,
    portfolio_returns: str | None = None,
    benchmark_returns: str | None = None,
    values_csv: str | None = None,
    date_column: str = "Date",
    value_column: str = "Value",
    beta_column: str = "Beta",
    weight_column: str = "Value",
    fixed_growth: tuple[float, float, float] | None = None,
    timestamp: str | None = None,
) -> dict[str, str]:
    """The metrics report of the given files as JSON and CSV; returns their paths.

    A file that is missing or lacks its columns leaves its metric null. Return
    files count by their first column.
    """
    given = {
        "holdings": holdings,
        "portfolio_returns": portfolio_returns,
        "benchmark_returns": benchmark_returns,
        "values_csv": values_csv,
    }
    present = {name: path for name, path in given.items() if path and path_exists(spark, path)}
    stamp = timestamp or run_timestamp()
    with discarding_stages(spark):
        portfolio = benchmark = values = None
        if {"portfolio_returns", "benchmark_returns"} <= present.keys():
            portfolio = return_series(spark, present["portfolio_returns"])
            benchmark = return_series(spark, present["benchmark_returns"])
        if "values_csv" in present:
            try:
                values = value_series(spark, present["values_csv"], date_column, value_column)
            except KeyError as error:
                log.warning("no growth from values: %s", error)
        positions = read_flat(spark, present["holdings"]) if "holdings" in present else None
        found = metrics_report(
            spark,
            positions,
            portfolio,
            benchmark,
            values,
            {name: path for name, path in given.items() if path},
            beta_column,
            weight_column,
            fixed_growth,
        )
        return write_report(found.select(F.lit(stamp).alias("timestamp"), "*"), folder, stamp)


def clean_with_counts(lots: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, dict[str, Observation]]:
    """Cleaned lots and the observations of rows in, non-empty rows and lots out.

    The counts arrive with the first action, without another pass.
    """
    counts = {name: Observation(name) for name in ("rows_in", "rows_kept", "lots_out")}
    return clean.clean_lots(lots, fields, observe=tuple(counts.values())), counts
