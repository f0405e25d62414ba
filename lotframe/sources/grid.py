"""Report files as a grid of text cells.

``grid(file, sheet_no, sheet, block, row_no, cells)`` is the only place where
Python sees data. Everything after it is expressed on columns. Files are read by
the data source of ``report_source``, whatever their size.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .cells import ZIP_MAGIC, text_rows, workbook_rows
from .inputs import is_reachable
from .manifest import existing_files, literal, path_length, united_entries
from .report_source import BLOCK_ROWS, GRID_SCHEMA, SPLIT_BYTES, batched, grid_of_files

log = logging.getLogger(__name__)


def _sheets(content: bytes, tabs: list[str] | None) -> Iterator[tuple[int, str | None, list[str]]]:
    """Rows of one file; whatever is not a readable workbook is read as text."""
    if content[:4] == ZIP_MAGIC:
        try:
            sheets = workbook_rows(content, tabs)
        except Exception as error:  # a broken workbook must not fail the job
            log.warning("workbook read as text: %s", error)
        else:
            yield from sheets
            return
    for cells in text_rows(content):
        yield 0, None, cells


def _file_rows(file: str, content: bytes, tabs: list[str] | None, block_rows: int) -> Iterator[tuple]:
    row_no, current = 0, None
    for sheet_no, sheet, cells in _sheets(content, tabs):
        row_no = row_no + 1 if sheet_no == current else 0
        current = sheet_no
        yield file, sheet_no, sheet, row_no // block_rows, row_no, cells
    if current is None:
        # A file without rows stays visible as one blank row.
        yield file, 0, None, 0, 0, []


def parse_files(files: DataFrame, tabs_by_path: dict[str, list[str]] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Grid of a binary-file frame with ``path`` and ``content``.

    ``tabs_by_path`` reaches the reader, so unselected sheets are not parsed.
    """
    tabs_by_path = tabs_by_path or {}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(batch["path"].to_pylist(), batch["content"])
            yield from batched(
                row for path, content in files for row in _file_rows(path, content.as_py(), tabs_by_path.get(path), block_rows)
            )

    return files.select("path", "content").mapInArrow(parse, GRID_SCHEMA)


def read_grid(
    spark: SparkSession,
    entries: Iterable[str | dict],
    on_bad_file: str = "fail",
    block_rows: int = BLOCK_ROWS,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Grid of the listed reports; missing files are skipped with a warning.

    Files are read by byte ranges of ``split_bytes``; their lengths are asked for in tasks.
    Those in stores that only Spark can read are read whole.
    """
    united = united_entries(spark, entries, on_bad_file)
    near = {path: tabs for path, tabs in united.items() if is_reachable(path)}
    far = {path: tabs for path, tabs in united.items() if path not in near}
    parts = []
    if near or not far:
        parts.append(grid_of_files(existing_files(spark, near), split_bytes, block_rows))
    if far:
        lengths = {path: path_length(spark, path) for path in far}
        found = [path for path, length in lengths.items() if length]
        # File scans leave empty files out, but such a file still counts as a report.
        empty = [(path, 0, None, 0, 0, []) for path, length in lengths.items() if length == 0]
        parts.append(spark.createDataFrame(empty, GRID_SCHEMA))
        if found:
            selected = {path: far[path] for path in found if far[path]}
            parts.append(parse_files(spark.read.format("binaryFile").load(list(map(literal, found))), selected, block_rows))
    return reduce(DataFrame.unionByName, parts)


def read_listed(files: DataFrame, block_rows: int = BLOCK_ROWS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Grid of a binary-file frame: by byte ranges, without its ``content``, if tasks can read all its paths."""
    stores = files.select(F.regexp_extract("path", "^[^:]*:(//[^/]*/)?", 0).alias("store")).distinct().collect()
    if all(is_reachable(row["store"]) for row in stores):
        whole = F.lit(None).cast("array<string>").alias("tabs")
        return grid_of_files(files.select("path", "length", whole), split_bytes, block_rows)
    return parse_files(files, None, block_rows)


def read_folder(
    spark: SparkSession, folder: str, glob: str = "*", block_rows: int = BLOCK_ROWS, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Grid of all reports below a folder, listed by Spark and not by the caller."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
    )
    return read_listed(files, block_rows, split_bytes)


def select_sheets(grid: DataFrame, tabs: Sequence[str] | None) -> DataFrame:
    """Rows of the named sheets; unknown names match nothing, no names match all."""
    return grid.filter(F.col("sheet").isin(*tabs)) if tabs else grid
