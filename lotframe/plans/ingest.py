"""Reports to canonical lots: one plan over all files.

The grid is shuffled once by block. Table, file and carry decisions are taken
on summaries of one row per (block, table) and come back to the rows through a
join on (block, table), whose groups are bounded by the block size. A single
file or table may therefore hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import canonical, classify, clean, headers, keyvalues, realign, segment
from ..operators.prefix import shuffled
from ..sources.mapping import DEFAULT_SYNONYMS, mapping_frame, resolve_mapping
from ..sources.staging import stage


@dataclass(frozen=True)
class Parsed:
    """The stages of one ingest plan."""

    blocked: DataFrame
    tables: DataFrame
    pairs: DataFrame
    files: DataFrame
    routed: DataFrame
    lots: DataFrame
    fallback: DataFrame


def decide(
    blocked: DataFrame, fields: Sequence[str], mapping: dict[str, str], by: Sequence[int | str] = segment.BLOCK
) -> DataFrame:
    """The decisions per (block, table), with its header and its first and last row, as a staged table.

    It is read by the table, file and row steps, so it is written once; rows outside tables are in it under a null
    ``table_row`` and keep every file and block listed. Of a stored grid, so are the tables that are open where blocks
    begin; another grid's are worked out along with the rows, from the same shuffle.
    """
    header = headers.header_facts(mapping, fields)
    opened = stage(segment.open_tables(blocked, header), "open-tables") if tuple(by) != segment.BLOCK else None
    rows = segment.resolve_rows(blocked, header, by, opened)
    return classify.decide_tables(stage(classify.summarise_segments(classify.row_roles(rows)), "segments"))


#: Columns of segments that :func:`rows_with_facts` needs.
PLACE = (*classify.SEGMENT, "first_row", "last_row")


def rows_with_facts(blocked: DataFrame, facts: DataFrame, by: Sequence[int | str] = segment.BLOCK) -> DataFrame:
    """Rows of tables with ``table_row`` and the facts of their (block, table).

    A table's rows in a block follow one another, so its first and last one tell them; they need not be worked out again.
    A block's tables come to its rows as one array; a join by table as well would deal the rows out anew.
    """
    names = [name for name in facts.columns if name not in PLACE]
    of_block = facts.groupBy(*segment.BLOCK).agg(F.collect_list(F.struct("first_row", "last_row", "table_row", *names)).alias("_tables"))
    joined = blocked.join(shuffled(of_block.repartition(*by)), list(segment.BLOCK))
    around = F.filter("_tables", lambda table: F.col("row_no").between(table["first_row"], table["last_row"]))
    found = joined.withColumn("_facts", F.get(around, F.lit(0))).where(F.col("_facts").isNotNull())
    return found.select(*blocked.columns, *[F.col(f"_facts.{name}") for name in ("table_row", *names)])


def parse_reports(
    grid: DataFrame, fields: Sequence[str], synonyms: dict | None = None, stored_by: Sequence[int | str] | None = None
) -> Parsed:
    """All stages from a report grid to uncleaned canonical rows.

    ``stored_by``: number and columns of the buckets that a stored grid is read from, each with whole blocks; else
    rows are shuffled by block.
    """
    synonyms = DEFAULT_SYNONYMS if synonyms is None else synonyms
    mapping = resolve_mapping(grid.sparkSession, synonyms)
    blocked = segment.blocked_as_stored(grid) if stored_by else segment.by_block(grid)
    by = stored_by or segment.BLOCK
    segments = decide(blocked, fields, mapping, by)
    tables = segments.filter(F.col("table_row").isNotNull())

    pairs = keyvalues.key_value_pairs(blocked, mapping_frame(grid.sparkSession, synonyms))
    blocks = segments.select(*segment.BLOCK).distinct()
    files = (
        blocks.select("file")
        .distinct()
        .join(shuffled(classify.decide_files(tables, fields)), "file", "left")
        .join(shuffled(keyvalues.key_value_maps(pairs)), "file", "left")
        .withColumn("is_hybrid", F.coalesce("is_hybrid", F.lit(False)))
        .withColumn("fallback", canonical.fallback_values(fields))
    )

    # File facts meet their file once per block, not once per row or table.
    per_block = blocks.join(shuffled(files.select("file", "is_hybrid", "account_place", "fallback")), "file")
    facts = (
        tables.join(shuffled(per_block), list(segment.BLOCK))
        .withColumn("route", realign.choose_route(fields))
        .filter(F.col("route").isNotNull())
        .select(*PLACE, "header", "route", "fallback", "hybrid_carry", "group_carry")
    )
    routed = realign.carry_symbols(classify.row_roles(rows_with_facts(blocked, facts, by)))
    lots = canonical.project_fields(realign.keep_lots(routed), fields)
    return Parsed(blocked, tables, pairs, files, routed, lots, canonical.fallback_rows(files, fields))


def ingest(
    grid: DataFrame,
    fields: Sequence[str] = canonical.FULL_FIELDS,
    synonyms: dict | None = None,
    keep_place: bool = False,
    observe=None,
    stored_by: Sequence[int | str] | None = None,
) -> DataFrame:
    """Canonical, cleaned and de-duplicated lots of all reports in ``grid``."""
    parsed = parse_reports(grid, fields, synonyms, stored_by)
    place = ("file", "sheet_no", "row_no") if keep_place else ()
    return clean.clean_lots(parsed.lots.unionByName(parsed.fallback), fields, place, observe)
