"""Report-like inputs that Spark derives from the given tables.

Every lineitem is a lot. Each supplier is a broker whose report lists its lots
in one of three layouts, by ``suppkey % 3``: flat, hybrid, symbol-grouped.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.clean import lot_key
from ..operators.segment import BLOCK
from ..session import keep_methods_small
from ..sources.inputs import file_system
from ..sources.manifest import qualified
from ..sources.sinks import write_lots
from ..sources.staging import new_folder, stage, stage_bucketed

AS_OF = "2002-01-01"

# Orders per block of a report. A block of one report never holds more lots than
# these orders have, however large the report is.
ORDERS_PER_BLOCK = 1_048_576
_BLOCK_SPAN = 1 << 32

FLAT_HEADER = [
    "Account", "Account #", "Ticker", "Shares", "Purchase Date", "Unit Cost ($)", "Cost Basis ($)",
    "Value ($)", "Asset Type",
]
HYBRID_HEADER = ["Symbol", "Date Acquired", "Qty #", "Price Paid $", "Total Cost", "Value $"]
GROUP_HEADER = [
    "Description", "Symbol", "Quantity", "Initial Purchase Date", "Unit Cost ($)", "Cost Basis ($)",
    "Value ($)", "Fund Category",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: str) -> str:
    return f"cast(floor({amount} * 100 + 0.5) as bigint)"


def money(whole_cents: str) -> str:
    return f"concat(cast({whole_cents} div 100 as string), '.', lpad(cast({whole_cents} % 100 as string), 2, '0'))"


def grouped_money(whole_cents: str) -> str:
    """With thousands separators, as flat reports print totals."""
    return f"concat(format_number({whole_cents} div 100, 0), '.', lpad(cast({whole_cents} % 100 as string), 2, '0'))"


def lot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with whole-number amounts; two foreign-key joins."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "cast(l_shipdate as date) as day"
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_type", "p_size", "p_retailprice"
    )
    return (
        lines.join(orders, "l_orderkey")
        .join(parts, "l_partkey")
        .selectExpr(
            "l_suppkey as suppkey",
            "cast(l_suppkey % 3 as int) as layout",
            "l_orderkey as orderkey",
            "o_custkey as custkey",
            "l_partkey as partkey",
            "l_linenumber as linenumber",
            "cast(l_quantity as bigint) as qty",
            f"{cents('l_extendedprice')} as cost",
            f"{cents('l_extendedprice / l_quantity')} as unit",
            f"cast(l_quantity as bigint) * {cents('p_retailprice')} as value",
            "day",
            "p_type as type",
            "p_size as size",
        )
    )


#: What a report prints of a lot, over :func:`lot_facts`.
LOT_TEXT = {
    "Broker": "concat('B', suppkey)",
    "Account": "case when layout = 1 then concat('S', suppkey) else concat('C', custkey) end",
    "Account#": "case when layout = 0 then lpad(cast(custkey as string), 8, '0') else cast(9000 + suppkey as string) end",
    "Symbol": "concat('P', partkey)",
    "Quantity": "cast(qty as string)",
    "Acquisition Date": "case layout when 0 then date_format(day, 'yyyy-MM-dd') when 1 then date_format(day, 'MM/dd/yyyy')"
    " else date_format(day, 'M/d/yyyy') end",
    "Cost per Unit": money("unit"),
    "Total Cost": f"case when layout = 0 then {grouped_money('cost')} else {money('cost')} end",
    "Value": money("value"),
    "Type": "case when layout <> 1 then type end",
    "Source": "cast(null as string)",
}


def lots(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None, *also: str) -> DataFrame:
    """Canonical lots as text, the way their report prints them, of all facts or those given."""
    facts = lot_facts(spark, sf_dir) if facts is None else facts
    return facts.selectExpr(*[f"{text} as `{name}`" for name, text in LOT_TEXT.items()], "layout", "size", *also)


_FACTS: dict[tuple[str, str], DataFrame] = {}


def staged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`lots` prints of :func:`lot_facts`, written once per application for queries that need it several times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        _FACTS[key] = stage(lot_facts(spark, sf_dir).drop("orderkey", "linenumber"), "lot-facts")
    return _FACTS[key]


def _head_rows(first_rows: list[list]) -> Column:
    rows = [F.array(*[cell if isinstance(cell, Column) else F.lit(cell) for cell in cells]) for cells in first_rows]
    return F.array(*[row.cast("array<string>") for row in rows])


def report_heads(lines: DataFrame) -> DataFrame:
    """The first lines of every report: titles, key-values, side tables, header."""
    supp = F.col("suppkey")
    account_no = F.concat(F.lit("Acct No: "), (supp + 9000).cast("string"), F.lit("; Currency: USD"))
    top: list[list] = [["Statement of holdings"], ["Acct No: draft"], [account_no], []]
    summary = [F.concat(F.lit("S"), supp.cast("string")), "0", "0"]
    flat = [*top, ["Filter", "Setting"], ["Currency", "USD"], ["", ""], FLAT_HEADER]
    hybrid = [*top, ["Account", "Net Account Value", "Total Gain $"], summary, [" "], HYBRID_HEADER]
    grouped = [*top, ["Holdings by security"], ["Prepared for clients"], [], GROUP_HEADER]
    layout = supp % 3
    rows = F.when(layout == 0, _head_rows(flat)).when(layout == 1, _head_rows(hybrid)).otherwise(_head_rows(grouped))
    heads = lines.select("suppkey").distinct().select("suppkey", F.posexplode(rows).alias("row_no", "cells"))
    return heads.select("suppkey", F.lit(0).cast("long").alias("block"), F.col("row_no").cast("long").alias("row_no"), "cells")


def report_grid(spark: SparkSession, sf_dir: str, orders_per_block: int = ORDERS_PER_BLOCK) -> DataFrame:
    """All reports as a grid.

    Lots are listed by block of orders, then symbol, then order; a lot with line
    number 1 is printed twice. Rows are numbered within (report, block), so the
    numbering splits a large report over many tasks.

    Lots meet their report and block once, as numbers, with a mark for each block that prints totals. What is
    printed for them (copies, summaries, totals) is made there, numbered, and becomes text last.
    """
    keep_methods_small(spark)
    facts = lot_facts(spark, sf_dir).withColumn("block", F.expr(f"1 + orderkey div {orders_per_block}"))
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as suppkey", "cast(l_suppkey % 3 as int) as layout", f"1 + l_orderkey div {orders_per_block} as block"
    )
    lots = facts.drop("size").withColumn("is_edge", F.lit(False))
    edges = lines.filter("layout <> 0").distinct().withColumn("is_edge", F.lit(True))
    file = F.concat(F.lit("/reports/B"), F.col("suppkey").cast("string"), F.lit("_2002.csv"))
    stored_by = report_buckets(spark, sf_dir)
    # Zero, but no constant to Spark, which would leave it out of the windows' keys and shuffle the rows for the rest.
    sheet_no = F.coalesce(F.col("layout") % 1, F.lit(0)).cast("int")
    entries = lots.unionByName(edges, allowMissingColumns=True).withColumns({"file": file, "sheet_no": sheet_no})
    entries = entries.repartition(*stored_by)
    of_part = Window.partitionBy(*REPORT_BLOCK, "layout", "partkey", "type").orderBy("orderkey")
    whole = of_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = entries.withColumns(
        {**{f"part_{name}": F.sum(name).over(whole) for name in ("qty", "cost", "value")}, "nth": F.row_number().over(of_part)}
    )
    # What a row prints: 0 its part's summary, 1 the lot, 2 the heading of a block, 3 its total.
    prints = """explode(case
        when is_edge then case layout when 2 then array(2, 3) else array(3) end
        when nth = 1 and layout <> 0 then case when linenumber = 1 then array(0, 1, 1) else array(0, 1) end
        when linenumber = 1 then array(1, 1) else array(1) end) as what"""
    printed = summed.selectExpr("*", prints).selectExpr(
        *REPORT_BLOCK, "layout", "what", "custkey", "day", "unit", "type",
        "case what when 2 then -1L when 3 then 9000000000000000000L else partkey end as partkey",
        "case what when 1 then 1 else 0 end as kind",
        "case what when 1 then orderkey else 0L end as orderkey",
        "case what when 1 then linenumber else 0 end as linenumber",
        "case what when 0 then part_qty else qty end as qty",
        "case what when 0 then part_cost when 1 then cost else 0L end as cost",
        "case what when 0 then part_value else value end as value",
    )
    day = (
        "case layout when 0 then date_format(day, 'yyyy-MM-dd') when 1 then date_format(day, 'MM/dd/yyyy')"
        " else date_format(day, 'M/d/yyyy') end"
    )
    cells = F.expr(
        f"""case what
        when 1 then case layout
            when 0 then array(concat('C', custkey), lpad(cast(custkey as string), 8, '0'), concat('P', partkey),
                cast(qty as string), {day}, {money('unit')}, {grouped_money('cost')}, {money('value')}, type)
            when 1 then array('', {day}, cast(qty as string), {money('unit')}, {money('cost')}, {money('value')})
            else array(concat('C', custkey), '', cast(qty as string), {day}, {money('unit')}, {money('cost')},
                {money('value')}, type) end
        when 0 then case layout
            when 1 then array(concat('P', partkey), '', cast(qty as string), '', {money('cost')}, {money('value')})
            else array(concat('Holding ', partkey), concat('P', partkey), cast(qty as string), '', '',
                {money('cost')}, {money('value')}, type) end
        when 2 then array('Mutual Fund', '', '', '', '', '', '', '')
        else case layout when 1 then array('TOTAL', '', '', '', '', '')
            else array('Total', '', '', '', '', '', '', '') end end"""
    )
    order = Window.partitionBy(*REPORT_BLOCK).orderBy("partkey", "kind", "orderkey", "linenumber", "cost")
    peers = order.rangeBetween(Window.currentRow, Window.currentRow)
    content = F.xxhash64("custkey", "qty", "day", "unit", "value", "type")
    ranked = printed.withColumns(
        {
            "place": F.rank().over(order),
            "differs": F.min(content).over(peers) != F.max(content).over(peers),
        }
    )
    # Text tells rows apart only where keys repeat with other content.
    numbered = ranked.withColumn("text", F.when(F.col("differs"), F.array_join(cells, "|")))
    at = F.row_number().over(Window.partitionBy(*REPORT_BLOCK).orderBy("place", "text"))
    body = numbered.withColumn("row_no", F.col("block") * _BLOCK_SPAN + at).select(*REPORT_BLOCK, "row_no", cells.alias("cells"))
    heads = report_heads(lines).select(file.alias("file"), F.lit(0).alias("sheet_no"), "block", "row_no", "cells")
    heads = heads.repartition(*stored_by)
    return heads.unionByName(body).select(
        "file",
        "sheet_no",
        F.lit(None).cast("string").alias("sheet"),
        "block",
        "row_no",
        "cells",
    )


#: What the rows of the report table are in buckets by: each holds whole blocks.
REPORT_BLOCK = BLOCK
#: Lots of a bucket on average, which a task can sort in memory.
BUCKET_LOTS = 400_000


def report_buckets(spark: SparkSession, sf_dir: str) -> tuple[int | str, ...]:
    """Number of buckets of the report table, which grows with it, and their columns, as ``repartition`` takes them."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-table(spark, sf_dir, "lineitem").count() // BUCKET_LOTS)), *REPORT_BLOCK


_REPORT_TABLES: dict[tuple[str, str], DataFrame] = {}


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`report_grid` written once per application and read as a table in buckets by :data:`REPORT_BLOCK`."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _REPORT_TABLES:
        _REPORT_TABLES[key] = stage_bucketed(
            report_grid(spark, sf_dir), "reports", *report_buckets(spark, sf_dir), then=("row_no",)
        )
    return _REPORT_TABLES[key]


_EARLIER: dict[tuple[str, str], str] = {}


def earlier_output(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an earlier run's output, stamped ``run``; written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EARLIER:
        folder = new_folder(spark, "earlier-output")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        facts = staged_facts(spark, sf_dir).filter("size <= 30")
        # Facts meet in their lot's bucket as numbers, which are half as long as their text.
        dealt = facts.withColumn("lot_key", lot_key(LOT_TEXT, LOT_TEXT)).repartition(buckets, "lot_key")
        write_lots(lots(spark, sf_dir, dealt, "lot_key").drop("layout", "size"), folder, "run", buckets=buckets, as_set=True)
        _EARLIER[key] = folder
    return _EARLIER[key]


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event value per user: ``total`` of all events, ``part`` of some types."""
    amount = F.col("value").cast("decimal(18,2)")
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").alias("series_id"),
            F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("pos"),
        )
        .agg(
            F.sum(amount).cast("double").alias("total"),
            F.sum(F.when(F.col("event_type").isin("click", "purchase"), amount)).cast("double").alias("part"),
        )
    )


def _returns(days: DataFrame, value: str) -> DataFrame:
    """Change against the previous day that has a value.

    A series has one row per calendar day at most, so its window is bounded.
    """
    order = Window.partitionBy("series_id").orderBy("pos")
    present = days.filter(F.col(value).isNotNull()).select("series_id", "pos", F.col(value).alias("v"))
    change = F.try_divide(F.col("v"), F.lag("v").over(order)) - 1
    return present.select("series_id", "pos", change.alias("r"))


def portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returns(user_days(spark, sf_dir), "part")


def benchmark_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In percent for every second user."""
    scaled = F.when(F.col("series_id") % 2 == 0, F.col("r") * 100).otherwise(F.col("r"))
    return _returns(user_days(spark, sf_dir), "total").withColumn("r", scaled)


#: Rows of one sheet of a derived workbook.
SHEET_ROWS = 200
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def row_value() -> Column:
    """Of a row's ``cells`` the XML, before which the first cell stands as text if it is to be a shared string.

    Whole numbers are numbers, first cells shared strings, all others in place.
    """
    return F.expr(
        """array_join(transform(transform(cells, c -> replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), (c, i) -> case
        when c is null or c = '' then '<c/>'
        when c between '1' and '9a' and c rlike r'^[1-9][0-9]{0,14}\\z' then concat('<c><v>', c, '</v></c>')
        when i = 0 then c
        else concat('<c t="inlineStr"><is><t>', c, '</t></is></c>') end), '')"""
    )


def _sheet_xml(values: list[str], number_of: dict[str, int]) -> str:
    """A sheet of rows as :func:`row_value` gives them."""
    lines = []
    for value in values:
        at = value.find("<")
        if at == 0 or not value:
            lines.append(f"<row>{value}</row>")
        else:
            text, rest = (value, "") if at < 0 else (value[:at], value[at:])
            lines.append(f'<row><c t="s"><v>{number_of.setdefault(text, len(number_of))}</v></c>{rest}</row>')
    return f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def workbook_bytes(values: list[str], sheet_rows: int = SHEET_ROWS) -> bytes:
    """An XLSX file with the rows (:func:`row_value`) on sheets S1, S2 and so on."""
    sheets = [values[at : at + sheet_rows] for at in range(0, len(values), sheet_rows)]
    number_of: dict[str, int] = {}
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        names = "".join(f'<sheet name="S{n}" sheetId="{n}" r:id="r{n}"/>' for n in range(1, len(sheets) + 1))
        links = "".join(f'<Relationship Id="r{n}" Target="worksheets/s{n}.xml"/>' for n in range(1, len(sheets) + 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{names}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x">{links}</Relationships>')
        for number, some in enumerate(sheets, start=1):
            book.writestr(f"xl/worksheets/s{number}.xml", _sheet_xml(some, number_of))
        items = "".join(f"<si><t>{text}</t></si>" for text in number_of)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{items}</sst>')
    return target.getvalue()


def write_blocks(rows: DataFrame, folder: str, suffix: str, content: Callable[[list], bytes], nameless: str) -> DataFrame:
    """A file for each report and block of ``rows`` (file, sheet_no, block, row_no, value); their paths and lengths.

    A file has one sheet. ``content`` makes a file's bytes of a block's values. The tasks write the files and tell of them, so nobody
    has to list a folder of so many. A report without a name is ``nameless``.
    """
    spark = rows.sparkSession
    full = qualified(spark, [folder])[0]
    system, inner = file_system(full)
    system.create_dir(inner)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(name: str, values: list) -> pa.RecordBatch:
            data = content(values)
            # A task that is run twice, or by two executors at once, leaves one whole file.
            scratch = f"{inner}/_{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(scratch) as target:
                target.write(data)
            system.move(scratch, f"{inner}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{full}/{name}"], "length": [len(data)]})

        name, held = None, []
        for batch in batches:
            reports, blocks, values = (batch[c] for c in ("report", "block", "value"))
            firsts = [*pc.indices_nonzero(pc.equal(batch["at"], 1)).to_pylist(), len(batch)]
            held += values[: firsts[0]].to_pylist()
            for first, end in zip(firsts, firsts[1:]):
                if name is not None:
                    yield written(name, held)
                report = reports[first].as_py()
                name = f"{nameless if report is None else report}-{blocks[first].as_py()}{suffix}"
                held = values[first : end].to_pylist()
        if name is not None:
            yield written(name, held)

    at = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("row_no"))
    report = F.regexp_extract("file", "([^/]*)[.]csv$", 1).alias("report")
    in_order = rows.select(*BLOCK, "row_no", "value").withColumn("at", at).select(report, "block", "at", "value")
    return stage(in_order.mapInArrow(write, "path string, length long"), "written-files")


def write_workbooks(reports: DataFrame, folder: str) -> DataFrame:
    """One workbook for each report and block; their paths and lengths."""
    rows = reports.select(*BLOCK, "row_no", row_value().alias("value"))
    return write_blocks(rows, folder, ".xlsx", workbook_bytes, "None")


def _text_bytes(lines: list[str | None]) -> bytes:
    return "".join(f"{line or ''}\n" for line in lines).encode()


def write_texts(lines: DataFrame, folder: str) -> DataFrame:
    """One text for each report and block of ``lines`` (file, sheet_no, block, row_no, value); their paths and lengths."""
    return write_blocks(lines, folder, ".txt", _text_bytes, "__HIVE_DEFAULT_PARTITION__")
