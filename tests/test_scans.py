"""Findings F1 to F4 of the fourth round: scans of written reports, and passes over stored ones."""

import io
import re
import time
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lotframe.catalog import QUERIES, derived
from lotframe.functions import text as text_functions
from lotframe.operators.canonical import FULL_FIELDS
from lotframe.plans.audit import ingest_audit
from lotframe.plans.ingest import ingest, parse_reports
from lotframe.sources import cells
from lotframe.sources.cells import NotPlain, SharedStrings, Workbook
from lotframe.sources.staging import stage

from reports import grid_of
from test_files import MAIN, inline, write_workbook
from test_large_tables import formatted, tables  # noqa: F401
from test_plans import plan

HEAD = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n<worksheet xmlns="{MAIN}" xmlns:x="urn:x"><dimension ref="A1"/><sheetData>'
TAIL = '</sheetData><pageMargins left="0.7"/></worksheet>'


def book_of(sheet, strings=f'<sst xmlns="{MAIN}"><si><t>one &amp; two</t></si><si><t xml:space="preserve"> nan </t></si></sst>'):
    target = io.BytesIO()
    write_workbook(target, [("S", "")], styles='<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>')
    found = io.BytesIO()
    with zipfile.ZipFile(target) as old, zipfile.ZipFile(found, "w") as new:
        for name in old.namelist():
            text = {"xl/worksheets/s1.xml": sheet, "xl/sharedStrings.xml": strings}.get(name, old.read(name))
            new.writestr(name, text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"))
    return Workbook(found)


def read(book, how):
    """Rows of the first sheet, or that it can't be read."""
    try:
        return list(how(book.sheets[0]))
    except NotPlain:
        raise
    except Exception:
        return "left out"


CELLS = [
    "<c/>", '<c r="C1"/>', "<c></c>", inline("a"), inline("x &lt;&#65;&#x42;&gt; &quot;y&quot;&apos;"), inline(" NaN "), inline("é \xa0"),
    "<c><v>12</v></c>", "<c><v>1.50</v></c>", '<c s="1"><v>43845.5</v></c>', '<c t="s"><v>0</v></c>', '<c r="AB7" t="s"><v>1</v></c>',
    '<c t="b"><v>1</v></c>', '<c t="e"><v>#N/A</v></c>', '<c t="str"><f>A1+1</f><v>calc &amp; so</v></c>', "<c t='inlineStr'/>", "<c t='n' ><v></v></c>",
    '<c t="inlineStr"><is><t xml:space="preserve"> p </t></is></c>', " ", "\n\t",
]
ODD = [
    "<c><v>x</v></c>", '<c t="s"><v>99</v></c>', '<c s="x"/>', '<c s="x"><v>1</v></c>', "<!-- <row> -->", "<c t='inlineStr'><is><r><t>a</t></r><r><t>b</t></r></is></c>",
    '<c><v xml:space="preserve">7</v></c>', "&amp;", "text", "<c r='A1' r='A2'/>", '<c t="inlineStr"><is><t>a]]>b</t></is></c>', '<c x:t="s"><v>1</v></c>',
    '<c xmlns="urn:other"><v>1</v></c>', f'<y:c xmlns:y="{MAIN}"><v>5</v></y:c>', "<c><f t='shared'>A</f><v>3</v></c>", "<c", "</c>", "<row><c/></row>",
    inline("&nbsp;"), inline("&#0;"), inline("\x01"), inline("a\r\nb"), inline("￾"), "<v>1</v>", "<cc/>", '<c y:a="1"/>', "<?p <row/>?>", '<c t="a/b"><v>1</v></c>',
]
ROWS = ["<row>{}</row>", '<row r="5" spans="1:3" x:d="0.25">{}</row>', "<row/>{}", '<row r="9"/><row>{}</row>', "<row >{}</row>", "<row>{}</row >", " \n<row>{}</row>"]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(ROWS), st.lists(st.one_of(st.sampled_from(CELLS), st.sampled_from(CELLS + ODD)), max_size=5)), max_size=5),
    st.sampled_from([HEAD, HEAD.replace("UTF-8", "iso-8859-1"), HEAD.replace(f'xmlns="{MAIN}"', 'xmlns="urn:none"'), HEAD + "<!-- c -->", "﻿" + HEAD]),
    st.sampled_from([TAIL, TAIL, "<row/>" + TAIL, "</sheetData><!-- <row/> --></worksheet>", "</sheetData><more><row><c/></row></more></worksheet>", "</sheetData>", TAIL + "<x/>"]),
    st.sampled_from([1, 7, 60, 1 << 20]),
)
def test_plain_sheets_are_what_the_general_parser_makes_of_them(rows, head, tail, chunk):
    """what is taken apart without the general parser is equal; the rest is left to it."""
    book = book_of(head + "".join(row.format("".join(some)) for row, some in rows) + tail)
    before, cells.PART_CHUNK = cells.PART_CHUNK, chunk
    try:
        found = read(book, book._plain)
    except NotPlain:
        return
    finally:
        cells.PART_CHUNK = before
    assert found == read(book, book._ragged)


def test_plain_sheets_do_without_the_general_parser(monkeypatch):
    """every sheet went through it twice, and element by element."""
    plain = [cell for cell in CELLS if "xml:space" not in cell]
    book = book_of(HEAD + "".join(row.format("".join(plain)) for row in ROWS if "</row >" not in row and "<row/>{}" != row) + TAIL)
    expected, opened = list(book._ragged(book.sheets[0])), []
    monkeypatch.setattr(cells, "_closed", None)
    book = Workbook(book.book.fp)
    kept = book.book.open
    monkeypatch.setattr(book.book, "open", lambda name, *more: opened.append(name) or kept(name, *more))
    assert [row for row in book.rows(book.sheets[0]) if any(row)] == [c + [""] * (max(len(o) for _, o in expected) - len(c)) for _, c in expected if any(c)]
    assert opened.count("xl/worksheets/s1.xml") == 1


def test_shared_strings_of_any_kind_and_number(monkeypatch):
    """the first are in memory, the others behind them, whichever parser has read them."""
    plain = f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>t{i} é &lt;</t></si>" for i in range(9)) + "</sst>"
    rich = plain.replace("<si><t>t7 é", "<si><r><t>t7</t></r><r><t> é</t></r><rPh><t>no</t></rPh></si><si><t>t7 é", 1).replace("<si><t>t7 é &lt;</t></si>", "", 1)
    for known in (1 << 16, 4, 0):
        monkeypatch.setattr(cells, "SHARED_KNOWN", known)
        for text in (plain, rich):
            strings = SharedStrings(io.BytesIO(text.encode()))
            assert [strings[i] for i in range(7)] == [f"t{i} é <" for i in range(7)] and strings[8] == "t8 é <"
            assert strings[7].startswith("t7 é")
            for no in (-1, 9):
                with pytest.raises(IndexError):
                    strings[no]


def test_rows_of_derived_workbooks(spark):
    """a row's XML is made by Spark and holds what was in its cells."""
    rows = [["A&B", "<x>", "12", "012", None], ["12", "A&B", ""], [], ["", "é"], ["A&B"], ["1234567890123456", "9\n"], ["it's"]]
    frame = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], "i int, cells array<string>")
    values = [r[0] for r in frame.orderBy("i").select(derived.row_value()).collect()]
    book = Workbook(io.BytesIO(derived.workbook_bytes(values, 4)))
    assert [sheet.name for sheet in book.sheets] == ["S1", "S2"] and book.shared.first == ["A&B", "1234567890123456", "it's"]
    found = [row for sheet in book.sheets for row in book.rows(sheet)]
    assert found == [["A&B", "<x>", "12", "012", ""], ["12", "A&B", "", "", ""], [""] * 5, ["", "é", "", "", ""], ["A&B", ""], ["1234567890123456", "9\n"], ["it's", ""]]


@pytest.mark.parametrize("name", ["grid_scan_csv", "workbook_scan"])
def test_names_of_written_reports_are_not_looked_for_in_their_folders(spark, tables, name):  # noqa: F811
    """a pattern without a start was tried from every character of the path, for every row."""
    plan = formatted(QUERIES[name](spark, tables))
    assert len(re.findall(r"regexp_extract\(substring_index\(file#\d+, /, -1\), ", plan)) == 2 and "regexp_extract(file#" not in plan


def test_staged_tables_leave_no_shuffle_files(spark):
    """they stayed on disk beside the tables until the driver happened to collect its garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {disk.getAllBlocks().apply(i).name() for i in range(disk.getAllBlocks().size())}

    before = shuffles()
    found = stage(spark.range(100).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    table = derived.stage_bucketed(spark.range(50).withColumn("k", F.col("id") % 3).repartition(2, "k"), "rows", 2, "k", then=("id",))
    until = time.time() + 20
    while (left := [name for name in shuffles() - before if name.startswith("shuffle_")]) and time.time() < until:
        time.sleep(0.2)
    assert not left and found.count() == 7 and table.count() == 50
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_stored_reports_are_compressed_once_more_and_in_the_order_of_their_rows(spark, tables):  # noqa: F811
    """each pass over them sorted all rows."""
    stored = derived.report_table(spark, tables)
    assert all(".zstd." in name for name in stored.inputFiles())
    text = formatted(parse_reports(stored, FULL_FIELDS, stored_by=derived.report_buckets(spark, tables)).lots)
    assert "row_no" in text and not re.search(r"\) Sort\n[^)]*\[\d+\]: \[[^\n]*cells#", text)
    by_file = {}
    for row in stored.select("file", "sheet_no", "block", "row_no", F.input_file_name().alias("at")).collect():
        by_file.setdefault(row.at, []).append(tuple(row)[:4])
    assert by_file and all(rows == sorted(rows) for rows in by_file.values())


def test_rows_of_tables_are_told_by_the_first_and_the_last_of_them(spark, tables):  # noqa: F811
    """which table each row belongs to was worked out anew after the tables were known."""
    lots = parse_reports(derived.report_table(spark, tables), FULL_FIELDS, stored_by=derived.report_buckets(spark, tables)).lots
    assert "_blank#" not in formatted(lots) and "_opened#" not in formatted(lots)
    # Titles, blank rows and a second table in one block; a table over several blocks.
    text = "title\n\nSymbol,Qty\nA,1\nB,2\n,\nnote\nSymbol,Value\nC,3\n\n" + "Symbol,Qty\n" + "".join(f"D{i},{i}\n" for i in range(20))
    want = {("A", "1", None), ("B", "2", None), ("C", None, "3"), *((f"D{i}", str(i), None) for i in range(20))}
    for rows in (1, 3, 7, 1000):
        found = ingest(grid_of(spark, {"AA_1.csv": text}, rows), ("Symbol", "Quantity", "Value")).collect()
        assert len(found) == len(want) and {tuple(row) for row in found} == want


def test_key_values_are_counted_without_another_pass(spark, tables):  # noqa: F811
    """the audit read all reports once more to count them."""
    found = ingest_audit(derived.report_table(spark, tables), stored_by=derived.report_buckets(spark, tables))
    assert len(re.findall(r"max_by\(value#\d+, ", formatted(found))) > 0
    assert not re.search(r"keys=\[file#\d+, field#\d+\], functions=\[\]", plan(found))
    other = ingest_audit(grid_of(spark, {"AA_1.csv": "Acct No: 1; ticker = x\nAcct No: 2\n", "BB_1.csv": "a,b\n1,2\n"})).collect()
    assert {row.file: row.key_values for row in other} == {"/in/AA_1.csv": 2, "/in/BB_1.csv": 0}


@pytest.mark.parametrize("text", [None, "", " ", "nan", "NaN ", " nAn", "n", "N1", "nano", "total", "Total ", "\xa0CASH\t", "cash  equivalent", "Mutual Fund", "C12", "cab", "to", "1/2/2003", "12/31/1999", "1/2/03", "x1/2/2003", "é", "a\u2003", "0", "9/", ":", "~", "\x7fa", "a b "])
def test_quick_tests_of_cells_are_those_of_the_whole_text(spark, text):
    """cells that begin and end visibly are told without a search for white space."""
    strip, lower = text_functions.strip, lambda c: F.lower(text_functions.strip(c))
    c = F.col("c")
    found = spark.createDataFrame([(text,)], "c string").select(
        F.struct(text_functions.strip_cell(c), text_functions.is_missing(c), text_functions.is_category_heading(c), text_functions.is_us_date(c)).alias("new"),
        F.struct(strip(c), F.coalesce(lower(c).isin("", "nan"), F.lit(True)), lower(c).isin(*text_functions.CATEGORY_HEADINGS), c.rlike(text_functions.US_DATE)).alias("old"),
    ).first()
    assert tuple(found.new) == tuple(found.old)
