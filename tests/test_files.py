import os
import pathlib
import subprocess
import sys
import textwrap
import zipfile

import pytest
from pyspark.sql import functions as F

from lotframe.operators import canonical
from lotframe.plans.ingest import ingest
from lotframe.operators.segment import by_block
from lotframe.operators.series import beta_truncated
from lotframe.plans.jobs import lots_of_files, return_series, run
from lotframe.sources.cells import text_rows
from lotframe.sources.flat import read_flat
from lotframe.sources.grid import read_folder, read_grid, select_sheets
from lotframe.sources.manifest import choose_entries, manifest_entries, manifest_frame, united_entries
from lotframe.sources.sinks import latest_version, lots_path, read_lots, with_previous, write_lots
from lotframe.sources.staging import shared_folder
from lotframe.streaming.ingest import land_batch, stream_reports

from reports import FILES, FLAT, HYBRID, LOTS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_workbook(path, sheets, strings=(), styles=""):
    """Sheets as (name, sheetData XML)."""
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x">{links}</Relationships>')
        items = "".join(f"<si>{s}</si>" for s in strings)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
        for i, (_, data) in enumerate(sheets, 1):
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{data}</sheetData></worksheet>')


def inline(text):
    return f'<c t="inlineStr"><is><t>{text}</t></is></c>'


def sheet_of(rows):
    return "".join("<row>" + "".join(inline(cell) if cell else "<c/>" for cell in row) + "</row>" for row in rows)


def cells_of(grid):
    return [row.cells for row in grid.orderBy("sheet_no", "row_no").collect()]


def test_text_rows():
    content = "\ufeffa,b\r\n\r\n\"x\ny\",\"1,000\"\r\n \n\"q\"\"\",z".encode() + b"\xff!\n"
    assert list(text_rows(content)) == [["a", "b"], [], ["x\ny", "1,000"], [" "], ['q"', "z!"]]
    assert list(text_rows(b"")) == []


def test_csv_grid(spark, tmp_path):
    (tmp_path / "a b_1.csv").write_text("t\n\na,b\n1\n")
    (tmp_path / "empty_1.csv").write_text("")
    grid = read_grid(spark, [str(tmp_path / "a b_1.csv"), {"path": str(tmp_path / "empty_1.csv")}, "/no/such.csv"], block_rows=2)
    found = {(row.file.rsplit("/", 1)[1], row.sheet_no, row.sheet, row.block, row.row_no, tuple(row.cells)) for row in grid.collect()}
    assert found == {
        ("a b_1.csv", 0, None, 0, 0, ("t",)), ("a b_1.csv", 0, None, 0, 1, ()), ("a b_1.csv", 0, None, 1, 2, ("a", "b")),
        ("a b_1.csv", 0, None, 1, 3, ("1",)), ("empty_1.csv", 0, None, 0, 0, ()),
    }
    assert read_grid(spark, ["/no/such.csv"]).count() == 0


def test_workbook_cells(spark, tmp_path):
    path = tmp_path / "w_1.xlsx"
    styles = (
        '<numFmts><numFmt numFmtId="170" formatCode="[Red]0.00 &quot;days&quot;"/><numFmt numFmtId="171" formatCode="yyyy\\-mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    )
    data = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>100.0</v></c></row>'
        '<row r="3"><c r="B3" s="1"><v>43845</v></c><c r="C3" s="2"><v>1.5</v></c><c r="D3" s="3"><v>43845.5</v></c></row>'
        '<row r="4"><c r="A4" t="b"><v>1</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="C4" t="str"><f>X</f><v>calc</v></c>'
        '<c r="AA4" t="inlineStr"><is><r><t>na</t></r><r><t>N</t></r></is></c></row>'
    )
    write_workbook(path, [("Data", data), ("Other", sheet_of([["x"]]))], ["<r><t>Sym</t></r><r><t>bol</t></r>"], styles)
    grid = read_grid(spark, [{"path": str(path), "tabs": ["Data", "Missing"]}])
    rows = cells_of(grid)
    assert [len(row) for row in rows] == [27] * 4
    assert rows[0][:4] == ["Symbol", "", "100", ""]
    assert rows[1] == [""] * 27
    assert rows[2][:4] == ["", "2020-01-15 00:00:00", "1.5", "2020-01-15 12:00:00"]
    assert rows[3][:4] == ["True", "", "calc", ""] and rows[3][26] == ""
    both = read_grid(spark, [str(path)])
    assert {(row.sheet_no, row.sheet) for row in both.select("sheet_no", "sheet").distinct().collect()} == {(1, "Data"), (2, "Other")}
    assert cells_of(select_sheets(both, ["Other", "Missing"])) == [["x"]]
    assert select_sheets(both, None).count() == 5


def test_hybrid_workbook_and_mislabelled_files(spark, tmp_path):
    rows = [line.split(",") for line in HYBRID.splitlines()]
    write_workbook(tmp_path / "CC_1.xlsx", [("S", sheet_of(rows[1:]))])
    (tmp_path / "AA_1.xls").write_text(FLAT)
    (tmp_path / "ZZ_1.xlsx").write_bytes(b"PK\x03\x04 not a workbook\n")
    entries = [str(tmp_path / name) for name in ("CC_1.xlsx", "AA_1.xls")]
    found = {tuple(row) for row in lots_of_files(spark, entries).collect()}
    assert found == {lot for lot in LOTS if lot[0] in ("AA", "CC")}
    assert read_grid(spark, [str(tmp_path / "ZZ_1.xlsx")]).count() == 1


def test_manifest(spark, tmp_path):
    entries = ["a.csv", {"path": "b.XLSX", "tabs": []}, {"path": "c.xls", "tabs": ["T"]}, {"tabs": ["T"]}, None, ""]
    assert manifest_entries(entries) == [("a.csv", None), ("b.XLSX", None), ("c.xls", ["T"])]
    with pytest.raises(ValueError):
        manifest_entries(["a.txt"])
    assert manifest_entries(["a.txt", "a.csv"], on_bad_file="skip") == [("a.csv", None)]
    assert choose_entries([], {"INPUT_FILES": ["x.csv"]}) == ["x.csv"]
    assert choose_entries(["y.csv"], {"INPUT_FILES": ["x.csv"]}) == ["y.csv"]
    (tmp_path / "a.csv").write_text("")
    frame = manifest_frame(spark, [str(tmp_path / "a.csv"), str(tmp_path / "none.csv")])
    assert [(row.file_no, row.path.endswith("/a.csv")) for row in frame.collect()] == [(0, True)]


def _write_files(folder, names=FILES):
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / name).write_text(FILES[name])
    return [str(folder / name) for name in names]


def test_run_in_order_with_metrics_and_append(spark, tmp_path):
    paths = _write_files(tmp_path / "in")
    returns = tmp_path / "r.csv"
    returns.write_text("return\n0.02\nx\n0.03\n0.0\n")
    fields = "Broker,Account,Account#,Symbol,Quantity,Acquisition Date,Cost per Unit,Total Cost,Value,Type,Source"
    settings = {
        "INPUT_FILES": [paths[3], paths[0]],
        "OUTPUT_DIR": str(tmp_path / "out"),
        "OUTPUT_FIELDS": fields,
        "METRICS": {"RETURNS": {"PORTFOLIO_FILE": str(returns), "BENCHMARK_FILE": str(returns)}},
    }
    as_of = F.lit("2024-01-15").cast("date")
    staged = pathlib.Path(shared_folder(spark)) / "lotframe"
    before = set(staged.glob("*"))
    written = run(spark, settings, timestamp="20240101_000000", as_of=as_of)
    assert set(staged.glob("*")) == before
    assert written.endswith("/portfolio-20240101_000000/v1")
    out = spark.read.option("header", True).csv(written).collect()
    assert [row["Broker"] for row in out] == ["DD", "DD", "AA", "AA"]
    assert out[2].asDict()["Beta"] == "1.0" and out[2]["Years Held"] == str(1461 / 365.25)
    assert float(out[2]["CAGR"]) == pytest.approx(1.5 ** (1 / 4) - 1)
    assert float(out[3]["CAGR"]) == pytest.approx(2.5 ** (365.25 / 1050) - 1)

    settings.pop("METRICS")
    again = run(spark, settings, files=paths[:2], timestamp="20240101_000000", append=True, as_of=as_of)
    assert again.endswith("/v2") and latest_version(spark, lots_path(settings["OUTPUT_DIR"], "20240101_000000")) == again
    lots = read_lots(spark, lots_path(settings["OUTPUT_DIR"], "20240101_000000"), fields.split(","))
    assert {tuple(row) for row in lots.collect()} == {lot for lot in LOTS if lot[0] in ("AA", "BB", "DD")}
    assert read_lots(spark, str(tmp_path / "nothing"), fields.split(",")) is None


def test_stream_appends_once(spark, tmp_path):
    folder, sink, checkpoint = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "cp")

    def drain():
        stream = stream_reports(spark, str(folder), sink, checkpoint, files_per_batch=1, available_now=True)
        stream.finish(300)
        assert stream.landing.exception() is None and stream.unseen.exception() is None
        found = spark.read.parquet(sink).collect()
        return stream, len(found), {tuple(row) for row in found}

    _write_files(folder, ["AA_1.csv", "CC_1.csv"])
    first = {lot for lot in LOTS if lot[0] in ("AA", "CC")}
    assert drain()[1:] == (len(first), first)
    _write_files(folder, ["BB_1.csv"])
    (folder / "AA_2.csv").write_text(FLAT + "Main,00123,NEW,1,,,,,\n")
    second = first | {lot for lot in LOTS if lot[0] == "BB"}
    second |= {("AA", "Main", "00123", "NEW", "1", None, None, None, None, None, None)}
    stream, *found = drain()
    assert found == [len(second), second]
    # What was put out before is not read again: the batch reads the lots that have landed since, repeats included.
    progress = [p for p in stream.unseen.recentProgress if p.numInputRows]
    assert sum(p.numInputRows for p in progress) == len([lot for lot in LOTS if lot[0] == "BB"]) + 3
    assert all(source.description.endswith("/landed]") for p in progress for source in p.sources)
    assert {p.stateOperators[0].operatorName for p in progress} == {"dedupe"}
    # A landed batch that is run again stays as it is; one that was cut off is written anew and goes through once.
    landed = pathlib.Path(checkpoint) / "landed"
    names = sorted(str(f) for f in landed.rglob("*.parquet"))
    files = spark.read.format("binaryFile").load(str(folder / "AA_1.csv"))
    land_batch(files, 0, str(landed), canonical.FULL_FIELDS)
    assert sorted(str(f) for f in landed.rglob("*.parquet")) == names
    (landed / "batch_id=0" / "_SUCCESS").unlink()
    land_batch(files, 0, str(landed), canonical.FULL_FIELDS)
    assert sorted(str(f) for f in landed.rglob("*.parquet")) != names
    assert drain()[1:] == (len(second), second)


def test_folder_scan(spark, tmp_path):
    _write_files(tmp_path / "in")
    grid = read_folder(spark, str(tmp_path / "in"), "[AC]*.csv")
    assert {tuple(row) for row in ingest(grid).collect()} == {lot for lot in LOTS if lot[0] in ("AA", "CC")}


def test_odd_names_and_open_quotes_at_any_size(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("M L_1.csv", "G[1]_1.csv", "P%20+_1.csv", "S{a}*_1.csv"):
        (tmp_path / "in" / name).write_text(FLAT + 'Main,1,OPEN,2,01/15/2020,,,,"never closed\n')
    entries = [str(path) for path in sorted((tmp_path / "in").iterdir())]
    short = {tuple(row) for row in lots_of_files(spark, entries).collect()}
    assert {lot[0] for lot in short} == {"M L", "G[1]", "P%20+", "S{a}*"}
    assert {lot[9] for lot in short if lot[3] == "OPEN"} == {"never closed"}
    cut = ingest(read_grid(spark, entries, split_bytes=40))
    assert {tuple(row) for row in cut.collect()} == short
    assert {tuple(row) for row in lots_of_files(spark, entries, keep_order=True).collect()} == short


def test_repeated_entries(spark, tmp_path):
    (tmp_path / "AA_1.csv").write_text(FLAT)
    write_workbook(tmp_path / "BB_1.xlsx", [(n, sheet_of([["Symbol", "Qty"], [n, "1"]])) for n in ("One", "Two", "Three")])
    path, book = str(tmp_path / "AA_1.csv"), str(tmp_path / "BB_1.xlsx")
    entries = [path, {"path": book, "tabs": ["One"]}, path, {"path": book, "tabs": ["Two", "One"]}]
    lots = lots_of_files(spark, entries, keep_order=True).collect()
    assert [(lot["Broker"], lot["Symbol"]) for lot in lots] == [("AA", "AAA"), ("AA", "BBB"), ("BB", "One"), ("BB", "Two")]
    united = united_entries(spark, [{"path": book, "tabs": ["One"]}, book])
    assert list(united.values()) == [None]


def test_bad_sheet_leaves_the_others(spark, tmp_path):
    good = sheet_of([["Symbol", "Qty"], ["AAA", "1"]])
    write_workbook(tmp_path / "CC_1.xlsx", [("Bad", "<row><c t='s'><v>99</v></c></row>"), ("Good", good)])
    assert cells_of(read_grid(spark, [str(tmp_path / "CC_1.xlsx")])) == [["Symbol", "Qty"], ["AAA", "1"]]


def test_append_keeps_text_and_names(spark, tmp_path):
    fields = ("Symbol", "Account")
    first = spark.createDataFrame([(" AAA ", 'Main\nSub "x"'), ("B", None)], "Symbol string, Account string")
    written = write_lots(first, str(tmp_path), "t")
    again = spark.createDataFrame([('Main\nSub "x"', " AAA ", 1), ("Other", "C", 2)], "Account string, Symbol string, more int")
    write_lots(with_previous(again, str(tmp_path), "t", fields), str(tmp_path), "t")
    expected = {(" AAA ", 'Main\nSub "x"'), ("B", None), ("C", "Other")}
    assert {tuple(r) for r in read_lots(spark, lots_path(str(tmp_path), "t"), fields).collect()} == expected
    assert {tuple(r) for r in read_flat(spark, written).collect()} == {tuple(r) for r in first.collect()}
    assert {tuple(r) for r in read_lots(spark, lots_path(str(tmp_path), "t"), ("New", "Symbol")).collect()} == {(None, " AAA "), (None, "B"), (None, "C")}


def test_mapping_of_a_run(spark, tmp_path):
    (tmp_path / "AA_1.csv").write_text("Ticker,Shares\nAAA,1\n")
    (tmp_path / "map.json").write_text('{"Symbol": ["shares"], "Quantity": ["ticker"]}')
    settings = {"INPUT_FILES": [str(tmp_path / "AA_1.csv")], "OUTPUT_DIR": str(tmp_path / "out"), "OUTPUT_FIELDS": "Broker,Symbol,Quantity"}

    def lots(stamp, **more):
        path = run(spark, {**settings, **more.pop("settings", {})}, timestamp=stamp, **more)
        return [(r["Broker"], r["Symbol"], r["Quantity"]) for r in read_flat(spark, path).collect()]

    assert lots("a") == [("AA", "AAA", "1")]
    assert lots("b", synonyms={}) == [("AA", None, None)]
    assert lots("c", settings={"COLUMN_MAPPING": str(tmp_path / "map.json")}) == [("AA", "1", "AAA")]
    assert lots("d", settings={"COLUMN_MAPPING": str(tmp_path / "none.json")}) == [("AA", None, None)]


def test_first_column_stands_in_only_without_bad_values(spark, tmp_path):
    for name, text in (("p", "x\n0.1\n0.2\n0.4\n"), ("b", "x\n0.1\n0.3\n0.2\n"), ("bad", "x\n0.1\noops\n0.2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    p, b, bad = (return_series(spark, str(tmp_path / f"{n}.csv"), "return") for n in ("p", "b", "bad"))
    assert beta_truncated(p, b).first().beta is not None and beta_truncated(p, bad).first().beta is None


def test_rows_without_a_block_raise(spark):
    grid = spark.createDataFrame([("f", 0, None, None, 0, ["a"])], "file string, sheet_no int, sheet string, block long, row_no long, cells array<string>")
    with pytest.raises(Exception, match="no block"):
        by_block(grid).collect()


def test_a_long_sheet_takes_bounded_memory(tmp_path):
    """300,000 rows and as many shared strings, in a process of its own."""
    script = tmp_path / "read.py"
    script.write_text(textwrap.dedent(f"""
        import resource, sys, zipfile
        sys.path.insert(0, {ROOT!r})
        from lotframe.sources import cells
        main, rel = {MAIN!r}, {REL!r}
        with zipfile.ZipFile("w.xlsx", "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{{main}}" xmlns:r="{{rel}}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></R>')
            with book.open("xl/sharedStrings.xml", "w") as part:
                part.write(f'<sst xmlns="{{main}}">'.encode())
                for i in range(300_000):
                    part.write(f"<si><t>text number {{i}} {{'x' * 100}}</t></si>".encode())
                part.write(b"</sst>")
            with book.open("xl/worksheets/s.xml", "w") as part:
                part.write(f'<worksheet xmlns="{{main}}"><sheetData>'.encode())
                for i in range(300_000):
                    inner = "".join(f'<c t="inlineStr"><is><t>{{i}}-{{k}}</t></is></c>' for k in range(5))
                    part.write(f'<row><c t="s"><v>{{i}}</v></c>{{inner}}</row>'.encode())
                part.write(b"</sheetData></worksheet>")
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        book = cells.Workbook(open("w.xlsx", "rb"))
        n = 0
        for row in book.rows(book.sheets[0]):
            n += row[0].startswith(f"text number {{n}} ") and row[5] == f"{{n}}-4"
        print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
    """))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=400)
    rows, grown_mb = map(int, done.stdout.split()) if done.returncode == 0 else (done.stderr, 0)
    assert rows == 300_000 and grown_mb < 100


def test_appends_keep_their_buckets(spark, tmp_path):
    fields = ("Symbol", "Account", "Note")
    types = "Symbol string, Account string, Note string"
    first = spark.createDataFrame([(f"S{i}", None if i % 3 else "A", " x ") for i in range(50)] + [(None, "A", None)], types)
    write_lots(first, str(tmp_path), "t", buckets=4)
    for k in (1, 2):
        more = spark.createDataFrame([(f"S{i}", None if i % 3 else "A", " x ") for i in range(40, 50 + 10 * k)] + [(None, "A", None), ("", " ", None)], types)
        joined = with_previous(more, str(tmp_path), "t", fields)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
        write_lots(joined, str(tmp_path), "t")
    path = lots_path(str(tmp_path), "t")
    copies = sorted(p.name.split("-")[:2] for p in (tmp_path / "portfolio-t" / "_working").iterdir())
    assert copies == [["v1", "4"], ["v2", "4"], ["v3", "4"]]
    assert all(len(list(p.glob("*.parquet"))) <= 4 for p in (tmp_path / "portfolio-t" / "_working").iterdir())
    lots = [tuple(r) for r in read_lots(spark, path, fields).collect()]
    assert len(lots) == len(set(lots)) == 71
    assert {tuple(r) for r in read_flat(spark, latest_version(spark, path)).collect()} == set(lots)
    # Other fields have other keys: those lots are compared whole.
    fewer = with_previous(spark.createDataFrame([("A", "S0"), ("B", "S0")], "Account string, Symbol string"), str(tmp_path), "t", ("Account", "Symbol"))
    assert fewer.count() == 72
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lotframe_")]
