import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lotframe.plans.ingest import ingest
from lotframe.sources import inputs, text_splits
from lotframe.sources.cells import text_rows
from lotframe.sources.grid import read_folder, read_grid
from lotframe.sources.report_source import packed, register, split_plan
from lotframe.sources.text_splits import quote_open_after, scan_split, split_rows

from reports import FILES, LOTS
from test_files import sheet_of, write_workbook


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='a",', max_size=6), min_size=1, max_size=4))
def test_quote_state_agrees_with_the_csv_module(lines):
    is_open, records = False, 0
    for line in lines:
        records += not is_open
        is_open = quote_open_after(line, is_open)
    assert records == len(list(csv.reader(io.StringIO("\n".join(lines) + "\n"))))


PARTS = [b"a", b",", b'"', b"\n", b"\r\n", b"\r", b'""', b'",', b',"', b"\xff", "é\x0b ".encode(), b"x\n", b"\xe2\x82"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40), st.booleans(), st.integers(1, 30), st.sampled_from([1, 3, 1 << 20]))
def test_ranges_of_a_text_give_its_rows(parts, marked, step, chunk):
    content = b"\xef\xbb\xbf" * marked + b"".join(parts)
    before, text_splits.CHUNK_BYTES = text_splits.CHUNK_BYTES, chunk
    try:
        found, is_open = [], False
        for start in range(0, max(len(content), 1), step):
            end = min(start + step, len(content))
            scanned = scan_split(io.BufferedReader(io.BytesIO(content)), start, end)
            rows = list(split_rows(io.BufferedReader(io.BytesIO(content)), start, end, is_open))
            n, opens = scanned[2:] if is_open else scanned[:2]
            assert len(rows) == n
            found += rows
            is_open = bool(opens)
    finally:
        text_splits.CHUNK_BYTES = before
    assert found == list(text_rows(content))


CONTENTS = [
    'a,"b\nc",d\n1,2\n"x\n\n\ny",z\n"q""\n"",r",s\nplain "quoted" text,t\n' * 3 + "last",
    '"one\ntwo\nthree\nfour\nfive\nsix",7\nx\n\n"",\n',
    '﻿h,i\n1,2\n"open\nto the\nend, of file\n',
    "﻿",
    "",
]


@pytest.mark.parametrize("suffix", ["csv", "xls"])
def test_any_split_size_gives_the_same_grid(spark, tmp_path, suffix):
    for number, content in enumerate(CONTENTS):
        (tmp_path / f"f{number}.{suffix}").write_bytes(content.encode().replace(b"x\n", b"x\xff\n"))
    entries = [str(tmp_path / f"f{n}.{suffix}") for n in range(len(CONTENTS))]
    expected = set()
    for path in entries:
        rows = [tuple(cells) for cells in text_rows(open(path, "rb").read())] or [()]
        expected |= {(f"file:{path}", 0, None, i // 4, i, cells) for i, cells in enumerate(rows)}
    for size in (2, 40, 1 << 20):
        found = [(*row[:5], tuple(row.cells)) for row in read_grid(spark, entries, block_rows=4, split_bytes=size).collect()]
        assert len(found) == len(expected) and set(found) == expected, size


def test_split_reports_give_the_same_lots(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    lots = ingest(read_grid(spark, [str(tmp_path / name) for name in FILES], split_bytes=50)).collect()
    assert {tuple(row) for row in lots} == LOTS


def test_folder_scan_splits_long_files(spark, tmp_path):
    (tmp_path / "long.csv").write_text('a,"x\ny"\n' * 20)
    (tmp_path / "short.csv").write_text("b,c\n")
    found = read_folder(spark, str(tmp_path), split_bytes=30).collect()
    assert sum(row.cells == ["a", "x\ny"] for row in found) == 20 and len(found) == 21


def test_plan_of_ranges(spark):
    files = spark.createDataFrame([("file:/a", 10, None), ("file:/b", 0, ["T"])], "path string, length long, tabs array<string>")
    plan = split_plan(files, 10).orderBy("path").collect()
    assert [tuple(row) for row in plan] == [("file:/a", 0, 10, 0, False, None), ("file:/b", 0, 0, 0, False, ["T"])]
    ranges = [("f", n * 10, n * 10 + 10, 0, False, None) for n in range(5)]
    assert [len(p.ranges) for p in packed(ranges, 1 << 21)] == [2, 2, 1] and len(packed(ranges, 1 << 30)) == 1


def test_unclosed_quote_of_a_long_file_is_read_by_one_range(tmp_path):
    rng = random.Random(1)
    body = "".join(f"{rng.random()},{i}\n" for i in range(2000))
    (tmp_path / "f.csv").write_text("a,b\n" + body + '"open\n' + body)
    path = f"file:{tmp_path}/f.csv"
    size, found, is_open = inputs.length_of(path), [], False
    for start in range(0, size, 1000):
        with inputs.opened(path) as source:
            rows = list(split_rows(source, start, min(start + 1000, size), is_open))
        with inputs.opened(path) as source:
            scanned = scan_split(source, start, min(start + 1000, size))
        is_open = bool(scanned[3] if is_open else scanned[1])
        found.append(len(rows))
    assert sum(found) == 2002 and found[-1] == 0 and found[0] > 1


def test_format_pushes_sheets_down(spark, tmp_path):
    bad = "<row><c t='s'><v>99</v></c></row>"
    write_workbook(tmp_path / "w_1.xlsx", [(n, sheet_of([[n, str(i)] for i in range(5)])) for n in ("One", "Two")] + [("Bad", bad)])
    (tmp_path / "t_1.csv").write_text("a,b\n1,2\n")
    register(spark)
    plain = spark.read.format("report_grid").load(str(tmp_path))
    assert plain.where("sheet = 'Two'").count() == 5 and plain.count() == 12  # conditions leave the DataFrame as it is

    def pushed():
        return spark.read.format("report_grid").option("pushSheets", True).load(str(tmp_path))

    two = pushed().where("sheet = 'Two'")
    assert {row.cells[0] for row in two.collect()} == {"Two"} and two.count() == 5
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "= Two" not in plan.split("BatchScan")[0]
    assert pushed().where(F.col("sheet").isin("One", "None") & (F.col("row_no") > 2)).count() == 2
    assert pushed().where("sheet = 'One' and sheet = 'Two'").count() == 0


def test_workbooks_cut_at_any_byte(spark, tmp_path):
    sheets = [(f"S{k}", sheet_of([[f"{k}-{i}", str(i)] for i in range(30)])) for k in range(6)]
    write_workbook(tmp_path / "w_1.xlsx", sheets)
    whole = {(*r[:5], tuple(r.cells)) for r in read_grid(spark, [str(tmp_path / "w_1.xlsx")]).collect()}
    assert len(whole) == 180
    for size in (64, 700):
        found = [(*r[:5], tuple(r.cells)) for r in read_grid(spark, [str(tmp_path / "w_1.xlsx")], split_bytes=size).collect()]
        assert len(found) == 180 and set(found) == whole
