import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lotframe.operators import canonical, classify, headers, keyvalues, segment, union
from lotframe.plans.audit import ingest_audit
from lotframe.plans.ingest import ingest, parse_reports
from lotframe.plans.metrics import metrics_report, metrics_reports
from lotframe.sources.mapping import DEFAULT_SYNONYMS, load_mapping, mapping_frame, resolve_mapping, resolve_variants

from reports import FILES, FLAT, GRID_SCHEMA, GROUPED, HYBRID, LOTS, SEVERAL, grid_of


def rows_of(df):
    return {tuple(row) for row in df.collect()}


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_layouts(spark, block_rows):
    found = ingest(grid_of(spark, FILES, block_rows)).collect()
    assert len(found) == len(LOTS)
    assert {tuple(row) for row in found} == LOTS


def test_same_reports_twice_and_more_blank_rows_change_nothing(spark):
    spaced = {name: text.replace("\n\n", "\n \n,,\n\n") for name, text in FILES.items()}
    again = {"AA_2.csv": FLAT}
    assert rows_of(ingest(grid_of(spark, {**spaced, **again}, 4))) == LOTS


def test_default_fields_and_symbol_required(spark):
    grid = grid_of(spark, {"AA_1.csv": FLAT})
    assert ingest(grid, canonical.DEFAULT_FIELDS).columns == canonical.DEFAULT_FIELDS
    assert rows_of(ingest(grid, ["Account", "Value"])) == set()
    assert rows_of(ingest(grid, ["Symbol", "Asset Type", "Type"])) == {
        ("AAA", None, "Equity"), ("BBB", None, "Equity"),
    }


def test_segments_match_a_scan_in_order(spark):
    """Every block size against a plain loop, with one-cell rows and long tables."""
    texts = {
        "a.csv": "t\n\nx\ny\na,b\nc\nd,e,f\n\n\nz\n\nq,r\n1,2\n",
        "b.csv": "a,b\n" + "1,2\n" * 7 + "\nonly\none\n\n ,\nh,i\n",
        "c.csv": "\n\n",
    }
    expected = set()
    for name, text in texts.items():
        start = None
        for row_no, line in enumerate(text.split("\n")[:-1]):
            cells = line.split(",") if line else []
            if not "".join(cells).strip():
                start = None
                continue
            if start is None and len(cells) != 1:
                start = row_no
            if start is not None:
                expected.add((f"/in/{name}", row_no, start))
    for block_rows in (1, 2, 3, 5, 100):
        blocked = segment.by_block(grid_of(spark, texts, block_rows))
        assert rows_of(segment.resolve_tables(blocked).select("file", "row_no", "table_row")) == expected


def test_workbook_rows_have_no_titles(spark):
    grid = grid_of(spark, {"a.xlsx": "title\nh,i\n1,2\nnan,NaN\nk,l\n"}, sheet_no=1)
    found = segment.resolve_tables(segment.by_block(grid))
    assert rows_of(found.select("row_no", "table_row")) == {(0, 0), (1, 0), (2, 0), (4, 4)}


def test_headers_samples_and_alignment(spark):
    text = "a,b,c\n1\n1,2,3,4\n5,6,7\n\nonly,header\n\nx,y\n8,9\n"
    rows = segment.resolve_tables(segment.by_block(grid_of(spark, {"f.csv": text}, 2)))
    assert rows_of(segment.table_headers(rows).select("table_no", "table_row", "n_rows")) == {(1, 0, 3), (3, 7, 1)}
    aligned = segment.align_rows(rows).select("row_no", F.array_join("cells", "|"))
    assert rows_of(aligned) == {(1, "1||"), (2, "1|2|3"), (3, "5|6|7"), (8, "8|9")}
    assert rows_of(segment.table_samples(rows).select("row_no", "sample_no")) == {(1, 1), (2, 2), (8, 1)}


def test_key_values(spark):
    text = "Acct No: 1; Symbol = S\na:b=c,ticker:\nSYMBOL: x:y\nacc-no = 2\nunknown: 3\n"
    pairs = keyvalues.key_value_pairs(grid_of(spark, {"f.csv": text}), mapping_frame(spark, DEFAULT_SYNONYMS))
    assert rows_of(pairs.select("row_no", "field", "value")) == {
        (0, "Account#", "1"), (0, "Symbol", "S"), (2, "Symbol", "x:y"), (3, "Account#", "2"),
    }
    assert rows_of(keyvalues.key_value_maps(pairs).select("kv.Symbol", "kv.Account#")) == {("x:y", "2")}


def test_key_values_fill_absent_columns_only(spark):
    text = "Account: K\nValue: 9\nSymbol,Value\nA,\nB,2\n"
    fields = ["Account", "Symbol", "Value"]
    assert rows_of(ingest(grid_of(spark, {"f.csv": text}), fields)) == {("K", "A", None), ("K", "B", "2")}


def test_file_without_tables(spark):
    grid = grid_of(spark, {"AA_1.csv": "Account: K; ticker: T\n", "BB_1.csv": "\n"})
    fields = ["Broker", "Account", "Symbol"]
    assert rows_of(ingest(grid, fields)) == {("AA", "K", "T"), ("BB", None, None)}
    assert rows_of(ingest(grid, ["Account", "Symbol"])) == {("K", "T")}


def test_flat_table_with_a_footer_is_read_as_grouped(spark):
    text = "Symbol,Description,Quantity\nA,x,1\nB,y,2\n,note,3\n"
    assert rows_of(ingest(grid_of(spark, {"f.csv": text}), ["Symbol", "Account", "Quantity"])) == {("B", "note", "3")}
    total = text.replace("note", "Total")
    assert len(rows_of(ingest(grid_of(spark, {"f.csv": total}), ["Symbol", "Account", "Quantity"]))) == 3


def test_grouped_holdings_in_a_hybrid_file(spark):
    text = (
        "Account,Cash\nACC,1\n\nSymbol,Date Acquired,Qty,Description\nA,,3,Alpha\n,01/01/2020,1,J1\n,,2,Cash\n"
        "\nSymbol,Purchase Date,Quantity\nB,,9\n01/02/2020,,4\n,x,5\n"
    )
    for block_rows in (1, 2, 100):
        found = ingest(grid_of(spark, {"f.csv": text}, block_rows), ["Account", "Symbol", "Quantity"])
        assert rows_of(found) == {("J1", "A", "1"), ("ACC", "B", "4"), ("ACC", "B", "5")}


def test_account_summary_order(spark):
    """The first summary is blank, the second names the account, the third is holdings too."""
    text = (
        "Account,Cash\n ,1\n\nAccount,Cash\nACC,1\n\n"
        "Symbol,Purchase Date,Quantity,Account,Cash\nB,,9,Z,\n,01/02/2020,4,Y,\n"
    )
    parsed = parse_reports(grid_of(spark, {"f.csv": text}), ["Account", "Symbol", "Quantity"])
    assert rows_of(parsed.files.select("is_hybrid", "account", "has_lots")) == {(True, "ACC", True)}
    assert rows_of(parsed.lots.select("Account", "Symbol", "Quantity")) == {("Y", "B", "4")}


def test_duplicate_headers(spark):
    text = "Symbol,CUSIP,Qty,Shares\nA,C1,1,2\n"
    assert rows_of(ingest(grid_of(spark, {"f.csv": text}), ["Symbol", "Quantity"])) == {("A", "1")}
    other = "Symbol,Quantity\nB,3\n"
    assert ("B", "3") in rows_of(ingest(grid_of(spark, {"f.csv": f"{text}\n{other}"}), ["Symbol", "Quantity"]))


def test_table_predicates(spark):
    grid = grid_of(spark, {"f.csv": " Account ,Cash Balance\n1,2\n\nsymbol,Purchase Date,QTY\n\nAcct,Total Gain\n1,2\n"})
    facts = headers.header_facts(resolve_mapping(spark, DEFAULT_SYNONYMS), ["Symbol", "Type"])
    rows = segment.resolve_tables(segment.by_block(grid), facts)
    kinds = classify.table_kinds(classify.decide_tables(classify.summarise_segments(classify.row_roles(rows))))
    assert rows_of(kinds.select("table_row", "is_summary", "is_holdings", "n_rows")) == {
        (0, True, False, 1), (3, False, True, 0), (5, False, False, 1),
    }


def test_mapping(spark, tmp_path):
    assert resolve_mapping(spark, DEFAULT_SYNONYMS)["acct"] == "Account#"
    assert len(resolve_mapping(spark, DEFAULT_SYNONYMS)) == 51
    path = tmp_path / "mapping.json"
    path.write_text('{"Symbol": ["Tick_er"], "my-qty": "Quantity", "TICK ER": "Account"}')
    assert resolve_mapping(spark, load_mapping(spark, str(path))) == {"tick er": "Account", "my qty": "Quantity"}
    assert load_mapping(spark, str(tmp_path / "none.json")) == {}
    path.write_text("[")
    assert load_mapping(spark, str(path)) == {}
    raw = spark.createDataFrame([(0, " A_b ", "X"), (1, "a B", "Y")], "ord int, raw string, canonical string")
    assert rows_of(resolve_variants(raw)) == {("a b", "Y")}


def test_field_lists():
    assert canonical.parse_fields(None) == canonical.DEFAULT_FIELDS
    assert canonical.parse_fields('["A", " B "]') == ["A", "B"]
    assert canonical.parse_fields("A, B,,") == ["A", "B"]
    assert canonical.parse_fields(["A"]) == ["A"]


def test_audit(spark):
    files = {"AA_1.csv": FLAT, "BB_1.csv": SEVERAL, "CC_1.csv": HYBRID, "DD_1.csv": GROUPED}
    found = {row["file"]: row for row in ingest_audit(grid_of(spark, files, 3)).collect()}
    flat, hybrid = found["/in/AA_1.csv"], found["/in/CC_1.csv"]
    assert (flat["structure"], flat["tables"], flat["rows_extracted"], flat["duplicates_removed"]) == ("standard", 1, 3, 1)
    assert (hybrid["structure"], hybrid["tables"], hybrid["table_rows"], hybrid["lots"]) == ("hybrid", 2, 7, 3)
    assert found["/in/BB_1.csv"]["key_values"] == 1


_CELL = st.text(alphabet="abcXYZ019 .-", min_size=1, max_size=8).map(str.strip).filter(bool)
_LOT = st.tuples(_CELL, st.integers(1, 10**6).map(str), st.dates().map(lambda d: d.strftime("%m/%d/%Y")))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(lots=st.dictionaries(st.text(alphabet="ABCDE", min_size=1, max_size=4), st.lists(_LOT, min_size=1, max_size=4), min_size=1, max_size=6), block_rows=st.integers(1, 7))
def test_rendered_lots_come_back(spark, lots, block_rows):
    flat = [["Account", "Ticker", "Shares", "Purchase Date"]]
    hybrid = [["Account", "Available"], ["ACC", "1"], [], ["Symbol", "Date Acquired", "Qty"]]
    grouped = [["Description", "Symbol", "Quantity", "Purchase Date"]]
    for symbol, entries in lots.items():
        hybrid.append([symbol, "", "9"])
        grouped.append(["about", symbol, "9", ""])
        for account, quantity, day in entries:
            flat.append([account, symbol, quantity, day])
            hybrid.append(["", day, quantity])
            grouped.append([account, "", quantity, day])
    wanted = [(account, symbol, q, d) for symbol, entries in lots.items() for account, q, d in entries]
    fields = ["Broker", "Account", "Symbol", "Quantity", "Acquisition Date"]
    rows = [
        (f"/in/{name}_1.csv", 0, i // block_rows, i, cells)
        for name, grid in (("F", flat), ("H", hybrid), ("G", grouped))
        for i, cells in enumerate(grid)
    ]
    found = rows_of(ingest(spark.createDataFrame(rows, GRID_SCHEMA), fields))
    headings = {"total", "cash", "cash equivalent", "mutual fund"}
    expected = {("F", *lot) for lot in wanted} | {("H", "ACC", *lot[1:]) for lot in wanted}
    expected |= {("G", *lot) for lot in wanted if lot[0].lower() not in headings}
    assert found == expected


def test_raw_tables_unite_by_header(spark):
    rows = [
        ("f", 0, ["a", "b", "a"]), ("f", 1, ["1", "2", "3"]), ("f", 2, ["4"]), ("f", 3, []),
        ("f", 4, ["b", "a#2", "A"]), ("f", 5, ["5", "6", "7", "8"]), ("g", 0, ["a", ""]), ("g", 1, ["9", "10"]),
    ]
    grid = spark.createDataFrame(
        [(file, 0, 0, number, cells) for file, number, cells in rows],
        "file string, sheet_no int, block long, row_no long, cells array<string>",
    )
    tables = segment.resolve_tables(segment.by_block(grid), union.column_names(F.col("cells")))
    names = union.column_list(union.folded_columns(tables))
    assert names == ["a", "b", "a\x1f2", "a#2", "A", ""]
    wide = union.widened(union.rows_by_name(tables), names)
    assert wide.schema["row"].dataType.names == ["a", "b", "a#2", "a#2#", "A", ""]
    found = {(r.file, r.row_no): tuple(r.row) for r in wide.collect()}
    assert found == {
        ("f", 1): ("1", "2", "3", None, None, None), ("f", 2): ("4", "", "", None, None, None),
        ("f", 5): (None, "5", None, "6", "7", None), ("g", 1): ("9", None, None, None, None, "10"),
    }
    with pytest.raises(ValueError, match="over 2 columns"):
        union.column_list(union.folded_columns(tables), 2)


def test_reports_of_many_portfolios(spark):
    returns = "k string, pos long, r double"
    p = spark.createDataFrame([(k, i, 0.01 * i * s) for k, s in (("x", 1.0), ("y", 200.0)) for i in range(5)], returns)
    b = spark.createDataFrame([(k, i, 0.01 * i) for k in "xyz" for i in range(5)], returns)
    held = spark.createDataFrame([("x", "9", "1"), ("z", "2", "3"), ("z", "4", "1"), ("w", "n/a", "1")], "k string, Beta string, Value string")
    values = spark.createDataFrame([("z", 0, "2020-01-01", "100"), ("z", 1, "1/1/2021", "110"), ("v", 0, "2020-01-01", "1")], "k string, pos long, date string, value string")
    found = {r.k: (r.metrics.beta, r.metrics.beta_method, r.metrics.cagr, r.diagnostics.ok) for r in metrics_reports(held, p, b, values, key="k").collect()}
    assert set(found) == set("vwxyz")
    assert found["x"][:2] == (pytest.approx(1.0), "timeseries") and found["y"][0] == pytest.approx(2.0)
    assert found["z"][:2] == (pytest.approx(2.5), "holdings") and found["z"][2] == pytest.approx(1.1 ** (365.25 / 366) - 1)
    assert found["w"] == (None, None, None, False) and found["v"][2:] == (0.0, True)
    one = metrics_report(spark, held.where("k = 'z'"), p.where("k = 'z'").withColumnRenamed("k", "series_id"), b.where("k = 'z'").withColumnRenamed("k", "series_id")).first()
    assert one.metrics.beta == pytest.approx(found["z"][0])
    with pytest.raises(ValueError):
        metrics_reports()
