"""What keeps work on millions of reports off the driver and their rows in place."""

import re

import pytest
from pyspark.sql import functions as F

from lotframe.catalog import QUERIES, derived
from lotframe.operators import clean, prefix
from lotframe.operators.canonical import FULL_FIELDS
from lotframe.plans.ingest import parse_reports
from lotframe.sources import report_source
from lotframe.sources.report_source import grid_of_files, plan_slices, planned_ranges, split_plan

from reports import FILES, grid_of


def formatted(df):
    spark = df.sparkSession
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def tables(spark, tmp_path):
    """Two suppliers of each layout; a lot whose keys repeat with other content, and a part with two types."""
    lines = [(o, o % 5, o % 6, 1 + o % 3, 1.0 + o % 7, 10.0 * (1 + o % 9), f"1998-01-{1 + o % 28:02}") for o in range(60)]
    lines += [(7, 2, 1, 2, 9.0, 80.0, "1998-03-01"), (7, 2, 1, 2, 4.0, 80.0, "1998-02-01"), (7, 2, 1, 2, 4.0, 80.0, "1998-02-01")]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(60).selectExpr("id as o_orderkey", "id % 4 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    parts = [(p, f"T{p}", p, 5.0 + p) for p in range(5)] + [(2, "A2", 2, 7.0)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_no_fact_per_file_is_broadcast(spark):
    """Spark took the facts of 900,000 files for small, by their compressed size, and multiplied them by 16."""
    parsed = parse_reports(grid_of(spark, FILES), FULL_FIELDS)
    for frame in (parsed.fallback, parsed.lots, parsed.files):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin \[(file|sheet_no|_salt)", plan)
        assert "_salt" not in plan


def test_totals_by_groups(spark, monkeypatch):
    monkeypatch.setattr(prefix, "GROUP_BLOCKS", 4)
    rows = [(f"k{i % 2}" if i % 7 else None, i // 2, i % 5 or None) for i in range(60)]
    frame = spark.createDataFrame(rows, "k string, n long, v long")
    found = prefix.attach_totals(frame, F.col("k").isNotNull(), ["k"], "n", {"s": (F.sum, "v"), "m": (F.min, "v")})
    got = sorted(map(tuple, found.collect()), key=str)

    def of(k):
        values = [v for q, _, v in rows if q == k and v is not None]
        return (None, None) if k is None else (sum(values), min(values))

    assert found.columns == ["k", "n", "v", "s", "m"]
    assert got == sorted(((k, n, v, *of(k)) for k, n, v in rows), key=str)


def test_stored_rows_are_not_moved(spark, tables):
    """F4 to F20: the cells of the report table are shuffled by no step that works on blocks, tables or files."""
    for name in ("canonical_projection", "align_rows", "union_by_name", "symbol_group_realign", "hybrid_realign"):
        plan = formatted(QUERIES[name](spark, tables))
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert moved and not any("cells#" in columns for columns in moved), name


def test_report_rows_are_in_the_order_of_their_text_where_keys_repeat(spark, tables):
    body = derived.report_grid(spark, tables).where("block > 0").orderBy("file", "block", "row_no").collect()
    lots = ["|".join(r.cells) for r in body if r.file == "/reports/B1_2002.csv" and r.cells[4:5] == ["80.00"] and r.cells[1][:2] in ("02", "03")]
    # Part 2 has two types, so each of the three lots is there twice, in the order of its joined cells.
    assert len(lots) == 6 and lots == sorted(lots)
    numbers = {}
    for row in body:
        numbers.setdefault((row.file, row.block), []).append(row.row_no % (1 << 32))
    assert all(found == list(range(1, len(found) + 1)) for found in numbers.values())


def test_block_files_are_told_not_listed(spark, tmp_path, monkeypatch):
    """a row per file, and partitions that name rows of the plan instead of holding paths."""
    monkeypatch.setattr(report_source, "PLAN_ROWS", 3)
    rows = [(f"/in/R{r}.csv", b, b * 10 + i, f"{r},{b},{i}") for r in range(5) for b in range(3) for i in range(4)]
    rows += [(None, 1, 1, None)]
    frame = spark.createDataFrame(rows, "file string, block long, row_no long, value string").repartition(3)
    frame = frame.withColumn("sheet_no", F.lit(0))
    files = derived.write_texts(frame, str(tmp_path / "texts"))
    assert files.count() == 16
    grid = grid_of_files(files.withColumn("tabs", F.lit(None).cast("array<string>")), split_bytes=1 << 20)
    got = {(r.file.rsplit("/", 1)[1], r.row_no, tuple(r.cells)) for r in grid.collect()}
    want = {(f"R{r}-{b}.txt", i, (str(r), str(b), str(i))) for r in range(5) for b in range(3) for i in range(4)}
    assert got == want | {("__HIVE_DEFAULT_PARTITION__-1.txt", 0, ())}

    plan = split_plan(files.withColumn("tabs", F.lit(None).cast("array<string>")))
    folder = str(tmp_path / "plan")
    plan.select(*report_source.PLAN).write.option("maxRecordsPerFile", 3).parquet(folder)
    slices = [part.slices for part in plan_slices(folder, 5 << 20)]
    assert len(slices) >= 3 and all(part for part in slices)
    paths = [one[0] for part in slices for one in planned_ranges(folder, part)]
    assert sorted(paths) == sorted(r.path for r in files.collect())


def test_the_grid_of_stored_reports_is_passed_once_for_open_tables(spark, tables):
    """F14 to F18: the rows worked out anew which tables are open where blocks begin, in a pass of their own."""
    lots = parse_reports(
        derived.report_table(spark, tables), FULL_FIELDS, stored_by=derived.report_buckets(spark, tables)
    ).lots
    assert len(re.findall(r"\n\(\d+\) Scan parquet [^\n]*lotframe_", formatted(lots))) <= 2  # the rows and the key-values
    found = parse_reports(derived.report_table(spark, tables), FULL_FIELDS).lots
    assert lots.count() > 60 and lots.exceptAll(found).isEmpty() and found.exceptAll(lots).isEmpty()


def test_a_stage_of_wide_cleaning_is_no_method_that_the_jvm_interprets(spark):
    """Spark let methods grow to eight times what the JVM compiles."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        for given, then in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(limit, given)
            clean.clean_lots(spark.createDataFrame([("A", " ")], "a string, b string"), ("a", "b"))
            assert spark.conf.get(limit) == then
    finally:
        spark.conf.set(limit, before)


def test_an_append_shuffles_new_lots_once_and_facts_are_joined_once(spark, tables, monkeypatch):
    """new lots were shuffled to be told apart and again to their buckets, and the facts joined for either run."""
    again = QUERIES["append_dedupe"](spark, tables)
    text = formatted(again)
    assert len(re.findall(r"\n\(\d+\) Exchange", text)) == 1 and "lineitem.parquet" not in text
    lots = derived.lots(spark, tables).where("size <= 30 or size >= 15").drop("layout", "size").distinct()
    assert again.count() == lots.count() and again.exceptAll(lots).isEmpty()
    # Lots that share a key are told apart, whoever has them.
    monkeypatch.setattr(clean, "lot_key", lambda fields, made_of=None: F.lit(1).cast("long"))
    types = "a string, b string"
    old = spark.createDataFrame([("A", None), ("B", "1")], types).withColumn("lot_key", F.lit(1).cast("long"))
    new = spark.createDataFrame([("B", "1"), ("C", None), ("C", " "), ("D", "2"), (None, " ")], types)
    joined = clean.append_to_buckets(old, new, ("a", "b"), 3)
    assert sorted(map(tuple, joined.collect()), key=str) == [("A", None), ("B", "1"), ("C", None), ("D", "2")]
