"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from lotframe.catalog import QUERIES, derived
from lotframe.operators import segment
from lotframe.plans.ingest import ingest

from reports import FILES, LOTS, grid_of

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_no_python_and_no_nested_loops(spark):
    text = plan(ingest(grid_of(spark, FILES)))
    assert not re.search("Python|MapInArrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_windows_stay_within_a_block_or_a_summary(spark):
    """Row-level windows name the block; only per-block summaries meet per file or table."""
    resolved = plan(segment.resolve_tables(segment.by_block(grid_of(spark, FILES))))
    for keys in re.findall(r"\], \[([^\]]*)\], \[row_no", resolved):
        assert "block" in keys
    assert resolved.count("REPARTITION_BY_COL") >= 1


def test_the_grid_is_shuffled_once(spark, tmp_path):
    grid_of(spark, FILES, 3).write.parquet(str(tmp_path / "grid"))
    lots = ingest(spark.read.parquet(str(tmp_path / "grid")))
    text = final_plan(lots)
    assert {tuple(row) for row in lots.collect()} == LOTS
    assert len(re.findall(r"(?<!Reused)Exchange [^\n]*REPARTITION_BY_COL", re.sub(r"ReusedExchange[^\n]*", "", text))) == 1
    assert "ReusedExchange" in text


def test_block_size_of_derived_reports_does_not_matter(spark):
    small = ingest(derived.report_grid(spark, SF_DIR, orders_per_block=200))
    lots = derived.lots(spark, SF_DIR).drop("layout", "size").distinct()
    assert small.exceptAll(lots).isEmpty() and lots.exceptAll(small).isEmpty()


@pytest.mark.parametrize("name, columns", [("numeric_coerce", {"c_custkey", "c_acctbal"}), ("header_normalise", {"p_partkey", "p_name", "p_brand", "p_type"})])
def test_scans_read_only_used_columns(spark, name, columns):
    text = plan(QUERIES[name](spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert {part.split(":")[0] for schema in schemas for part in schema.split(",")} == columns


def test_filters_reach_the_scan(spark):
    text = plan(derived.table(spark, SF_DIR, "lineitem").filter(F.col("l_suppkey") == 3).select("l_orderkey"))
    assert "EqualTo(l_suppkey,3)" in text


def parses(df):
    """Number tests and date parses in the optimised plan."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return text.count("infinity"), text.count("gettimestamp("), len(text)


def test_each_cell_of_a_lot_is_parsed_once(spark):
    numbers, dates, _ = parses(QUERIES["lots_with_metrics"](spark, SF_DIR))
    # Four numbers with a test for cells as they are and one for others; one date of 19 patterns, three of them tried first.
    assert numbers == 8 and dates == 22


def test_report_parses_its_ends_once(spark):
    numbers, dates, size = parses(QUERIES["metrics_report"](spark, SF_DIR))
    assert numbers == 8 and dates == 44 and size < 120_000


def test_levels_of_beta_read_positions_once(spark):
    text = plan(QUERIES["beta_holdings"](spark, SF_DIR))
    assert len(re.findall(r"FileScan parquet [^\n]*/lineitem", text)) == 1


def above(text, needle):
    """Operators between the line that holds ``needle`` and the root."""
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if needle in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789")), []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if own < depth and line.strip():
            found.append(line.strip(" :+-"))
            depth = own
    return found


def test_an_append_does_not_move_its_history(spark):
    found = QUERIES["append_dedupe"](spark, SF_DIR)
    text = plan(found)
    assert "Bucketed: true" in text
    operators = above(text, "Bucketed: true")
    assert any("ShuffledHashJoin" in line for line in operators)
    assert not any("Exchange" in line or line.split(" ")[0].endswith("Sort") for line in operators)
    lots = derived.lots(spark, SF_DIR).drop("layout", "size").distinct()
    assert found.count() == lots.count() and found.exceptAll(lots).isEmpty()
