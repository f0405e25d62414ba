import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lotframe.operators import clean, series
from lotframe.operators.prefix import attach_by_key, running_row_number
from lotframe.plans import jobs, metrics
from lotframe.sources.sinks import run_timestamp, write_report


def returns(spark, **named):
    rows = [(name, pos, r) for name, values in named.items() for pos, r in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, pos long, r double")


def by_id(df, column):
    return {row["series_id"]: row[column] for row in df.collect()}


def plain_beta(p, b):
    return statistics.covariance(p, b) / statistics.variance(b)


def test_beta_strict(spark):
    p = returns(spark, ok=[0.01, 0.02, -0.01], short=[1.0, 2.0], one=[1.0], flat=[1.0, 2.0], gap=[1.0, None, 2.0])
    b = returns(spark, ok=[0.02, 0.03, 0.0], short=[1.0, 2.0, 3.0], one=[1.0], flat=[3.0, 3.0], gap=[1.0, 2.0, 3.0])
    found = by_id(series.beta_strict(p, b), "beta")
    assert found.pop("ok") == pytest.approx(1.0)
    assert set(found.values()) == {None}


def test_beta_paired(spark):
    p = returns(spark, a=[0.01, None, 0.04, -0.02, 0.03], tiny=[0.1, 0.2, 0.3], few=[None, 1.0])
    b = returns(spark, a=[0.02, 0.01, None, 0.05, 0.01, 0.9], tiny=[1e-10, 2e-10, 3e-10], few=[1.0, 2.0])
    for ddof in (0, 1, 2):
        found = by_id(series.beta_paired(p, b, ddof), "beta")
        assert found["a"] == pytest.approx(plain_beta([0.01, -0.02, 0.03], [0.02, 0.05, 0.01]))
        assert found["tiny"] is None and found["few"] is None


def test_scale_detection(spark):
    p = returns(spark, a=[1.0, -2.0, 3.0], b=[0.01, 0.02, -0.03])
    b = returns(spark, a=[0.02, 0.03, -0.01], b=[1.5, 2.0, -1.0])
    found = by_id(series.beta_paired(p, b, detect_scale=True), "beta")
    assert found["a"] == pytest.approx(plain_beta([0.01, -0.02, 0.03], [0.02, 0.03, -0.01]))
    assert found["b"] == pytest.approx(plain_beta([0.01, 0.02, -0.03], [0.015, 0.02, -0.01]))
    scaled = {(row["series_id"], row["pos"]): row["r"] for row in series.scale_returns(p).collect()}
    assert scaled[("a", 1)] == pytest.approx(-0.02) and scaled[("b", 1)] == 0.02


def test_beta_truncated_shifts_after_nulls(spark, monkeypatch):
    monkeypatch.setattr(series, "POSITIONS_PER_BLOCK", 2)
    p, b = [0.1, None, 0.3, 0.2, 0.5, None, 0.7], [0.2, 0.1, None, 0.4]
    found = by_id(series.beta_truncated(returns(spark, a=p), returns(spark, a=b)), "beta")
    assert found["a"] == pytest.approx(plain_beta([0.1, 0.3, 0.2], [0.2, 0.1, 0.4]))


def test_holdings_beta(spark):
    rows = [("X", "50000", "1.2"), ("X", "30000", "0.9"), ("X", "20000", "1.1"), ("Y", "-1", "5"), ("Y", "n/a", "2"), ("Y", "0", "3")]
    positions = spark.createDataFrame(rows, "Account string, Value string, Beta string")
    found = {row["Account"]: row["beta"] for row in series.beta_by_weight(positions, ["Account"]).collect()}
    assert found["X"] == pytest.approx(1.09) and found["Y"] is None
    weights = positions.withColumnRenamed("Value", "Weight")
    assert series.beta_by_weight(weights).first()[0] == pytest.approx(1.09)
    assert series.beta_by_weight(positions.drop("Beta")).first()[0] is None
    assert series.beta_by_weight(positions.filter("false")).first()[0] is None


def test_growth_of_series(spark):
    values = returns(spark, a=[100.0, 110.0, 121.0], one=[1.0]).withColumnRenamed("r", "value")
    found = by_id(series.cagr_of_series(values, 12), "cagr")
    assert found["a"] == pytest.approx(2.1384283767) and found["one"] is None
    assert by_id(series.cagr_of_series(values, 0), "cagr")["a"] is None


def test_growth_of_dated_values(spark):
    rows = [
        ("a", 0, None, "5"), ("a", 1, "01/01/2020", "100"), ("a", 2, "2019-06-01", "1"), ("a", 3, "01/01/2022", "121"),
        ("back", 0, "2022-01-01", "100"), ("back", 1, "2021-01-01", "110"), ("comma", 0, "2020-01-01", "1,000"),
        ("comma", 1, "2021-01-01", "2,000"),
    ]
    found = by_id(series.cagr_of_dated_values(spark.createDataFrame(rows, "series_id string, pos long, date string, value string")), "cagr")
    assert found["a"] == pytest.approx(1.21 ** (365.25 / 731) - 1)
    assert found["back"] == pytest.approx(1.1**6 - 1)
    assert found["comma"] is None


def test_blockwise_rank_and_salted_join(spark):
    random.seed(3)
    rows = [(random.choice("aab"), pos) for pos in random.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "k string, pos long").withColumn("blk", F.floor(F.col("pos") / 50))
    found = {(row["k"], row["pos"]): row["rank"] for row in running_row_number(df, ["k"], "blk", ["pos"], "rank").collect()}
    for key in "ab":
        for rank, pos in enumerate(sorted(pos for k, pos in rows if k == key), 1):
            assert found[(key, pos)] == rank
    facts = spark.createDataFrame([("a", 1)], "k string, v int")
    joined = attach_by_key(df, facts, ["k"], F.col("pos")).collect()
    assert len(joined) == len(rows) and all(row["v"] == (1 if row["k"] == "a" else None) for row in joined)


def test_lot_metrics(spark):
    lots = spark.createDataFrame([("A", "7")], "Symbol string, Value string")
    assert metrics.with_metrics(lots, {"ENABLE": False}).columns == lots.columns
    assert metrics.with_metrics(lots, {"COMPUTE_CAGR_PER_ROW": False}).columns == lots.columns
    assert tuple(metrics.with_metrics(lots).first())[2:] == (None, None)
    one = returns(spark, a=[0.1, 0.2])
    assert metrics.with_metrics(lots, {"COMPUTE_CAGR_PER_ROW": False}, one, one).first()["Beta"] == pytest.approx(1.0)
    flat = returns(spark, a=[0.1, 0.1])
    assert metrics.with_metrics(lots, {}, flat, flat).first()["Beta"] is None


def test_report(spark, tmp_path):
    positions = spark.createDataFrame([("2", "1.5")], "Value string, Beta string")
    flat, good = returns(spark, a=[0.1, 0.1]), returns(spark, a=[0.1, 0.2, 0.4])
    report = metrics.metrics_report(spark, positions, flat, flat, inputs={"holdings": "h.csv"})
    row = report.first()
    assert row["metrics"]["beta"] == 1.5 and row["metrics"]["beta_method"] == "holdings" and row["metrics"]["cagr"] is None
    assert row["diagnostics"]["ok"] and row["inputs"]["holdings"] == "h.csv"
    row = metrics.metrics_report(spark, positions, good, good, fixed_growth=(1000, 1500, 3)).first()
    assert row["metrics"]["beta_method"] == "timeseries" and row["metrics"]["cagr"] == pytest.approx(0.1447142426)
    assert not metrics.metrics_report(spark).first()["diagnostics"]["ok"]
    paths = write_report(report, str(tmp_path), run_timestamp())
    assert spark.read.json(paths["json"]).first()["metrics"]["beta"] == 1.5
    text = spark.read.option("header", True).option("escape", '"').csv(paths["csv"]).first()["metrics"]
    assert json.loads(text)["beta_method"] == "holdings"


def test_series_files(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("day,return\n1,0.5\n2,x\n3,0.25\n")
    found = [tuple(row) for row in jobs.return_series(spark, str(path), "return").orderBy("pos").select("pos", "r").collect()]
    assert found == [(0, 0.5), (1, None), (2, 0.25)]
    assert [row["r"] for row in jobs.return_series(spark, str(path), "none").orderBy("pos").collect()] == [1.0, 2.0, 3.0]
    values = jobs.value_series(spark, str(path), "day", "return").orderBy("pos").collect()
    assert [(row["date"], row["value"]) for row in values] == [("1", "0.5"), ("2", "x"), ("3", "0.25")]
    with pytest.raises(KeyError):
        jobs.value_series(spark, str(path))


def test_report_of_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("r,x\n1.0,9\n2.0,9\n4.0,9\n")
    (tmp_path / "b.csv").write_text("r\n0.01\n0.02\n0.04\n")
    (tmp_path / "h.csv").write_text("Symbol,Value,Beta\nA,1,3\n")
    (tmp_path / "v.csv").write_text("Date,Value\n2020-01-01,100\n,7\n2021-01-01,110\n")
    at = {name: str(tmp_path / f"{name}.csv") for name in "pbhv"}
    paths = jobs.report(spark, str(tmp_path / "out"), at["h"], at["p"], at["b"], at["v"], timestamp="t")
    row = spark.read.json(paths["json"]).first()
    assert row["metrics"]["beta"] == pytest.approx(1.0) and row["metrics"]["beta_method"] == "timeseries"
    assert row["metrics"]["cagr"] == pytest.approx(1.1 ** (365.25 / 366) - 1)
    paths = jobs.report(spark, str(tmp_path / "out"), at["h"], "/none.csv", at["b"], at["b"], timestamp="u")
    row = spark.read.json(paths["json"]).first()
    assert row["metrics"]["beta"] == 3.0 and row["metrics"]["cagr"] is None and row["timestamp"] == "u"


def test_cleaning(spark):
    rows = [(" a ", "1"), (" a ", "1"), (" ", ""), (None, None), (None, "1"), (None, "1")]
    lots = spark.createDataFrame(rows, "`x y` string, `n#` string")
    cleaned, counts = jobs.clean_with_counts(lots, ["x y", "n#"])
    assert sorted(map(tuple, cleaned.collect()), key=str) == [(" a ", "1"), (None, "1")]
    assert {name: o.get["n_rows"] for name, o in counts.items()} == {"rows_in": 6, "rows_kept": 4, "lots_out": 2}
    placed = clean.clean_lots(lots.withColumn("at", F.monotonically_increasing_id()), ["x y", "n#"], ["at"])
    assert set(placed.columns) == {"x y", "n#", "first_seen"}
    appended = clean.append_lots(cleaned, lots, ["x y", "n#"])
    assert appended.count() == 2
