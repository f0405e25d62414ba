"""Running results over blocks, by levels of bounded groups."""

import random
import re

import pytest

from lotframe.operators import prefix
from lotframe.operators.prefix import last_before, states_before
from lotframe.plans.ingest import ingest

from reports import FILES, LOTS, grid_of


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of(seed, n=150):
    rng = random.Random(seed)
    numbers = sorted(rng.sample(range(n * 3), n))
    return [(f"f{i % 2}", number, rng.random() < 0.15, rng.choice([None, None, f"s{i}"])) for i, number in enumerate(numbers)]


def plain_states(rows):
    found, state = {}, {}
    for key, number, reset, value in rows:
        found[key, number] = state.get(key)
        state[key] = value if reset else state[key] if state.get(key) is not None else value
    return found


@pytest.mark.parametrize("levels, group", [(0, 4), (1, 4), (2, 4), (3, 4), (1, 1000)])
def test_states_and_last_values_at_any_level(spark, monkeypatch, levels, group):
    monkeypatch.setattr(prefix, "GROUP_BLOCKS", group)
    rows = rows_of(levels)
    frame = spark.createDataFrame(rows, "k string, n long, r boolean, s string")
    found = states_before(frame, ["k"], "n", "r", ["s"], levels)
    assert found.columns == ["k", "n", "r", "s", "s_before"]
    assert {(r.k, r.n): r.s_before for r in found.collect()} == plain_states(rows)
    last = {(r.k, r.n): r.s_before for r in last_before(frame, ["k"], "n", ["s"], levels).collect()}
    assert last == {(k, n): next((s for q, m, _, s in reversed(rows) if q == k and m < n and s is not None), None) for k, n, _, _ in rows}


def test_no_window_meets_more_than_a_group(spark, monkeypatch):
    """Of 4,000 blocks in groups of 16, no window over blocks or over groups of any level has over 16 rows."""
    monkeypatch.setattr(prefix, "GROUP_BLOCKS", 16)
    frame = spark.range(4000).selectExpr("'f' as k", "id as n", "id % 700 = 3 as r", "if(id % 90 = 7, cast(id as string), null) as s")
    for scanned in (states_before(frame, ["k"], "n", "r", ["s"], 2), last_before(frame, ["k"], "n", ["s"], 2)):
        windows = re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)", plan(scanned))
        assert windows
        for keys in windows:
            *names, order = re.findall(r"(\w+)#", keys)
            # Over blocks by (key, group), over groups by (key, group of groups), and by key over 4,000 / 256 of those.
            least = {"n": "_group2", "_group2": "_group1"}.get(order)
            assert least in names if least else order == "_group1", keys
    assert -(-4000 // 256) <= 16


@pytest.mark.parametrize("levels", [0, 2])
def test_lots_do_not_depend_on_levels(spark, monkeypatch, levels):
    monkeypatch.setattr(prefix, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(prefix, "LEVELS", levels)
    found = ingest(grid_of(spark, FILES, 1)).collect()
    assert len(found) == len(LOTS) and {tuple(row) for row in found} == LOTS
