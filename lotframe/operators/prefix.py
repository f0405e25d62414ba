"""Running results over keys that may hold any share of the rows.

A window partitioned by such a key puts the whole key in one task. The helpers
here work on bounded blocks of consecutive rows first and carry one summary row
per block across blocks; summaries are scanned in groups, and those groups'
summaries again, so no task gets all blocks of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_row_number(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column | str], name: str
) -> DataFrame:
    """Adds the dense 1-based rank within ``keys``.

    ``block`` must not decrease along ``order`` and bounds the rows per task.
    """
    by_block = [*keys, block]
    counts = df.groupBy(*by_block).agg(F.count("*").alias("_in_block"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by_block, F.coalesce(F.sum("_in_block").over(earlier), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*by_block).orderBy(*order))
    ranked = df.withColumn("_local", local).join(offsets, by_block)
    return ranked.withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset")


def attach_by_key(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], spread: Column, fanout: int = 16
) -> DataFrame:
    """Left join of one-row-per-key ``facts`` onto rows with hot keys.

    The rows of a key are split by ``spread`` over ``fanout`` tasks and the few
    fact rows are repeated that often, so the largest task gets 1/fanout of the
    hottest key.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(fanout)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(fanout - 1)))
    return salted.join(facts.withColumn("_salt", copies), [*keys, "_salt"], "left").drop("_salt")


def shuffled(facts: DataFrame) -> DataFrame:
    """``facts`` for a join that must not send them to the driver.

    Spark judges what it may broadcast by compressed sizes, and there may be a row for each of millions of
    files or blocks. The facts of a task's rows are hashed there; the rows are neither moved nor sorted.
    """
    return facts.hint("shuffle_hash")


#: Blocks that meet in one window; a file's windows over blocks hold this many of the next level's summaries at most.
GROUP_BLOCKS = 4096
#: Levels between the blocks and the file: one is enough for files of 4096 x 4096 blocks.
LEVELS = 1

_UP_TO = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def states_before(
    summaries: DataFrame, keys: Sequence[str], order: str, reset: str, states: Sequence[str], levels: int | None = None
) -> DataFrame:
    """For each of the ``states`` its value before a row, as ``<state>_before``.

    Rows run along the integer ``order`` within ``keys``. A state stays what it is once it has a value, until
    a row with ``reset``, which starts it anew with the row's own value. Two stretches of rows combine to one of the
    same kind (does it reset, and what is its value at the end if it began without one), so rows are scanned in groups of
    ``GROUP_BLOCKS`` numbers, the groups' summaries likewise, and at last what is left per key.
    """
    levels = LEVELS if levels is None else levels
    group = f"_group{levels}" if levels else None
    grouped = summaries.withColumn(group, F.floor(F.col(order) / GROUP_BLOCKS).cast("long")) if group else summaries
    within = [*keys, *([group] if group else [])]
    along = Window.partitionBy(*within).orderBy(order)
    grouped = grouped.withColumn("_epoch", F.max(F.when(F.col(reset), F.col(order))).over(along.rowsBetween(*_UP_TO)))
    in_epoch = Window.partitionBy(*within, "_epoch").orderBy(order).rowsBetween(*_UP_TO)
    local = grouped.withColumns({f"{name}_end": F.first(name, ignorenulls=True).over(in_epoch) for name in states})
    local = local.withColumns({f"{name}_before": F.lag(f"{name}_end").over(along) for name in states})
    if not group:
        return local.drop("_epoch", *[f"{name}_end" for name in states])
    local = local.withColumn("_reset_before", F.coalesce(F.max(reset).over(along.rowsBetween(*_BEFORE)), F.lit(False)))
    tops = local.groupBy(*within).agg(
        F.max(reset).alias(reset), *[F.max_by(f"{name}_end", order).alias(name) for name in states]
    )
    tops = states_before(tops, keys, group, reset, states, levels - 1)
    carried = tops.select(*within, *[F.col(f"{name}_before").alias(f"{name}_carried") for name in states])
    joined = local.join(shuffled(carried), within, "left")

    def before(name: str) -> Column:
        own = F.col(f"{name}_before")
        return F.when(F.col("_reset_before"), own).otherwise(F.coalesce(F.col(f"{name}_carried"), own))

    return joined.withColumns({f"{name}_before": before(name) for name in states}).drop(
        group, "_epoch", "_reset_before", *[f"{name}_end" for name in states], *[f"{name}_carried" for name in states]
    )


def last_before(
    summaries: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], levels: int | None = None
) -> DataFrame:
    """For each of ``values`` the last one before a row that is not null, as ``<value>_before``; scanned by levels."""
    levels = LEVELS if levels is None else levels
    if not levels:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(*_BEFORE)
        return summaries.withColumns({f"{name}_before": F.last(name, ignorenulls=True).over(before) for name in values})
    group = f"_group{levels}"
    grouped = summaries.withColumn(group, F.floor(F.col(order) / GROUP_BLOCKS).cast("long"))
    within = [*keys, group]
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(*_BEFORE)
    local = grouped.withColumns({f"{name}_before": F.last(name, ignorenulls=True).over(before) for name in values})
    latest = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name) for name in values]
    tops = last_before(grouped.groupBy(*within).agg(*latest), keys, group, values, levels - 1)
    carried = tops.select(*within, *[F.col(f"{name}_before").alias(f"{name}_carried") for name in values])
    joined = local.join(shuffled(carried), within, "left")
    filled = {f"{name}_before": F.coalesce(f"{name}_before", f"{name}_carried") for name in values}
    return joined.withColumns(filled).drop(group, *[f"{name}_carried" for name in values])


def attach_totals(
    summaries: DataFrame, present: Column, keys: Sequence[str], order: str, folds: dict[str, tuple[Callable, str]]
) -> DataFrame:
    """Adds aggregates over ``keys`` of the rows that are ``present``: name to (``F.sum``, ``F.min`` or ``F.max``, column).

    Rows are folded in groups of ``GROUP_BLOCKS`` numbers, a window over the groups gives the whole, and a group's
    rows meet it by key and group. So the facts are as many as the groups, and no task gets all rows of a key.
    """
    grouped = summaries.withColumn("_group", F.floor(F.col(order) / GROUP_BLOCKS).cast("long"))
    parts = grouped.where(present).groupBy(*keys, "_group").agg(*[fold(of).alias(name) for name, (fold, of) in folds.items()])
    whole = Window.partitionBy(*keys)
    totals = parts.select(*keys, "_group", *[fold(name).over(whole).alias(name) for name, (fold, _) in folds.items()])
    return grouped.join(shuffled(totals), [*keys, "_group"], "left").drop("_group")
