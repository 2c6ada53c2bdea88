"""Ordered series: minima, label exchanges, neighbours, interval and as-of joins, carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_minima(df: DataFrame, by: list[str], order: list[str], value: str, tolerance: float | None = None) -> DataFrame:
    """Inner rows whose value is at most the one before and less than the one after, and below ``tolerance``.

    Adds previous and next value. A series is one logical sequence (a branch, a user), so it is ordered within its group.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))
    low = (F.col(value) <= F.col("previous")) & (F.col(value) < F.col("next"))
    return df.where(low & (F.col(value) < tolerance) if tolerance is not None else low)


def label_exchanges(df: DataFrame, by: list[str], order: list[str], lower: str, upper: str) -> DataFrame:
    """Rows where the two labels change places from the row before to the row after."""
    w = Window.partitionBy(*by).orderBy(*order)
    for c in (lower, upper):
        df = df.withColumn(f"previous_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
    crossed = (F.col(f"previous_{lower}") == F.col(f"next_{upper}")) & (F.col(f"previous_{upper}") == F.col(f"next_{lower}"))
    return df.where(crossed & (F.col(f"previous_{lower}") != F.col(f"previous_{upper}")))


def adjacent_pairs(df: DataFrame, by: list[str], index: str, value: str) -> DataFrame:
    """Neighbours whose indices differ by one: (by, index, value, next_value, gap)."""
    w = Window.partitionBy(*by).orderBy(index)
    paired = df.withColumn("next_index", F.lead(index).over(w)).withColumn("next_value", F.lead(value).over(w))
    return paired.where(F.col("next_index") == F.col(index) + 1).withColumn("gap", F.abs(F.col("next_value") - F.col(value))).drop("next_index")


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """left with the right ``value`` of the latest right row at or before ``at``; null if there is none.

    Both sides are sorted once by (by, at) and the value is carried forward: no range join.
    """
    r = right.select(*by, at, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    cols = [c for c in left.columns if c not in (*by, at)]
    both = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(at), F.col("__side")).rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumn(name, F.last(F.when(F.col("__side") == 0, F.struct("__v")), ignorenulls=True).over(w))
    return done.where("__side = 1").select(*by, at, *cols, F.col(f"{name}.__v").alias(name))


def interval_first(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, order: str, keep: str) -> DataFrame:
    """points with ``keep`` of the first interval (least ``order``) of their group that holds them, ends included.

    Distinct (group, place) are met with the group's intervals once and joined back by value, so repeated points cost
    nothing and no row needs a number. Points of no group, or without a place, get null.
    """
    places = points.select(*by, at).distinct()
    hit = places.join(intervals.select(*by, start, end, order, keep), by).where(F.col(at).between(F.col(start), F.col(end)))
    best = hit.groupBy(*by, at).agg(F.min_by(keep, order).alias(keep))
    return points.join(best, [*by, at], "left").select(*points.columns, keep)


def carry_forward(df: DataFrame, by: list[str], order: str, header: Column, name: str) -> DataFrame:
    """Adds the latest non-null ``header`` at or before each row of its group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(header, ignorenulls=True).over(w))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line)"""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


#: A line of a relaxation log: optimiser, step, clock, energy, force.
LOG_LINE = r"^\s*(FIRE|BFGS|LBFGS):?\s+(\d+)\s+(\d\d:\d\d:\d\d)\s+(-?[\d.]+(?:[eE][+-]?\d+)?)\*?\s+(-?[\d.]+(?:[eE][+-]?\d+)?)"


def last_log_step(lines: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """Per text with log lines the last one's step, energy and force, and whether it converged."""
    hit = lambda g: F.regexp_extract("line", LOG_LINE, g)
    found = lines.where(F.col("line").rlike(LOG_LINE)).select(key, "line_no", hit(1).alias("optimiser"), hit(2).cast("int").alias("step"), hit(4).try_cast("double").alias("energy"), hit(5).try_cast("double").alias("fmax"))
    last = found.groupBy(key).agg(F.max_by(F.struct("optimiser", "step", "energy", "fmax"), "line_no").alias("l"), F.count(F.lit(1)).alias("log_lines"))
    return last.select(key, "log_lines", "l.optimiser", "l.step", "l.energy", "l.fmax", (F.col("l.fmax") <= tolerance).alias("converged"))
