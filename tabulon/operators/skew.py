"""Joins and running totals that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.workspace import Workspace

#: A key is heavy from this share of all rows on, so there are at most 1 / SHARE heavy keys.
SHARE = 1 / 400


def heavy_keys(counts: DataFrame, key: str, n: str, total: int, share: float = SHARE, least: int = 20_000) -> list:
    """Keys of a (key, count) table that hold at least ``share`` of ``total`` rows and ``least`` rows.

    At most 1 / share values come to the driver, whatever the data. Fewer than ``least`` rows have no heavy key: no job is run.
    """
    if total < least:
        return []
    floor = max(total * share, least)
    return [r[0] for r in counts.where((F.col(n) >= F.lit(floor)) & F.col(key).isNotNull()).select(key).collect()]


def join_unique(big: DataFrame, unique: DataFrame, key: str, heavy: list, how: str = "inner") -> DataFrame:
    """big JOIN unique ON key, where ``unique`` has one row a key and ``heavy`` lists the hot keys of big.

    Rows with a heavy key meet a broadcast of at most len(heavy) rows; the rest is shuffled. Null keys match nothing.
    """
    if not heavy:
        return big.join(unique, key, how)
    hot = F.col(key).isin(heavy)
    rest = big.where(~F.coalesce(hot, F.lit(False))).join(unique.where(~hot), key, how)
    return big.where(hot).join(F.broadcast(unique.where(hot)), key, how).unionByName(rest)


def join_salted(left: DataFrame, right: DataFrame, key: str, heavy: list, spread_by: str, salts: int = 32) -> DataFrame:
    """left JOIN right ON key (inner, many to many). Rows of left with a heavy key are spread over ``salts`` parts by the
    column ``spread_by``, which meet as many copies of the right rows of those keys; the rest is shuffled. Null keys match nothing."""
    if not heavy:
        return left.join(right, key)
    hot = F.col(key).isin(heavy)
    rest = left.where(~hot).join(right.where(~hot), key)
    parts = right.where(hot).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = left.where(hot).withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).join(parts, [key, "__salt"]).drop("__salt")
    return met.unionByName(rest)


def ordered_ids(ws: Workspace, values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct non-null values with a bigint each, in the values' order (not dense). Range partitioned: no global sort in one task."""
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    return ws.stage(distinct.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn(name, F.monotonically_increasing_id()))


def running_total(ws: Workspace, df: DataFrame, by: list[str], order: list[Column | str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """df with the sum of ``value`` over the rows before and including each one, within ``by``, in ``order`` (a total order)."""
    return running_totals(ws, df, by, order, {name: value}, parts)


def running_totals(ws: Workspace, df: DataFrame, by: list[str], order: list[Column | str], values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with the sum of each of ``values`` over the rows before and including each one, within ``by``, in ``order`` (a total order).

    A group may hold all rows: rows are range partitioned by group and order, each range sums its own rows, and ranges
    add the totals of the ranges before (one row for each range and group that share rows).
    Null values count 0. An empty table stays empty.
    """
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    temp = {n: f"__v{i}" for i, n in enumerate(values)}
    spread = df.withColumns({temp[n]: F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in values.items()})
    spread = spread.repartitionByRange(*([parts] if parts else []), *keys).withColumn("__range", F.spark_partition_id())
    staged = ws.stage(spread)
    sums = staged.groupBy("__range", *by).agg(*[F.sum(t).alias(f"{t}_sum") for t in temp.values()])
    same = Window.partitionBy(*by) if by else Window.partitionBy()
    earlier = same.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__range", *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *[F.coalesce(F.sum(f"{t}_sum").over(earlier), F.lit(0.0)).alias(f"{t}_before") for t in temp.values()])
    within = Window.partitionBy("__range", *by).orderBy(*[o if not isinstance(o, str) else F.col(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    on = staged["__range"] == before["__range"]
    for i, c in enumerate(by):
        on = on & staged[c].eqNullSafe(before[f"__by{i}"])
    joined = staged.join(before, on).drop(before["__range"], *[before[f"__by{i}"] for i in range(len(by))])
    done = joined.withColumns({n: F.sum(t).over(within) + F.col(f"{t}_before") for n, t in temp.items()})
    return done.drop("__range", *temp.values(), *[f"{t}_before" for t in temp.values()])
