"""Particle weights, resampling and draws from discrete distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.semantics import is_finite
from tabulon.operators.skew import running_total
from tabulon.workspace import Workspace


def _same_run(a: DataFrame, b: DataFrame, run: list[str]) -> DataFrame:
    """a joined to the one row of its run in b; null runs are runs."""
    right = b.select(*[F.col(c).alias(f"__{c}") for c in run], *[c for c in b.columns if c not in run])
    on = F.lit(True)
    for c in run:
        on = on & a[c].eqNullSafe(F.col(f"__{c}"))
    return a.join(right, on).drop(*[f"__{c}" for c in run])


def normalised_weights(df: DataFrame, run: list[str], log_weight: str, name: str = "weight") -> DataFrame:
    """Adds weights that sum to 1 in each run, from log-weights; uniform where none is finite. Non-finite ones get 0.

    Two grouped sums joined back to the rows: a run may be of any size.
    """
    good = F.when(is_finite(F.col(log_weight)), F.col(log_weight))
    topped = _same_run(df, df.groupBy(*run).agg(F.max(good).alias("__top"), F.count(F.lit(1)).alias("__n")), run)
    part = F.coalesce(F.exp(good - F.col("__top")), F.lit(0.0))
    sums = topped.groupBy(*run).agg(F.sum(part).alias("__sum"))
    whole = _same_run(topped, sums, run)
    return whole.withColumn(name, F.coalesce(F.try_divide(part, F.nullif(F.col("__sum"), F.lit(0.0))), 1 / F.col("__n"))).drop("__top", "__n", "__sum")


def effective_size(df: DataFrame, run: list[str], weight: str) -> DataFrame:
    """Per run 1 / sum of squared weights."""
    return df.groupBy(*run).agg(F.count(F.lit(1)).alias("particles"), (1 / F.nullif(F.sum(F.col(weight) ** 2), F.lit(0.0))).alias("ess"))


def systematic_resample(df: DataFrame, run: list[str], index: str, weight: str, u: float) -> DataFrame:
    """(run, slot, ancestor): slot k takes the particle whose cumulated weight passes (k + u) / n first.

    The slots a particle serves follow from its own interval of cumulated weight, so nothing is joined: n and the
    interval give their first and last number. The last interval ends at 1. Weights are cumulated over range partitions
    (running_total), so a run may be of any size; sums are taken to 12 digits. ``index`` numbers a run's particles.
    """
    ws = Workspace(df.sparkSession, "resample")
    summed = running_total(ws, df, run, [index], F.col(weight), "__cum")
    whole = _same_run(summed, df.groupBy(*run).agg(F.count(F.lit(1)).alias("__n"), F.max(index).alias("__last")), run)
    hi = F.when(F.col(index) == F.col("__last"), 1.0).otherwise(F.round("__cum", 12))
    lo = F.round(F.col("__cum") - F.coalesce(F.col(weight), F.lit(0.0)), 12)
    first, last = (F.ceil(c * F.col("__n") - u).cast("int") for c in (lo, hi))
    spans = whole.withColumn("__a", F.greatest(first, F.lit(0))).withColumn("__b", F.least(last, F.col("__n").cast("int")) - 1)
    return spans.where("__a <= __b").select(*run, F.explode(F.sequence("__a", "__b")).alias("slot"), F.col(index).alias("ancestor"))


def gather_blocks(resampled: DataFrame, atoms: DataFrame, run: list[str], particle: str) -> DataFrame:
    """All rows of each slot's ancestor, under the slot."""
    return resampled.join(atoms.withColumnRenamed(particle, "ancestor"), [*run, "ancestor"])


def tempered_power(step: Column, start: int, end: int, alpha: float) -> Column:
    return alpha * F.least(F.greatest((step - start) / F.lit(float(end - start)), F.lit(0.0)), F.lit(1.0))


def draw_categories(draws: DataFrame, table: DataFrame, by: list[str], category: str, weight: str, u: str) -> DataFrame:
    """draws with the category whose interval of cumulated weight holds u in [0, 1). Weights needn't sum to 1; their table is small per group."""
    w = Window.partitionBy(*by)
    order = w.orderBy(category)
    t = table.withColumn("__hi", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w))
    t = t.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__hi", category))).alias("__t"))
    pick = F.element_at(F.filter("__t", lambda x: x["__hi"] > F.col(u)), 1)[category]
    return draws.join(t, by).withColumn(category, F.coalesce(pick, F.element_at("__t", -1)[category])).drop("__t")


def conditional_marginals(df: DataFrame, given: str, value: str, values: list) -> DataFrame:
    """(given, value, probability) for every value of ``values``; uniform for groups with none of them."""
    seen = df.groupBy(given, value).agg(F.count(F.lit(1)).alias("n"))
    keys = df.select(given).distinct().withColumn(value, F.explode(F.array(*[F.lit(v) for v in values])))
    full = keys.join(seen, [given, value], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(given))
    return full.select(given, value, F.round(F.coalesce(F.try_divide("n", total), F.lit(1.0 / len(values))), 6).alias("probability"))
