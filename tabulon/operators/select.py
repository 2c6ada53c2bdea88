"""Scores, budgets and capped selections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiobjective_score(first: Column, second: Column, u1: Column, u2: Column) -> Column:
    """Geometric mean of two probabilities (missing: 0.5) plus a twentieth of the greater uncertainty (missing: 0)."""
    a, b = F.coalesce(first, F.lit(0.5)), F.coalesce(second, F.lit(0.5))
    return F.sqrt(F.greatest(a, F.lit(1e-9)) * F.greatest(b, F.lit(1e-9))) + 0.05 * F.greatest(F.coalesce(u1, F.lit(0.0)), F.coalesce(u2, F.lit(0.0)))


def check_budget(budget: int, low: int = 500, high: int = 2000) -> None:
    if not low <= budget <= high:
        raise ValueError(f"the budget must lie between {low} and {high}")


def check_analysis(tolerance: float, window: float, spacegroup: int | None = None) -> None:
    """Raises unless both are positive, the gap tolerance is less than the energy window, and the space group is one of 1..230."""
    if not (tolerance > 0 and window > 0 and tolerance < window):
        raise ValueError("tolerance and window must be positive, the tolerance less than the window")
    if spacegroup is not None and not 1 <= spacegroup <= 230:
        raise ValueError(f"there is no space group {spacegroup}")


def top_ranked(df: DataFrame, order: list[Column], budget: int, rank: str = "rank") -> DataFrame:
    """The first ``budget`` rows with their rank. Only they are numbered in one task; finding them is a distributed top-k."""
    best = df.orderBy(*order).limit(budget)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def capped_fill(df: DataFrame, group: list[str], order: list[Column], cap: int, budget: int, rank: str = "rank") -> DataFrame:
    """``budget`` rows: first in order with at most ``cap`` a group, then the others in order until full.

    ``cap_relaxed`` marks the second kind. Per group, rows beyond the budget can't be chosen, so a group limit comes first.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ranked = df.withColumn("__place", place).where(F.col("__place") <= budget).withColumn("cap_relaxed", F.col("__place") > cap)
    chosen = ranked.orderBy(F.col("cap_relaxed"), *order).limit(budget)
    return chosen.withColumn(rank, F.row_number().over(Window.orderBy(F.col("cap_relaxed"), *order))).drop("__place")


def balanced_assignment(df: DataFrame, rank: str, options: str, name: str, most: int = 2000) -> DataFrame:
    """In rank order each row takes its least used option, of equals the smallest; rows without options take null.

    The rule is sequential, so it runs in one task over a selection of at most ``most`` rows.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"balanced assignment is for selections of at most {most} rows")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        chosen = []
        for opts in pdf.sort_values(rank)[options]:
            pick = min(sorted(o for o in opts if o is not None), key=lambda o: used.get(o, 0), default=None) if opts is not None else None
            if pick is not None:
                used[pick] = used.get(pick, 0) + 1
            chosen.append(pick)
        out = pdf.sort_values(rank)[[rank]]
        return out.assign(**{name: chosen})

    picks = df.select(rank, options, F.lit("all").alias("__all")).groupBy("__all").applyInPandas(assign, f"{rank} int, {name} string")
    return df.join(F.broadcast(picks), rank)  # at most ``most`` rows


def matched_targets(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Number of rows of each key combination, at most ``cap``; rows with a null key are left out."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("count"))
