"""Validity flags, classifications and rates of candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.semantics import is_finite, not_false, rate, truthy


def geometry_valid(volume: Column, distance: Column, per_unit: Column, least_distance: float = 0.6, low: float = 1.0, high: float = 500.0) -> Column:
    """Finite, positive volume, no two sites too close, volume per unit within bounds. Null or NaN input is invalid."""
    return is_finite(volume) & is_finite(distance) & truthy((volume > 0) & (distance >= least_distance) & per_unit.between(low, high))


def flag_cascade(df: DataFrame, parsed: str, geometry: str, symmetry: str, elements: str, formula: str) -> DataFrame:
    """Adds valid_structure, condition_valid and stoichiometry_valid, each a part of the one before.

    Parse, geometry and symmetry must be true; element and formula agreement only must not be false.
    """
    valid = truthy(F.col(parsed)) & truthy(F.col(geometry)) & truthy(F.col(symmetry))
    df = df.withColumn("valid_structure", valid)
    df = df.withColumn("condition_valid", F.col("valid_structure") & not_false(F.col(elements)))
    return df.withColumn("stoichiometry_valid", F.col("condition_valid") & not_false(F.col(formula)))


def classification(parsed: Column, symmetry: Column, geometry: Column, elements: Column, same_group: Column) -> Column:
    """The first reason that applies, else whether the space group was kept."""
    return (
        F.when(~truthy(parsed), "parse_failed")
        .when(~truthy(symmetry), "symmetry_failed")
        .when(~truthy(geometry), "invalid_geometry")
        .when(~not_false(elements), "composition_changed")
        .when(truthy(same_group), "target_spacegroup_retained")
        .otherwise("symmetry_changed")
    )


def relaxation_state(energy: Column, force: Column, tolerance: float = 0.1) -> tuple[Column, Column]:
    """(diverged, converged): diverged if energy or force is not finite or absurdly large; null inputs give null."""
    diverged = ~is_finite(energy) | (F.abs(energy) >= 1e6) | ~is_finite(force) | (F.abs(force) >= 1e5)
    known = energy.isNotNull() & force.isNotNull()
    return F.when(known, diverged), F.when(known, ~diverged & (force <= tolerance))


def flag_counts(df: DataFrame, flags: dict[str, Column], rates: bool = True, digits: int | None = 6) -> DataFrame:
    """One row: total, and of each flag the number of true values (null isn't) and its rate; all in one pass."""
    return _flagged(df.agg, flags, rates, digits)


def group_rates(df: DataFrame, group: Column, name: str, flags: dict[str, Column], digits: int | None = None) -> DataFrame:
    """As flag_counts for each group; the group's key is text and null is the text None."""
    keyed = df.withColumn(name, F.coalesce(group.cast("string"), F.lit("None")))
    return _flagged(keyed.groupBy(name).agg, flags, True, digits)


def _flagged(agg, flags: dict[str, Column], rates: bool, digits: int | None) -> DataFrame:
    total = F.count(F.lit(1))
    cols = [total.alias("total")]
    for name, flag in flags.items():
        cols.append(F.count_if(flag).alias(f"{name}_count"))
        if rates:
            cols.append(rate(F.count_if(flag), total, digits).alias(f"{name}_rate"))
    return agg(*cols)


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("records"))


def stage_of(steps: Column, has_irreps: Column, soc: Column, charge_mode: Column, symmetry: Column) -> Column:
    """Kind of a calculation from its settings; missing settings count as not set."""
    soc = truthy(soc)
    return (
        F.when(F.coalesce(steps, F.lit(0)) > 0, "relax").when(truthy(has_irreps) | (soc & (F.coalesce(charge_mode, F.lit(0)) == 11)), "band_soc")
        .when(soc, "static_soc").when(F.coalesce(symmetry, F.lit(0)) == 2, "one_step_symmetry").otherwise("static_nosoc")
    )


def generation_gate(volume_per_atom: Column, distance: Column, energy: Column, same_group: Column, same_elements: Column) -> Column:
    """The first gate a generated structure fails, or how it goes on."""
    return (
        F.when(~is_finite(volume_per_atom) | (volume_per_atom < 1), "bad_volume").when(~is_finite(distance) | (distance < 0.4), "too_close")
        .when(is_finite(energy) & (energy > 1000), "energy_too_high").when(~truthy(same_group) | ~not_false(same_elements), "not_as_asked")
        .when(is_finite(energy) & (energy < -200), "accepted_unrefined").otherwise("accepted")
    )


def set_differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, missing, extra): values of a key only in left, or only in right; keys without any difference are left out."""
    both = left.select(key, value).distinct().withColumn("__l", F.lit(1)).join(right.select(key, value).distinct().withColumn("__r", F.lit(1)), [key, value], "full")
    odd = both.where(F.col("__l").isNull() | F.col("__r").isNull())
    side = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c).isNotNull(), F.col(value)))), ";")
    return odd.groupBy(key).agg(side("__l").alias("missing"), side("__r").alias("extra"))
