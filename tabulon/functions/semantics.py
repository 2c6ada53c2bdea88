"""Null, truth and number rules shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lenient_bool(text: Column) -> Column:
    """Words for true and false in any case, with blanks around; null for anything else."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "1", "yes", "y"), True).when(word.isin("false", "0", "no", "n"), False)


def switch_bool(text: Column) -> Column:
    """Words for true, also between dots; everything else, null included, is false."""
    return F.coalesce(F.upper(F.regexp_replace(F.trim(text), r"^\.+|\.+$", "")).isin("T", "TRUE", "1", "YES"), F.lit(False))


def lenient_float(text: Column) -> Column:
    """Blank or unreadable text is null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def lenient_int(text: Column) -> Column:
    """Read as a number and cut to its whole part; blank, unreadable and non-finite text is null."""
    number = lenient_float(text)
    return F.when(is_finite(number), number).try_cast("int")


def truthy(flag: Column) -> Column:
    """Null fails."""
    return F.coalesce(flag, F.lit(False))


def not_false(flag: Column) -> Column:
    """Null passes."""
    return F.coalesce(flag, F.lit(True))


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def rate(part: Column, whole: Column, digits: int | None = 6) -> Column:
    """part / whole; null where whole is 0 or null."""
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return value if digits is None else F.round(value, digits)


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the rows of a key the one with the greatest ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key the first in ``order``, which should be total."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")
