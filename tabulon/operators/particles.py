"""Sequential Monte Carlo over tables of particles: scores with a floor, twisting steps, ranks, audits, baselines, posteriors.

All runs advance together: a step is a few column expressions and grouped sums over (run, particle) rows, however many
runs there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.semantics import is_finite

#: Probability of a particle that couldn't be scored, and the bounds of all.
FLOOR = 1e-6


def checked_scope(scope: int | None, requested: int) -> None:
    """Raises if a scorer made for one space group is asked about another one; no scope fits all."""
    if scope is not None and scope != requested:
        raise ValueError(f"the scorer is for space group {scope}, not {requested}")


def floored(probability: Column, error: Column | None = None) -> Column:
    """Within [FLOOR, 1 - FLOOR]; FLOOR where the score is not finite or has an error (a text that isn't empty)."""
    bad = ~is_finite(probability)
    if error is not None:
        bad = bad | (F.coalesce(error, F.lit("")) != "")
    return F.when(bad, F.lit(FLOOR)).otherwise(F.least(F.greatest(probability, F.lit(FLOOR)), F.lit(1 - FLOOR)))


def is_scored(step: Column, start: int, interval: int, final: Column) -> Column:
    """Steps that are scored: from ``start`` on each ``interval``-th and the last one."""
    return (step >= start) & (final | (step % interval == 0))


def twisted(df: DataFrame, run: list[str], beta: Column, probability: str, log_weight: str, potential: str) -> DataFrame:
    """df after one scored step: the log-weight grows by the rise of beta * log(probability), which becomes the potential."""
    now = beta * F.log(floored(F.col(probability)))
    return df.withColumn("__now", now).withColumn(log_weight, F.col(log_weight) + F.col("__now") - F.col(potential)).withColumn(potential, F.col("__now")).drop("__now")


def weight_events(df: DataFrame, run: list[str], probability: str, log_weight: str, threshold: float, error: Column | None = None) -> DataFrame:
    """One row a run and scored step: least, mean and greatest probability, effective size of the normalised weights, whether
    to resample (the size is less than ``threshold`` of the particles), and the number of scores with an error.

    Weights are shifted by the greatest log-weight: one grouped maximum, then grouped sums, so no window holds a run.
    """
    finite = F.when(is_finite(F.col(log_weight)), F.col(log_weight))
    tops = df.groupBy(*run).agg(F.max(finite).alias("__top"))
    e = F.coalesce(F.exp(finite - F.col("__top")), F.when(F.col("__top").isNull(), 1.0).otherwise(0.0))  # uniform where none is finite
    bad = F.count_if(F.coalesce(error, F.lit("")) != "") if error is not None else F.lit(0).cast("bigint")
    p = floored(F.col(probability), error)
    by = df.join(tops, run).withColumn("__e", e).withColumn("__p", p).groupBy(*run).agg(
        F.min("__p").alias("probability_min"), F.avg("__p").alias("probability_mean"), F.max("__p").alias("probability_max"), F.count(F.lit(1)).alias("particles"),
        (F.sum("__e") ** 2 / F.sum(F.col("__e") ** 2)).alias("ess"), bad.alias("errors"),
    )
    return by.withColumn("resampled", F.col("ess") < threshold * F.col("particles"))


def after_resampling(df: DataFrame, slots: DataFrame, run: list[str], particle: str, log_weight: str) -> DataFrame:
    """Every slot's ancestor under the slot's number, with log-weights of 0; ``slots``: run, slot, ancestor."""
    rows = slots.join(df.withColumnRenamed(particle, "ancestor"), [*run, "ancestor"])
    return rows.withColumnRenamed("slot", particle).withColumn(log_weight, F.lit(0.0))


def final_ranks(df: DataFrame, run: list[str], particle: str, probability: str, error: str, most: int) -> DataFrame:
    """The ``most`` likeliest particles of each run with their rank, those with an error too; ties go by particle.

    A rank limit per run keeps a run from being sorted as a whole beyond ``most`` rows.
    """
    order = Window.partitionBy(*run).orderBy(F.col(probability).desc_nulls_last(), particle)
    ranked = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.withColumn("valid", F.coalesce(F.col(error), F.lit("")) == "")


def run_summary(events: DataFrame, ranked: DataFrame, run: list[str]) -> DataFrame:
    """One row a run: scoring and resampling events, valid and failed outputs."""
    e = events.groupBy(*run).agg(F.count(F.lit(1)).alias("scoring_events"), F.count_if("resampled").alias("resampling_events"), F.sum("errors").alias("score_errors"))
    r = ranked.groupBy(*run).agg(F.count_if("valid").alias("valid_outputs"), F.count_if(~F.col("valid")).alias("failed_outputs"))
    return e.join(r, run, "left").na.fill(0, ["valid_outputs", "failed_outputs"])


def baseline_attempts(targets: DataFrame, count: str, retries: int, seed: int) -> DataFrame:
    """targets with one row a wanted sample and attempt: sample, attempt, and a seed that follows from (seed, sample, attempt)."""
    rows = targets.withColumn("sample", F.explode(F.sequence(F.lit(1), F.greatest(F.col(count), F.lit(0)).cast("int")))).where(F.col(count) > 0)
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries))))
    return rows.withColumn("seed", (F.lit(seed) + F.col("sample").cast("bigint") * 1009 + F.col("attempt") * 9176) % 2147483647)


def first_success(attempts: DataFrame, keys: list[str], succeeded: Column, result: str) -> DataFrame:
    """By keys the result of the first attempt that succeeded, null if none did, and the attempts made until then."""
    ok = F.coalesce(succeeded, F.lit(False))
    by = attempts.groupBy(*keys).agg(F.min_by(F.when(ok, F.col(result)), F.when(ok, F.col("attempt"))).alias(result), F.min(F.when(ok, F.col("attempt"))).alias("__at"), F.max("attempt").alias("__last"))
    return by.select(*keys, result, (F.coalesce("__at", "__last") + 1).alias("attempts"))


def posterior_step(z: Column, prior: Column, q_t: Column, qbar_s: Column, qbar_t: Column) -> Column:
    """Probabilities of the earlier state from the later one ``z`` (one-hot), the prediction ``prior`` of the first state, and
    transition matrices (arrays of rows) of the step, and up to the earlier and the later state; all zero gives equal shares."""
    size = F.size(prior)
    at = lambda m, i, j: F.element_at(F.element_at(m, i + 1), j + 1)
    idx = F.sequence(F.lit(0), size - 1)
    dot = lambda f: F.aggregate(idx, F.lit(0.0), lambda s, k: s + f(k))
    left = lambda j: dot(lambda k: F.element_at(z, k + 1) * at(q_t, j, k))
    below = lambda i: dot(lambda k: at(qbar_t, i, k) * F.element_at(z, k + 1))
    safe = lambda v: F.when(v == 0, F.lit(1e-6)).otherwise(v)
    raw = F.transform(idx, lambda j: left(j) * dot(lambda i: F.element_at(prior, i + 1) * at(qbar_s, i, j) / safe(below(i))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    filled = F.transform(F.array(raw), lambda a: F.when(total(a) == 0, F.transform(a, lambda x: F.lit(1e-5))).otherwise(a))[0]
    return F.transform(F.array(filled), lambda a: F.transform(a, lambda x: x / total(a)))[0]


def uniform_transition(keep: Column, size: int) -> Column:
    """Rows of a transition matrix that keeps a state with probability ``keep`` and else takes any state alike."""
    other = (1 - keep) / size
    return F.array(*[F.array(*[other + keep if i == j else other for j in range(size)]) for i in range(size)])
