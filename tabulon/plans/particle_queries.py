"""Sequential Monte Carlo on suppliers as particles (a nation is a run) and on events as scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import particles, sampling
from tabulon.session import table

STEPS = (100, 300, 500)


def _particles(spark, d):
    """Scores from balances; negative balances are scoring errors."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("particle"), (F.col("s_acctbal") / 10000).alias("probability"), F.when(F.col("s_acctbal") < 0, "no structure").otherwise("").alias("error"))
    return s.withColumns({"log_weight": F.lit(0.0), "potential": F.lit(0.0)})


def _twisted(spark, d):
    df = _particles(spark, d).withColumn("probability", particles.floored(F.col("probability"), F.col("error")))
    events = None
    for step in STEPS:
        beta = sampling.tempered_power(F.lit(step), 0, 500, 3.0)
        df = particles.twisted(df, ["run"], beta, "probability", "log_weight", "potential")
        e = particles.weight_events(df, ["run"], "probability", "log_weight", 0.8, F.col("error")).withColumn("step", F.lit(step))
        events = e if events is None else events.unionByName(e)
    return df, events


def scored_with_floor(spark, d):
    p = _particles(spark, d)
    return p.select("particle", F.round(particles.floored(F.col("probability"), F.col("error")), 8).alias("probability"), "error")


def twisting_events(spark, d):
    """Scored steps of all runs: probabilities, effective sizes and resampling."""
    events = _twisted(spark, d)[1]
    return events.select("run", "step", *[F.round(c, 8).alias(c) for c in ("probability_min", "probability_mean", "probability_max")], F.round("ess", 5).alias("ess"), "resampled", "errors")


def resampled_run(spark, d):
    """Particles after resampling at the last step: each slot with its ancestor's score."""
    df = _twisted(spark, d)[0]
    slots = sampling.systematic_resample(sampling.normalised_weights(df, ["run"], "log_weight"), ["run"], "particle", "weight", 0.37)
    out = particles.after_resampling(df, slots, ["run"], "particle", "log_weight")
    return out.select("run", "particle", "ancestor", F.round("probability", 8).alias("probability"))


def final_ranks(spark, d):
    out = particles.final_ranks(_particles(spark, d), ["run"], "particle", "probability", "error", 5)
    return out.select("run", "rank", "particle", F.round("probability", 8).alias("probability"), "valid", "error")


def smc_summary(spark, d):
    df, events = _twisted(spark, d)
    return particles.run_summary(events, particles.final_ranks(df, ["run"], "particle", "probability", "error", 5), ["run"])


def baseline_samples(spark, d):
    """Random baselines for parts as targets: the first attempt whose seed succeeds."""
    targets = table(spark, d, "part").select(F.col("p_partkey").alias("target"), (F.col("p_size") % 4).alias("count"))
    attempts = particles.baseline_attempts(targets, "count", 3, 13).withColumn("draw", F.col("seed") * 48271 % 2147483647)
    return particles.first_success(attempts, ["target", "sample"], F.col("draw") % 3 == 0, "draw")


def posterior_states(spark, d):
    """The earlier state's probabilities for events as noised one-hot states of four."""
    types = ["view", "click", "purchase", "signup"]
    e = table(spark, d, "events").select("event_id", F.col("event_type"), (F.col("user_id") % 4).alias("guess"))
    z = F.array(*[F.when(F.col("event_type") == t, 1.0).otherwise(0.0) for t in types])
    prior = F.array(*[F.when(F.col("guess") == i, 0.7).otherwise(0.1) for i in range(4)])
    m = lambda keep: particles.uniform_transition(F.lit(keep), 4)
    p = particles.posterior_step(z, prior, m(0.9), m(0.6), m(0.54))
    return e.select("event_id", *[F.round(p[i], 6).alias(f"p{i}") for i in range(4)])


QUERIES = {f.__name__: f for f in (scored_with_floor, twisting_events, resampled_run, final_ranks, smc_summary, baseline_samples, posterior_states)}

_P = """s AS (SELECT s_nationkey AS run, s_suppkey AS particle, CASE WHEN s_acctbal < 0 THEN 1e-6 ELSE least(greatest(s_acctbal::DOUBLE / 10000, 1e-6), 1 - 1e-6) END AS probability, CASE WHEN s_acctbal < 0 THEN 'no structure' ELSE '' END AS error FROM supplier)"""
_EVENTS = f"""{_P},
t AS (SELECT *, 3.0 * step / 500 * ln(probability) AS lw FROM s, (SELECT unnest([100, 300, 500]) AS step)),
w AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY run, step)) AS e FROM t),
v AS (SELECT run, step, min(probability) AS lo, avg(probability) AS me, max(probability) AS hi, sum(e) * sum(e) / sum(e * e) AS ess, count(*) AS n, count(*) FILTER (error <> '') AS errors FROM w GROUP BY 1, 2)"""
_RANKED = "SELECT s_nationkey AS run, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank, s_suppkey AS particle, round(s_acctbal::DOUBLE / 10000, 8) AS probability, s_acctbal >= 0 AS valid, CASE WHEN s_acctbal < 0 THEN 'no structure' ELSE '' END AS error FROM supplier QUALIFY rank <= 5"
ORACLE = {
    "scored_with_floor": f"WITH {_P} SELECT particle, round(probability, 8) AS probability, error FROM s",
    "twisting_events": f"WITH {_EVENTS} SELECT run, step, round(lo, 8) AS probability_min, round(me, 8) AS probability_mean, round(hi, 8) AS probability_max, round(ess, 5) AS ess, ess < 0.8 * n AS resampled, errors FROM v",
    "resampled_run": f"""WITH {_EVENTS},
x AS (SELECT run, particle, probability, e / sum(e) OVER (PARTITION BY run) AS q, count(*) OVER (PARTITION BY run) AS n FROM w WHERE step = 500),
c AS (SELECT *, sum(q) OVER (PARTITION BY run ORDER BY particle) AS hi, row_number() OVER (PARTITION BY run ORDER BY particle) AS k FROM x),
b AS (SELECT *, CASE WHEN k = n THEN 1.0 ELSE hi END AS top, coalesce(lag(hi) OVER (PARTITION BY run ORDER BY particle), 0) AS lo FROM c)
SELECT run, unnest(generate_series(greatest(ceil(lo * n - 0.37), 0)::INT, (least(ceil(top * n - 0.37), n) - 1)::INT)) AS particle, particle AS ancestor, round(probability, 8) AS probability FROM b WHERE greatest(ceil(lo * n - 0.37), 0) <= least(ceil(top * n - 0.37), n) - 1""",
    "final_ranks": _RANKED,
    "smc_summary": f"""WITH {_EVENTS}, r AS ({_RANKED}),
a AS (SELECT run, count(*) AS scoring_events, count(*) FILTER (ess < 0.8 * n) AS resampling_events, sum(errors)::BIGINT AS score_errors FROM v GROUP BY 1), b AS (SELECT run, count(*) FILTER (valid) AS valid_outputs, count(*) FILTER (NOT valid) AS failed_outputs FROM r GROUP BY 1)
SELECT * FROM a JOIN b USING (run)""",
    "baseline_samples": """
WITH t AS (SELECT p_partkey AS target, unnest(generate_series(1, p_size % 4)) AS sample FROM part), a AS (SELECT *, unnest(generate_series(0, 3)) AS attempt FROM t),
s AS (SELECT *, ((13 + sample::BIGINT * 1009 + attempt * 9176) % 2147483647) * 48271 % 2147483647 AS draw FROM a)
SELECT target, sample, arg_min(draw, attempt) FILTER (draw % 3 = 0) AS draw, coalesce(min(attempt) FILTER (draw % 3 = 0), 3) + 1 AS attempts FROM s GROUP BY 1, 2""",
    "posterior_states": """
WITH k AS (SELECT unnest([0, 1, 2, 3]) AS i), e AS (SELECT event_id, user_id % 4 AS g, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS z FROM events),
m AS (SELECT event_id, j.i AS j, (CASE WHEN j.i = z THEN 0.925 ELSE 0.025 END) * sum((CASE WHEN a.i = g THEN 0.7 ELSE 0.1 END) * (CASE WHEN a.i = j.i THEN 0.7 ELSE 0.1 END) / (CASE WHEN a.i = z THEN 0.655 ELSE 0.115 END)) AS u FROM e, k j, k a WHERE z IS NOT NULL GROUP BY event_id, j.i, z),
n AS (SELECT event_id, j, u / sum(u) OVER (PARTITION BY event_id) AS p FROM m)
SELECT event_id, round(max(p) FILTER (j = 0), 6) AS p0, round(max(p) FILTER (j = 1), 6) AS p1, round(max(p) FILTER (j = 2), 6) AS p2, round(max(p) FILTER (j = 3), 6) AS p3 FROM n GROUP BY 1 UNION ALL SELECT event_id, 0.25, 0.25, 0.25, 0.25 FROM e WHERE z IS NULL""",
}
