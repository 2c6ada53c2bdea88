"""Rates with intervals, model metrics, cluster bootstrap and group folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions.semantics import rate


def wilson(success: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within [0, 1], rounded to 6; null without cases."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = success / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    return F.when(n.isNotNull(), F.round(F.greatest(F.lit(0.0), middle - spread), 6)), F.when(n.isNotNull(), F.round(F.least(F.lit(1.0), middle + spread), 6))


def arm_metrics(df: DataFrame, arm: str, measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long table: arm, metric, success, denominator, rate and Wilson bounds; each measure has its own denominator.

    measures: name -> (success, in_denominator); null counts as no. Arms that are null or blank are left out.
    """
    flags = df.where(F.col(arm).isNotNull() & (F.col(arm) != ""))
    cols = [c for name, (hit, within) in measures.items() for c in (F.count_if(hit & within).alias(f"{name}_s"), F.count_if(within).alias(f"{name}_n"))]
    wide = flags.groupBy(arm).agg(*cols)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{n}_s").alias("success"), F.col(f"{n}_n").alias("denominator")) for n in measures]))
    long = wide.select(arm, rows.alias("r")).select(arm, "r.*")
    low, high = wilson(F.col("success"), F.col("denominator"))
    return long.withColumn("rate", rate(F.col("success"), F.col("denominator"))).withColumn("ci_low", low).withColumn("ci_high", high)


def lift(metrics: DataFrame, arm: str, baseline: str) -> DataFrame:
    """metrics with the rate over the baseline arm's rate of the same metric; null if that is 0 or missing."""
    base = metrics.where(F.col(arm) == baseline).select("metric", F.col("rate").alias("base_rate"))
    joined = metrics.join(F.broadcast(base), "metric", "left")  # one row a metric
    return joined.withColumn("lift", F.round(F.try_divide("rate", "base_rate"), 6)).drop("base_rate")


def score_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg) of every distinct score; rows without score or label are left out."""
    known = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1))
    return known.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))


def ranking_metrics(spark: SparkSession, df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: rows, base rate, tie-aware ROC-AUC, average precision, balanced accuracy at 0.5, Brier; null where undefined.

    Distinct scores are accumulated over range partitions (running_total), so the table may be of any size.
    """
    from tabulon.operators.skew import running_totals
    from tabulon.workspace import Workspace

    ws = Workspace(spark, "ranking")
    table = ws.stage(score_table(df, score, label))
    down = running_totals(ws, table, [], [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    total = table.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    both = down.crossJoin(F.broadcast(total))  # one row
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    high = F.col("score") >= 0.5
    out = both.agg(
        F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.max("P").alias("P"), F.max("N").alias("N"), auc.alias("u"), ap.alias("a"),
        F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("tp5"), F.sum(F.when(~high, F.col("neg")).otherwise(0)).alias("tn5"),
        F.sum(F.col("pos") * (F.col("score") - 1) ** 2 + F.col("neg") * F.col("score") ** 2).alias("b"),
    )
    return out.select(
        F.col("rows").cast("bigint").alias("rows"), rate(F.col("P"), F.col("rows")).alias("base_rate"), F.round(F.try_divide("u", F.col("P") * F.col("N")), 6).alias("roc_auc"), F.round(F.try_divide("a", "P"), 6).alias("average_precision"),
        F.round((F.try_divide("tp5", "P") + F.try_divide("tn5", "N")) / 2, 6).alias("balanced_accuracy"), F.round(F.try_divide("b", "rows"), 6).alias("brier"),
    )


def enrichment_at(df: DataFrame, score: str, label: str, id_: str, share: float = 0.2) -> DataFrame:
    """One row: number and precision of the top share of rows (at least one), base rate and enrichment. Ties go by id.

    Rows are numbered over range partitions (running_total), as the share asked for grows with the data.
    """
    from tabulon.operators.skew import running_total
    from tabulon.workspace import Workspace

    known = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1)).select(id_, score, label)
    n, hits = known.agg(F.count(F.lit(1)), F.sum(label)).first()
    k = max(1, -(-n * int(round(share * 1_000_000)) // 1_000_000)) if n else 0
    ranked = running_total(Workspace(df.sparkSession, "enrichment"), known, [], [F.col(score).desc(), id_], F.lit(1), "__rank")
    return ranked.where(F.col("__rank") <= k).agg(F.count(F.lit(1)).alias("selected"), F.avg(label).alias("p")).select(
        "selected", F.round("p", 6).alias("precision"), F.lit(round(hits / n, 6) if n else None).cast("double").alias("base_rate"), F.round(F.try_divide(F.col("p"), F.lit(hits / n if n and hits else 0.0)), 6).alias("enrichment")
    )


#: A linear congruential step, the same integer arithmetic everywhere.
LCG = (1103515245, 12345, 2147483648)


def bootstrap_ci(df: DataFrame, group: str, score: str, label: str, draws: int = 200, cut: float = 0.5, seed: int = 13) -> DataFrame:
    """One row: 2.5 and 97.5 percentiles of the enrichment of rows with score >= cut over the base rate, over resampled groups.

    Groups are drawn with replacement, as many as there are, by a congruential sequence; only group totals are resampled.
    Draws without positives or without selected rows are skipped.
    """
    known = df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1))
    known = known.select(F.col(group).alias("__group"), F.col(score).alias("__score"), F.col(label).alias("__label"))  # whatever the columns are called
    group, score, label = "__group", "__score", "__label"
    totals = known.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"), F.count_if(F.col(score) >= cut).alias("s"), F.sum(F.when(F.col(score) >= cut, F.col(label)).otherwise(0)).alias("sp"))
    numbered = totals.withColumn("g", F.row_number().over(Window.orderBy(group)) - 1)  # one row a group
    count = numbered.count()
    a, c, m = LCG
    spark = df.sparkSession
    slots = spark.range(draws * count).select((F.col("id") / count).cast("bigint").alias("draw"), ((((F.col("id") + seed) * a + c) % m) * 48271 % 2147483647 % max(1, count)).cast("int").alias("g"))
    per = slots.join(numbered, "g").groupBy("draw").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("s").alias("s"), F.sum("sp").alias("sp"))
    value = F.try_divide(F.try_divide(F.col("sp").cast("double"), F.col("s")), F.try_divide(F.col("p").cast("double"), F.col("n")))
    done = per.select(value.alias("e")).where("e IS NOT NULL")
    return done.agg(F.count(F.lit(1)).alias("draws"), F.round(F.percentile("e", 0.025), 6).alias("ci_low"), F.round(F.percentile("e", 0.975), 6).alias("ci_high"))


def bootstrap_top_ci(df: DataFrame, group: str, score: str, label: str, share: float = 0.2, draws: int = 2000, seed: int = 13, digits: int = 3) -> DataFrame:
    """One row: 2.5 and 97.5 percentiles of the enrichment of the top share of rows (at least one) over resampled groups.

    Groups are drawn as by ``bootstrap_ci``. In each draw the best ceil(share * n) of its rows are taken; scores are told
    apart to ``digits`` digits, and of rows that tie at the cut a proportional part counts. So what is resampled are
    counts by group and score, at most 10 ** digits + 1 a group, and each draw ranks as many scores, not rows.
    Draws without positives are skipped.
    """
    known = df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1))
    known = known.select(F.col(group).alias("__group"), F.col(score).alias("__score"), F.col(label).alias("__label"))  # whatever the columns are called
    group, score, label = "__group", "__score", "__label"
    cells = known.groupBy(group, F.round(score, digits).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    groups = known.select(group).distinct().withColumn("g", F.row_number().over(Window.orderBy(group)) - 1)  # one row a group
    numbered = cells.join(groups, group).select("g", "s", "n", "p")
    count = groups.count()
    a, c, m = LCG
    slots = df.sparkSession.range(draws * count).select((F.col("id") / count).cast("bigint").alias("draw"), ((((F.col("id") + seed) * a + c) % m) * 48271 % 2147483647 % max(1, count)).cast("int").alias("g"))
    times = slots.groupBy("draw", "g").agg(F.count(F.lit(1)).alias("k"))
    per = times.join(numbered, "g").groupBy("draw", "s").agg(F.sum(F.col("k") * F.col("n")).alias("n"), F.sum(F.col("k") * F.col("p")).alias("p"))
    down, whole = Window.partitionBy("draw").orderBy(F.col("s").desc()), Window.partitionBy("draw")  # at most 10 ** digits + 1 rows
    ranked = per.withColumns({"upto": F.sum("n").over(down), "all_n": F.sum("n").over(whole), "all_p": F.sum("p").over(whole)})
    k = F.greatest(F.lit(1), F.ceil(F.col("all_n") * share))
    part = F.least(F.greatest(k - (F.col("upto") - F.col("n")), F.lit(0)), F.col("n")) / F.col("n")
    by = ranked.withColumns({"k": k, "hit": F.col("p") * part}).groupBy("draw").agg(F.sum("hit").alias("hit"), F.max("k").alias("k"), F.max("all_n").alias("all_n"), F.max("all_p").alias("all_p"))
    value = F.try_divide(F.col("hit") / F.col("k"), F.try_divide(F.col("all_p").cast("double"), F.col("all_n")))
    done = by.select(value.alias("e")).where("e IS NOT NULL")
    return done.agg(F.count(F.lit(1)).alias("draws"), F.round(F.percentile("e", 0.025), 6).alias("ci_low"), F.round(F.percentile("e", 0.975), 6).alias("ci_high"))


def stratified_folds(df: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """(group, rows, positives, fold): all rows of a group in one fold, shares of labels alike over folds.

    There are no more folds than groups with a positive, or with a negative, row (at least two). Groups are placed by
    falling spread of their label counts, then rows, then name, each where the labels' shares of the folds then vary
    least; of equals in the fold with fewest rows. The rule is sequential over groups, of which one task holds the two
    counts each; rows are never gathered.
    """
    import numpy as np
    import pandas as pd

    by = df.where(F.col(group).isNotNull() & F.col(label).isin(0, 1)).groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("bigint").alias("positives"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pos, neg = pdf["positives"].to_numpy(), (pdf["rows"] - pdf["positives"]).to_numpy()
        k = max(2, min(folds, int((pos > 0).sum()), int((neg > 0).sum())))
        counts, total = np.zeros((k, 2)), np.maximum(np.array([pos.sum(), neg.sum()], float), 1)
        order = sorted(range(len(pdf)), key=lambda i: (-abs(int(pos[i]) - int(neg[i])), -int(pdf["rows"].iloc[i]), str(pdf[group].iloc[i])))
        fold = np.zeros(len(pdf), np.int32)
        for i in order:
            add = np.array([pos[i], neg[i]])
            tried = [((((counts + add * (np.arange(k) == f)[:, None]) / total).std(axis=0)).mean().round(12), counts[f].sum(), f) for f in range(k)]
            fold[i] = min(tried)[2]
            counts[fold[i]] += add
        return pdf.drop(columns="all").assign(fold=fold)

    kind = by.schema[group].dataType.simpleString()
    return by.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(place, f"{group} {kind}, rows bigint, positives bigint, fold int")


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """(group, rows, positives, fold): groups by falling positives and rows, dealt back and forth over the folds.

    All rows of a group share a fold. One row a group is ranked, not the rows.
    """
    by = df.where(F.col(group).isNotNull() & F.col(label).isin(0, 1)).groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("bigint").alias("positives"))
    n = F.row_number().over(Window.orderBy(F.col("positives").desc(), F.col("rows").desc(), group)) - 1
    turn, place = (n / folds).cast("int"), n % folds
    return by.withColumn("fold", F.when(turn % 2 == 0, place).otherwise(folds - 1 - place).cast("int"))
