"""Best representative of each duplicate group (problem 4).

``surviving_records`` finds each group's surviving row, and for each field the existing value that is closest to the
group's consensus. The consensus of a text field comes from progressive alignment: values are cut into tokens and,
heaviest first, aligned to a profile whose columns collect votes for tokens (or for none); each column's winner makes the
consensus. A vote has a weight, which adds up, and a trust, of which the greatest counts. Winners by weight give the best
value of a field; winners by trust give the consensus of the row that may be trusted most, so the surviving row is the
existing one that agrees with it in most fields, the stated order settling rows that agree alike.

Distinct values carry their votes, so copies cost nothing; fields of many values are aligned in blocks, whose profiles
are aligned to one another, heaviest first, in further rounds, so no task gets a whole group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.orphans import reference_value
from tabulon.operators.skew import heavy_keys, join_unique
from tabulon.session import table
from tabulon.workspace import Workspace

#: Values, or profiles, that one alignment takes.
BLOCK = 128
_TOKEN = re.compile(r"[A-Z][a-z]?(?=[A-Z0-9])|\d+|[^\W\d_]+|[\W_]", re.UNICODE)
#: Score of a column that meets none.
GAP = -0.6


class Profile(NamedTuple):
    """Aligned values: per column the votes (weight, trust) by token, the empty one standing for none; and the votes of all values."""

    columns: list[dict[str, tuple[float, str]]]
    weight: float
    trust: str


def tokens_of(value: str) -> list[str]:
    return _TOKEN.findall(value)


def single(value: str, weight: float, trust: str = "") -> Profile:
    return Profile([{t: (weight, trust)} for t in tokens_of(value)], weight, trust)


def _joined(a: dict, b: dict) -> dict:
    both = dict(a)
    for t, (w, k) in b.items():
        old = both.get(t)
        both[t] = (old[0] + w, max(old[1], k)) if old else (w, k)
    return both


def align(one: Profile, two: Profile) -> Profile:
    """Global alignment of two profiles; a column that meets none gets the other's votes for the empty token.

    Equal tokens at both ends, undisputed on either side, score highest and are taken before the rest is laid out.
    """
    p, q = one.columns, two.columns
    none_of_one, none_of_two = {"": (one.weight, one.trust)}, {"": (two.weight, two.trust)}
    sure = lambda a, b: len(a) == 1 and a.keys() == b.keys()
    head = 0
    while head < len(p) and head < len(q) and sure(p[head], q[head]):
        head += 1
    tail = 0
    while tail < min(len(p), len(q)) - head and sure(p[-1 - tail], q[-1 - tail]):
        tail += 1
    n, m = len(p) - head - tail, len(q) - head - tail
    pieces = [_joined(a, b) for a, b in zip(p[:head], q[:head])]
    a, b = p[head : head + n], q[head : head + m]
    if n and m:
        scale = 2.0 / ((one.weight or 1.0) * (two.weight or 1.0))
        fit = [[scale * sum(v[0] * y[t][0] for t, v in x.items() if t and t in y) - 1.0 for y in b] for x in a]
        score = [[j * GAP for j in range(m + 1)]]
        for i in range(n):
            above, row = score[-1], [(i + 1) * GAP]
            for j in range(m):
                row.append(max(above[j] + fit[i][j], above[j + 1] + GAP, row[j] + GAP))
            score.append(row)
        middle, i, j = [], n, m
        while i or j:
            if i and j and abs(score[i][j] - score[i - 1][j - 1] - fit[i - 1][j - 1]) < 1e-9:
                i, j = i - 1, j - 1
                middle.append(_joined(a[i], b[j]))
            elif i and abs(score[i][j] - score[i - 1][j] - GAP) < 1e-9:
                i -= 1
                middle.append(_joined(a[i], none_of_two))
            else:
                j -= 1
                middle.append(_joined(b[j], none_of_one))
        pieces += middle[::-1]
    else:
        pieces += [_joined(x, none_of_two) for x in a] + [_joined(y, none_of_one) for y in b]
    pieces += [_joined(x, y) for x, y in zip(p[len(p) - tail :], q[len(q) - tail :])]
    return Profile(pieces, one.weight + two.weight, max(one.trust, two.trust))


def merged(profiles: list[Profile]) -> Profile:
    """Progressive alignment in the order given."""
    whole = profiles[0]
    for p in profiles[1:]:
        whole = align(whole, p)
    return whole


def profile_of(values: list[tuple[str, float, str]]) -> Profile:
    """Progressive alignment of values (value, weight, trust), heaviest first."""
    return merged([single(*v) for v in sorted(values, key=lambda x: (-x[1], x[0]))])


def consensus_of(profile: Profile) -> tuple[list[str], list[str]]:
    """The winning token of each column by weight, and by trust (then weight), the smaller one of equals; columns won by the empty token vanish."""
    by_weight = [min(c, key=lambda t: (-c[t][0], t)) for c in profile.columns]
    by_trust = [max(c, key=lambda t: (c[t][1], c[t][0])) for c in profile.columns]
    return [t for t in by_weight if t], [t for t in by_trust if t]


def distance(value: list[str], consensus: list[str]) -> int:
    """Token edit distance."""
    if value == consensus:
        return 0
    row = list(range(len(consensus) + 1))
    for i, a in enumerate(value, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(consensus, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1]


def _packed(profile: Profile) -> str:
    return json.dumps(profile, sort_keys=True)


def _unpacked(text: str) -> Profile:
    columns, weight, trust = json.loads(text)
    return Profile([{t: tuple(v) for t, v in c.items()} for c in columns], weight, trust)


def _closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each field the value closest to the consensus by weight (of equals the heaviest, latest, smallest) and to that by trust (the most trusted, smallest)."""
    for pdf in batches:
        best = []
        for votes in pdf["votes"]:
            by_weight, by_trust = consensus_of(profile_of([(v["value"], v["weight"], v["trust"]) for v in votes]))
            cut = [(tokens_of(v["value"]), v) for v in votes]
            top = min(cut, key=lambda c: (distance(c[0], by_weight), -c[1]["weight"], -c[1]["latest"], c[1]["value"]))[1]
            least = min(distance(t, by_trust) for t, _ in cut)
            near = [v for t, v in cut if distance(t, by_trust) == least]
            high = max(v["trust"] for v in near)
            best.append((top["value"], min(v["value"] for v in near if v["trust"] == high)))
        yield pdf[["slot"]].assign(value=[b[0] for b in best], trusted=[b[1] for b in best])


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [profile_of([(v["value"], v["weight"], v["trust"]) for v in votes]) for votes in pdf["votes"]]
        yield pdf[["slot"]].assign(profile=[_packed(p) for p in done], weight=[p.weight for p in done])


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [merged([_unpacked(x["profile"]) for x in sorted(profiles, key=lambda x: (-x["weight"], x["profile"]))]) for profiles in pdf["profiles"]]
        yield pdf[["slot"]].assign(profile=[_packed(p) for p in done], weight=[p.weight for p in done])


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        winners = {p: consensus_of(_unpacked(p)) for p in pdf["profile"].unique()}
        cut = [tokens_of(v) for v in pdf["value"]]
        far = [distance(t, winners[p][0]) for t, p in zip(cut, pdf["profile"])]
        yield pdf.drop(columns="profile").assign(far=far, off=[distance(t, winners[p][1]) for t, p in zip(cut, pdf["profile"])])


def consensus_values(ws: Workspace, votes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, value, trusted) of votes (slot, value, weight, latest, trust), distinct in slot and value.

    ``value`` is the existing value closest to the slot's consensus by weight; of equals the heaviest, latest (bigint),
    smallest. ``trusted`` is the one closest to the consensus by trust, null if the votes for null are the most trusted.
    A slot is a field of a group, as text. Null values have no tokens and vote only with their trust.
    """
    votes = ws.stage(votes)
    known = votes.where("value IS NOT NULL")
    numbers = ws.stage(votes.groupBy("slot").agg(F.count("value").alias("n"), F.max(F.when(F.col("value").isNull(), F.col("trust"))).alias("none"), F.max(F.when(F.col("value").isNotNull(), F.col("trust"))).alias("some")))
    big = numbers.where(F.col("n") > block).select("slot", "n")
    vote = F.struct("value", "weight", "latest", "trust")
    total = known.count()
    if big.limit(1).count():
        fan = heavy_keys(big, "slot", "n", total)
        marked = join_unique(known, big, "slot", fan, "left")
        small, large = marked.where("n IS NULL"), ws.stage(marked.where("n IS NOT NULL"))
    else:
        small, large = known, None
    listed = ws.stage(small.groupBy("slot").agg(F.collect_list(vote).alias("votes")))
    alone = listed.where("size(votes) = 1").select("slot", F.col("votes")[0]["value"].alias("value"), F.col("votes")[0]["value"].alias("trusted"))
    best = alone.unionByName(listed.where("size(votes) > 1").mapInPandas(_closest, "slot string, value string, trusted string"))
    if large is not None:
        packed = "slot string, profile string, weight double"
        parts = large.groupBy("slot", F.pmod(F.xxhash64("value"), F.ceil(F.col("n") / block)).alias("part")).agg(F.collect_list(vote).alias("votes"))
        profiles = ws.stage(parts.mapInPandas(_profiles, packed))
        while True:
            left = profiles.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            if not left.limit(1).count():
                break
            sized = profiles.join(left, "slot", "left").withColumn("n", F.coalesce("n", F.lit(1)))
            again = sized.groupBy("slot", F.pmod(F.xxhash64("profile"), F.ceil(F.col("n") / block)).alias("part")).agg(F.collect_list(F.struct("profile", "weight")).alias("profiles"))
            profiles = ws.stage(again.mapInPandas(_merged, packed))
        far = join_unique(large.drop("n"), profiles.select("slot", "profile"), "slot", fan)
        far = far.mapInPandas(_distances, "slot string, value string, weight double, latest bigint, trust string, far int, off int")
        order = F.struct("far", (-F.col("weight")).alias("w"), (-F.col("latest")).alias("l"), "value")
        nearest = F.max_by("value", F.struct((-F.col("off")).alias("o"), "trust", "value"))
        best = best.unionByName(far.groupBy("slot").agg(F.min_by("value", order).alias("value"), nearest.alias("trusted")))
    whole = numbers.select("slot", "none", "some").join(best, "slot", "left")
    return whole.select("slot", "value", F.when(F.col("none").isNull() | (F.col("none") < F.col("some")), F.col("trusted")).alias("trusted"))


def filled(columns: list[tuple[str, str]]) -> Column:
    """Number of values that are neither null nor NaN."""
    one = lambda c, kind: F.when(F.col(c).isNotNull() & (~F.isnan(F.col(c)) if kind in ("double", "float") else F.lit(True)), 1).otherwise(0)
    return sum((one(c, k) for c, k in columns), F.lit(0))


def written(column: Column, kind: str) -> Column:
    """A value as text that ``read`` turns back exactly; NaN is no value."""
    if kind in ("double", "float"):
        column = F.when(~F.isnan(column), column)
    return (F.unix_micros(column) if kind == "timestamp" else column).cast("string")


def read(column: Column, kind: str) -> Column:
    return F.timestamp_micros(column.cast("bigint")) if kind == "timestamp" else column.cast(kind)


def voted_values(members: DataFrame, others: list[tuple[str, str]]) -> DataFrame:
    """(group_id, best): map of each column of ``others`` (in the struct ``others``) to its written value with most votes.

    Trusted rows vote twice; of equals the latest, then the smallest. A column null or NaN in all rows is missing from the map.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), written(F.col("others")[c], k).alias("value")) for c, k in others]))
    votes = members.select("group_id", "trusted", "latest", pairs.alias("p")).where("p.value IS NOT NULL").groupBy("group_id", F.col("p.field").alias("field"), F.col("p.value").alias("value"))
    votes = votes.agg(F.sum(F.when(F.col("trusted"), 2.0).otherwise(1.0)).alias("weight"), F.max("latest").alias("latest"))
    order = F.struct((-F.col("weight")).alias("w"), F.coalesce(-F.unix_micros("latest"), F.lit(1 << 62)).alias("l"), F.col("value").try_cast("double").alias("number"), "value")
    best = votes.groupBy("group_id", "field").agg(F.min_by("value", order).alias("value"))
    return best.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("best"))


def trust_key(trusted: Column, filled_: Column, latest: Column, row_id: Column) -> Column:
    """A text that orders rows as (trusted, filled, latest, smallest row_id); a null ``latest`` is the earliest."""
    since = F.coalesce(F.unix_micros(latest) + F.lit(1 << 62), F.lit(0).cast("bigint"))
    return F.concat(F.when(trusted, "1").otherwise("0"), F.lpad(filled_.cast("string"), 5, "0"), F.lpad(F.hex(since), 16, "0"), F.lpad(F.hex(F.lit((1 << 62) - 1) - F.coalesce(row_id, F.lit(0))), 16, "0"))


def surviving_records(spark: SparkSession, rows: DataFrame, group: str, row_id: str, trusted: Column, latest: str, fields: list[str], measured: list[tuple[str, str]], others: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each group of two or more rows: group_id, surviving row, number of rows, consensus (map of field to value).

    Rows vote for the values of ``fields`` (text), null included, with a weight (2 if trusted, else 1) and a trust: first
    a trusted row, then the one with most of the ``measured`` columns filled, then the latest (null is earliest), then the
    smallest row_id. The survivor is the row that agrees in most fields with the values nearest to the consensus by trust;
    of rows that agree alike, the most trusted. ``consensus`` holds each field's value nearest to the consensus by weight;
    a field null in all rows is missing from it, and if all fields are it is null. Null groups are no group. With ``others`` (columns that are no text, with
    their types) there is also ``best``, the map of ``voted_values``.
    """
    ws = Workspace(spark, "survivors")
    keep = rows.where(F.col(group).isNotNull()).select(
        F.col(group).alias("group_id"), F.col(row_id).alias("row_id"), F.coalesce(trusted, F.lit(False)).alias("trusted"), filled(measured).alias("filled"), F.col(latest).cast("timestamp").alias("latest"), *[F.col(f) for f in fields],
        *([F.struct(*[F.col(c) for c, _ in others]).alias("others")] if others else []),
    )
    keep = ws.stage(keep.withColumn("trust", trust_key(F.col("trusted"), F.col("filled"), F.col("latest"), F.col("row_id"))))
    heads = ws.stage(keep.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    fan = heavy_keys(heads, "group_id", "rows", keep.count())
    members = join_unique(keep, heads.select("group_id"), "group_id", fan)
    pairs = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{i}:"), "group_id").alias("slot"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)]))
    votes = members.select("trusted", "latest", "trust", pairs.alias("p")).groupBy(F.col("p.slot").alias("slot"), F.col("p.value").alias("value"))
    votes = votes.agg(F.sum(F.when(F.col("trusted"), 2.0).otherwise(1.0)).alias("weight"), F.coalesce(F.unix_micros(F.max("latest")), F.lit(-(1 << 62))).alias("latest"), F.max("trust").alias("trust"))
    number = F.substring_index("slot", ":", 1).cast("int")
    found = consensus_values(ws, votes).select(F.expr("substring(slot, instr(slot, ':') + 1)").alias("group_id"), number.alias("field"), "value", "trusted")
    record = F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "trusted").alias("v"))))
    records = ws.stage(found.groupBy("group_id").agg(record.alias("record")))
    agreed = sum((F.when(F.col(f).cast("string").eqNullSafe(F.col("record")[i]["trusted"]), 1).otherwise(0) for i, f in enumerate(fields)), F.lit(0))
    met = join_unique(members.select("group_id", "row_id", "trust", *fields), records, "group_id", fan).select("group_id", "row_id", "trust", agreed.alias("agreed"))
    chosen = met.groupBy("group_id").agg(F.max_by("row_id", F.struct("agreed", "trust")).alias("row_id"), F.count(F.lit(1)).alias("rows"))
    names = F.filter(F.array(*[F.struct(F.lit(f).alias("k"), F.col("record")[i]["value"].alias("v")) for i, f in enumerate(fields)]), lambda e: e["v"].isNotNull())
    out = chosen.join(records.select("group_id", F.when(F.size(names) > 0, F.map_from_entries(names)).alias("consensus")), "group_id")
    return out.join(voted_values(members, others), "group_id", "left") if others else out


FIELDS = ["result_name", "mapping_status", "mapping_method", "reduced_formula", "final_structure_file", "primary_band_job_directory"]


def candidate_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """dft_materials with ``full_candidate`` (a legacy id of only one candidate stands for it) and ``analysed``; and its own columns."""
    catalog = table(spark, folder, "structure_catalog").select("candidate_id", "legacy_id")
    legacy = catalog.where("legacy_id IS NOT NULL AND candidate_id IS NOT NULL").groupBy(F.col("legacy_id").alias("value")).agg(F.min("candidate_id").alias("low"), F.max("candidate_id").alias("high"))
    legacy = legacy.where("low = high").join(catalog.select(F.col("candidate_id").alias("value")), "value", "left_anti").select("value", F.col("low").alias("stands_for"))
    dft = table(spark, folder, "dft_materials")
    columns = dft.dtypes
    named = dft.withColumn("value", reference_value("candidate_id"))
    total = named.count()
    fan = heavy_keys(named.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value", "n", total)
    placed = join_unique(named.where("value IS NOT NULL"), legacy, "value", fan, "left").withColumn("full_candidate", F.coalesce("stands_for", "value"))
    analysed = table(spark, folder, "topology_labels").where("analysis_completed AND result_name IS NOT NULL").select("result_name").distinct().withColumn("analysed", F.lit(True))
    fan = heavy_keys(named.groupBy("result_name").agg(F.count(F.lit(1)).alias("n")), "result_name", "n", total)
    return join_unique(placed, analysed, "result_name", fan, "left"), columns


def p4_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Surviving row and number of rows of every candidate with several rows, with the best value of every column of the record."""
    rows, columns = candidate_rows(spark, folder)
    others = [(c, k) for c, k in columns if c not in ("dft_row_id", "candidate_id", *FIELDS)]
    found = surviving_records(spark, rows, "full_candidate", "dft_row_id", F.col("analysed"), "parsed_at", FIELDS, columns, others)
    best = {f: F.col("consensus")[f] for f in FIELDS} | {c: read(F.col("best")[c], k) for c, k in others}
    return found.select(F.col("group_id").alias("candidate_id"), F.col("row_id").alias("dft_row_id"), "rows", *[v.alias(f"best_{c}") for c, v in best.items()])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate and surviving row of every group of two or more rows."""
    return p4_survivors(spark, folder).select("candidate_id", "dft_row_id")


def p4_filled(spark: SparkSession, folder: str) -> DataFrame:
    """One row: groups, their rows, and for each column of the record the number of groups whose surviving record has a value."""
    found = p4_survivors(spark, folder)
    columns = [c for c in found.columns if c.startswith("best_")]
    return found.agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"), *[F.count(c).alias(c.removeprefix("best_")) for c in columns])
