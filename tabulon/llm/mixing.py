"""Mixing sources to target weights (problem 8): min-cost flow over membership patterns.

Equal texts are one record, which may be filed under several sources: its membership pattern. Tokens flow from patterns
to the sources in them, up to the source's quota; the k-th use of a pattern's tokens costs more than the one before, so
nothing is repeated while something unused would do. Each pattern's flow to its sources is then spread over bands of
records of like size, and laid, end to end, along a band's records in a seeded order, going round for repeats.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.tokens import sized
from tabulon.operators.skew import running_total
from tabulon.session import table
from tabulon.workspace import Workspace

#: Size bands of records an octave; a band's records differ by less than the 1 / BANDS root of 2.
BANDS = 16


def min_cost_flow(edges: list[list], source: int, sink: int, nodes: int) -> int:
    """Total flow after augmenting along cheapest paths; edges (from, to, capacity, cost) get their flow as fifth item."""
    to, cap, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in edges:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    total = 0
    while True:
        far, via, queued = [None] * nodes, [-1] * nodes, [False] * nodes
        far[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in out[a]:
                b = to[e]
                if cap[e] > 0 and (far[b] is None or far[a] + cost[e] < far[b]):
                    far[b], via[b] = far[a] + cost[e], e
                    if not queued[b]:
                        queued[b] = True
                        queue.append(b)
        if far[sink] is None:
            break
        push, b = None, sink
        while b != source:
            push = cap[via[b]] if push is None else min(push, cap[via[b]])
            b = to[via[b] ^ 1]
        b = sink
        while b != source:
            cap[via[b]] -= push
            cap[via[b] ^ 1] += push
            b = to[via[b] ^ 1]
        total += push
    for i, e in enumerate(edges):
        e.append(cap[2 * i + 1])
    return total


def plan_mix(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[dict[tuple[tuple[str, ...], str], int], int]:
    """Tokens routed from each pattern to each of its sources, and the size of the mix.

    ``patterns``: tokens by membership pattern; ``targets``: share and most repeats by source. Sources without records
    get nothing and their share is spread over the others in proportion. Without ``total`` the mix is as large as the
    shares allow: the largest size at which every source still reaches its quota. With it, quotas that can't be met are
    met as far as they can.
    """
    there = {s for p in patterns for s in p} & {s for s, (share, _) in targets.items() if share > 0}
    weight = sum(targets[s][0] for s in there)
    if not there or not weight:
        return {}, 0
    share = {s: targets[s][0] / weight for s in sorted(there)}
    used = {p: n for p, n in patterns.items() if n > 0 and any(s in there for s in p)}
    names, keys = list(share), list(used)

    def route(size: int) -> tuple[int, int, list[list]]:
        edges: list[list] = []
        for i, p in enumerate(keys):
            members = [s for s in p if s in there]
            for k in range(max(targets[s][1] for s in members)):
                edges.append([0, 1 + i, used[p], k * (k + 1)])
            for s in members:
                edges.append([1 + i, 1 + len(keys) + names.index(s), used[p] * targets[s][1], 0])
        quotas = [int(share[s] * size) for s in names]
        sink = 1 + len(keys) + len(names)
        for j, q in enumerate(quotas):
            edges.append([1 + len(keys) + j, sink, q, 0])
        return min_cost_flow(edges, 0, sink, sink + 1), sum(quotas), edges

    if total is None:
        low, high = 0, int(min(sum(n * targets[s][1] for p, n in used.items() if s in p) / share[s] for s in names)) + 1
        while high - low > max(1, high // 100_000):
            middle = (low + high) // 2
            flow, wanted, _ = route(middle)
            low, high = (middle, high) if flow >= wanted else (low, middle)
        total = low
    _, _, edges = route(total)
    flows = {}
    for a, b, _, _, f in edges:
        if 1 <= a <= len(keys) and f > 0:
            flows[keys[a - 1], names[b - 1 - len(keys)]] = f
    return flows, total


def mixed(spark: SparkSession, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, vocabulary: str | None = None) -> DataFrame:
    """(source, doc_id, tokens, uses): how often each chosen record is used for each source.

    documents: doc_id, text, source; targets: source, target_share, max_repeats (a table that does not grow). A record
    of several sources appears under each by its least doc_id there. A record is used for a source at most that source's
    repeats. Rows of unlisted or null sources, and null or empty texts, take no part. What reaches the driver is one row
    a membership pattern and size band: bounded by 2 ** listed sources times the bands, whatever the records.
    """
    ws = Workspace(spark, "mixing")
    wanted = {r["source"]: (float(r["target_share"] or 0), max(1, int(r["max_repeats"] or 1))) for r in targets.collect() if r["source"]}
    listed = documents.where(F.col("source").isin(list(wanted)) & F.col("text").isNotNull() & (F.col("text") != ""))
    keyed = listed.withColumn("record", F.md5("text"))
    homes = ws.stage(keyed.groupBy("record", "source").agg(F.min("doc_id").alias("doc_id")))
    records = homes.groupBy("record").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.min("doc_id").alias("doc_id"))
    counted = sized(listed.join(records.select("doc_id"), "doc_id", "left_semi"), vocabulary).select("doc_id", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens"))
    records = ws.stage(records.join(counted, "doc_id").where("tokens > 0").withColumn("pattern", F.array_join("pattern", "\u0001")).select("record", "pattern", "tokens"))
    records = records.withColumn("band", F.floor(F.log2("tokens") * BANDS).cast("int"))
    bands = {(tuple(r[0].split("\u0001")), r[1]): (r[2], r[3]) for r in records.groupBy("pattern", "band").agg(F.count(F.lit(1)), F.sum("tokens")).collect()}
    weights: dict = {}
    for (p, _), (_, n) in bands.items():
        weights[p] = weights.get(p, 0) + n
    flows, _ = plan_mix(weights, wanted, total)
    laid = [("\u0001".join(p), b, s, float(begin), float(k), float(bands[p, b][0])) for p, b, s, begin, k in spread_uses(flows, bands, wanted)]
    tape = spark.createDataFrame(laid, "pattern string, band int, source string, begin double, length double, lap double")
    placed = running_total(ws, records.withColumn("dice", F.xxhash64("record", F.lit(seed))), ["pattern", "band"], ["dice", "record"], F.lit(1), "upto")
    at = F.col("upto") - 1
    uses = F.ceil((F.col("begin") + F.col("length") - at) / F.col("lap")) - F.greatest(F.lit(0), F.ceil((F.col("begin") - at) / F.col("lap")))
    chosen = placed.join(F.broadcast(tape), ["pattern", "band"]).withColumn("uses", uses.cast("int")).where("uses > 0")
    return chosen.select("record", "source", "tokens", "uses").join(homes, ["record", "source"]).select("source", "doc_id", "tokens", "uses")


def spread_uses(flows: dict, bands: dict, targets: dict) -> list[tuple]:
    """(pattern, band, source, begin, uses): whole uses of the records of each size band that carry each flow.

    A flow takes the same part of every band, rounded to whole records from the largest band down; what rounding leaves
    over or lacks passes on to the smaller bands, so a source misses its quota by no more than small records.
    """
    out, begun = [], {}
    of: dict = {}
    for p, b in bands:
        of.setdefault(p, []).append(b)
    for (p, s), flow in sorted(flows.items()):
        left, ahead = float(flow), float(sum(bands[p, b][1] for b in of[p]))
        for b in sorted(of[p], reverse=True):
            number, tokens = bands[p, b]
            mean = tokens / number
            uses = min(int(left * tokens / ahead / mean + 0.5), number * targets[s][1]) if left > 0 else 0
            left -= uses * mean
            ahead -= tokens
            if uses:
                out.append((p, b, s, begun.get((p, b), 0), uses))
                begun[p, b] = begun.get((p, b), 0) + uses
    return out


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen documents of each source with their number of uses."""
    return mixed(spark, table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_share_report(spark: SparkSession, folder: str) -> DataFrame:
    """By listed source: target and actual share, tokens used, records used and the most uses of one."""
    targets = table(spark, folder, "mix_targets")
    by = p8_mix(spark, folder).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("uses").alias("most_uses"))
    total = by.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.join(by, "source", "left").crossJoin(F.broadcast(total))
    return joined.select(
        "source", "target_share", F.round(F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats"
    )


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """By listed source with documents: whether its tokens are its share of the mix, among these sources, to within a hundredth or the largest record of the mix, and the numbers (both 0) of records used too often and of documents not of the source."""
    targets, docs = table(spark, folder, "mix_targets"), table(spark, folder, "documents")
    mix = p8_mix(spark, folder)
    by = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t"), F.max("uses").alias("most"), F.max("tokens").alias("largest"))
    there = docs.where("text != ''").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    listed = targets.join(there, "source").join(by, "source", "left")
    whole = listed.agg(F.sum("t").alias("all_t"), F.sum("target_share").alias("all_share"), F.max("largest").alias("longest"))
    own = mix.join(docs.select("doc_id", F.col("source").alias("home")), "doc_id").where("home != source").groupBy("source").agg(F.count(F.lit(1)).alias("strangers"))
    quota = F.col("all_t") * F.col("target_share") / F.col("all_share")
    met = F.abs(F.coalesce("t", F.lit(0)) - quota) <= F.greatest(quota / 100, F.col("longest"))
    return listed.crossJoin(F.broadcast(whole)).join(own, "source", "left").select("source", F.coalesce(met, F.lit(False)).alias("share_met"), F.when(F.col("most") > F.col("max_repeats"), 1).otherwise(0).cast("bigint").alias("over_repeats"), F.coalesce("strangers", F.lit(0)).alias("strangers"))
