"""Filling fixed-capacity containers with texts (problem 7): vector bin packing by dot products.

A piece (a text, or a capacity's worth of a longer one) uses tokens, one segment and its loss-bearing tokens; containers
limit all three. An open container takes the piece that fits and whose use, measured in limits, has the largest dot
product with what the container has left beyond its fair share: were every container to use as many segments as the
pieces left need on average, each would by then have used a certain share of its space. So large and small pieces are
used up together, and segments don't run out on small ones in the end. How far the fair share counts is tried in a few
ways; the one with the fewest containers stays. A text within the capacity is never cut, so a piece that alone bears more loss
than the limit gets a container of its own, where only pieces without loss may join it.

Pieces are packed in shards of bounded size; the pieces of containers that a shard leaves unfilled are pooled and packed
again, so at most the containers of the last round that are not full, one or few a shard, cost space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.tokens import sized
from tabulon.session import table
from tabulon.workspace import Workspace

#: Pieces of a shard, on average.
SHARD = 8192
#: Containers of which no limit is used by this share are packed again, in all rounds but the last.
FULL = 0.995
ROUNDS = 3
#: Segments of a container, in mean pieces of a full one; and how far the limit on loss-bearing tokens lies between
#: their mean share (0) and the capacity (1).
SEGMENTS, LOSS = 2.5, 0.9
#: How far the fair share counts.
FAIR = (0.0, 0.5, 1.0)
Limit = tuple[int, int, int]


def limits_of(pieces: DataFrame, segments: float = SEGMENTS, loss: float = LOSS) -> dict[str, Limit]:
    """By window the tokens, segments and loss-bearing tokens of a container, from the totals of all its pieces."""
    sums = pieces.groupBy("window_name", "capacity").agg(F.count(F.lit(1)), F.sum("tokens"), F.sum("loss_tokens")).collect()  # one row a window
    return {w: (c, max(2, math.ceil(segments * n * c / t)), min(c, max(1, math.ceil(c * (el / t + loss * (1 - el / t)))))) for w, c, n, t, el in sums if t}


def pieces_of(sizes: DataFrame, windows: list[tuple[str, int]]) -> DataFrame:
    """(window_name, capacity, doc_id, piece, first_token, tokens, loss_tokens): texts within a capacity whole, larger ones cut at its multiples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, parts, loss in zip(pdf["doc_id"], pdf["sizes"], pdf["loss"]):
                ends = np.cumsum(parts)
                total = int(ends[-1])
                bearing = np.concatenate([[0], np.cumsum(np.where(loss, parts, 0))])
                edges = np.concatenate([[0], ends])
                for name, capacity in windows:
                    for k, start in enumerate(range(0, total, capacity)):
                        stop = min(total, start + capacity)
                        # loss-bearing tokens before a position, linear within a part
                        a, b = np.interp([start, stop], edges, bearing)
                        out.append((name, capacity, doc, k, start, stop - start, int(round(b)) - int(round(a))))
            yield pd.DataFrame(out, columns=["window_name", "capacity", "doc_id", "piece", "first_token", "tokens", "loss_tokens"])

    return sizes.mapInPandas(run, "window_name string, capacity int, doc_id bigint, piece int, first_token int, tokens int, loss_tokens int")


def pack(tokens: np.ndarray, loss: np.ndarray, limit: Limit) -> np.ndarray:
    """The container number of each piece; of the ways to count the fair share the one with the fewest containers."""
    return min((_packed_with(tokens, loss, limit, f) for f in FAIR), key=lambda box: box.max(initial=-1))


def _packed_with(tokens: np.ndarray, loss: np.ndarray, limit: Limit, fairness: float) -> np.ndarray:
    """Pieces alike are one type with a stock; types are kept by falling tokens."""
    order = np.lexsort((-loss, -tokens))
    t, el = tokens[order].astype(float), loss[order].astype(float)
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (el[1:] != el[:-1])
    first = np.flatnonzero(new)
    stock = np.diff(np.append(first, len(t)))
    nxt = first.copy()
    tt, tl = t[first], el[first]
    box = np.empty(len(t), np.int64)
    left, number = len(t), 0
    open_tokens, open_loss = t.sum(), el.sum()
    T, S, L = (float(x) for x in limit)
    over = list(np.flatnonzero(tl > L))  # each of these opens a container

    def take(k: int) -> None:
        nonlocal left, open_tokens, open_loss
        box[order[nxt[k]]] = number
        nxt[k] += 1
        stock[k] -= 1
        left -= 1
        open_tokens -= tt[k]
        open_loss -= tl[k]

    while left:
        fair = min(S, max(1.0, left / max(open_tokens / T, open_loss / L, 1e-9)))
        rt, rs, rl = T, S, L
        if over:
            k = over[0]
            take(k)
            rt, rs, rl = rt - tt[k], rs - 1, 0.0
            if not stock[k]:
                over.pop(0)
        while left and rs >= 1 and rt >= 1:
            lo = np.searchsorted(-tt, -rt)  # types too large come first
            fit = (stock[lo:] > 0) & (tl[lo:] <= rl)
            if not fit.any():
                break
            share = fairness * (1 - (S - rs) / fair) if rs < S else 0.0
            score = np.where(fit, tt[lo:] * ((rt / T - share) / T) + tl[lo:] * ((rl / L - share) / L), -np.inf)  # segments count alike for all
            k = lo + int(score.argmax())
            take(k)
            rt, rs, rl = rt - tt[k], rs - 1, rl - tl[k]
        number += 1
        if not over and len(stock) > 64 and (stock > 0).sum() * 2 < len(stock):
            keep = stock > 0
            tt, tl, stock, nxt = tt[keep], tl[keep], stock[keep], nxt[keep]
    return box


def _packer(k: int, final: bool, full: float, limit_of: dict[str, Limit]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        name = pdf["window_name"].iloc[0]
        tokens, loss = pdf["tokens"].to_numpy(), pdf["loss_tokens"].to_numpy()
        box = pack(tokens, loss, limit_of[name])
        used = [np.bincount(box, weights=w) / most for w, most in zip((tokens, np.ones(len(box)), loss), limit_of[name])]
        pdf["container_id"] = [f"{name}-{k}-{pdf['shard'].iloc[0]}-{b}" for b in box]
        pdf["closed"] = (np.maximum.reduce(used)[box] >= full) | final
        return pdf.drop(columns="shard")

    return run


def packed(spark: SparkSession, pieces: DataFrame, limit_of: dict[str, Limit] | None = None, shard: int = SHARD, full: float = FULL, rounds: int = ROUNDS) -> DataFrame:
    """pieces with container_id and the limits; every piece is in one container, none is empty, none is over a limit (but
    for a piece that alone bears more loss). ``limit_of``: the limits by window, else those of ``limits_of``. Pieces of
    windows without a limit, and no pieces, give no rows."""
    ws = Workspace(spark, "packing")
    rest = ws.stage(pieces)
    limit_of = limits_of(rest) if limit_of is None else limit_of
    rest = rest.where(F.col("window_name").isin(list(limit_of)))
    done = None
    for k in range(rounds):
        numbers = {r[0]: r[1] for r in rest.groupBy("window_name").agg(F.count(F.lit(1))).collect()}  # one row a window
        if not numbers:
            break
        final = k == rounds - 1 or all(n <= shard for n in numbers.values())
        shards = F.coalesce(*[F.when(F.col("window_name") == w, F.lit(max(1, -(-n // shard)))) for w, n in numbers.items()])

        schema = "window_name string, capacity int, doc_id bigint, piece int, first_token int, tokens int, loss_tokens int, container_id string, closed boolean"
        spread = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(k)), shards).cast("int"))
        # shards are small but costly, so they are dealt to tasks by number, not by bytes
        tasks = min(sum(max(1, -(-n // shard)) for n in numbers.values()), 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
        spread = spread.repartition(tasks, "window_name", "shard")
        boxed = ws.stage(spread.groupBy("window_name", "shard").applyInPandas(_packer(k, final, full, limit_of), schema))
        closed = boxed.where("closed").drop("closed")
        done = closed if done is None else done.unionByName(closed)
        if final:
            break
        rest = boxed.where("NOT closed").drop("closed", "container_id")
    done = done if done is not None else rest.withColumn("container_id", F.lit(None).cast("string"))
    stated = spark.createDataFrame([(w, s, el) for w, (_, s, el) in limit_of.items()], "window_name string, most_segments int, most_loss int")
    return done.join(F.broadcast(stated), "window_name")  # one row a window


def _windows(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    return [(r[0], r[1]) for r in table(spark, folder, "context_windows").select("window_name", "capacity_tokens").collect()]  # does not grow


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every piece of every text, for each capacity."""
    sizes = sized(table(spark, folder, "documents"))
    return packed(spark, pieces_of(sizes, _windows(spark, folder))).drop("capacity", "most_segments", "most_loss")


def containers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pieces with their containers; and one row a container with what it holds."""
    ws = Workspace(spark, "containers")
    boxed = ws.stage(packed(spark, pieces_of(sized(table(spark, folder, "documents")), _windows(spark, folder))))
    per = boxed.groupBy("window_name", "capacity", "most_segments", "most_loss", "container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))
    return boxed, per


def p7_space_report(spark: SparkSession, folder: str) -> DataFrame:
    """By capacity: the limits, pieces, containers, the fewest containers each limit alone would allow, how many are full by
    each limit, and the share of token space left unused."""
    per = containers(spark, folder)[1]
    most = {"tokens": F.col("capacity"), "pieces": F.col("most_segments"), "loss_tokens": F.col("most_loss")}
    by = per.groupBy("window_name", "capacity", "most_segments", "most_loss").agg(
        F.sum("pieces").alias("pieces"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"),
        *[F.count_if(F.col(c) >= FULL * m).alias(f"full_by_{c}") for c, m in most.items()],
    )
    bounds = {f"least_by_{c}": F.ceil(F.col(c) / m).cast("bigint") for c, m in most.items()}
    return by.withColumns(bounds).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """By capacity: texts packed, and the numbers (all 0) of containers over a limit, of texts cut though they would fit, and of texts whose pieces leave gaps or overlap."""
    boxed, per = containers(spark, folder)
    over = (F.col("tokens") > F.col("capacity")) | (F.col("pieces") > F.col("most_segments")) | ((F.col("loss_tokens") > F.col("most_loss")) & (F.col("pieces") > 1) & (F.col("alone") == 0))
    alone = boxed.groupBy("container_id").agg(F.count_if(F.col("loss_tokens") > F.col("most_loss")).alias("alone"))
    boxes = per.join(alone, "container_id").groupBy("window_name", "capacity").agg(F.count_if(over).alias("over_limit"))
    texts = boxed.groupBy("window_name", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    by = texts.groupBy("window_name", "capacity").agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("cut_small"), F.count_if(F.col("t") != F.col("end")).alias("gaps"))
    return by.join(boxes, ["window_name", "capacity"])
