"""p7: mixing sources to target weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.packing import token_count
from quarry.session import written

#: Tokens of a block, the unit that is apportioned, and of a shard, the unit in which documents are ordered.
BLOCK_TOKENS, SHARD_TOKENS = 8, 4_000_000
SEED = 17


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients weight / (2 k + 1); no one gets more than its cap, ties go to the first.

    Equals giving seats one by one, but is found by bisection on the quotient of the last seat, so that its cost
    doesn't depend on the number of seats.
    """
    w = np.maximum(np.nan_to_num(np.asarray(weights, dtype=float)), 0)
    top = np.full(len(w), seats, dtype=np.int64) if caps is None else np.minimum(np.asarray(caps, dtype=np.int64), seats)
    top = np.where(w > 0, top, 0)
    if seats <= 0 or top.sum() <= seats:
        return np.maximum(top, 0) if seats > 0 else np.zeros(len(w), dtype=np.int64)

    def given(q: float) -> np.ndarray:  # seats whose quotient is above q
        return np.minimum(top, np.maximum(np.ceil((w / q - 1) / 2), 0).astype(np.int64))

    lo, hi = w.max() / (4 * seats + 4) / len(w), 2 * w.max()
    while given(lo).sum() < seats and lo > 1e-300:
        lo /= 4
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (lo, mid) if given(mid).sum() <= seats else (mid, hi)
    out = given(hi)
    while (missing := seats - int(out.sum())) > 0:
        quotient = np.where(out < top, w / (2 * out + 1), -1.0)
        for i in np.argsort(-quotient, kind="stable")[:missing]:
            if quotient[i] > 0 and (quotient[i] >= quotient.max() * (1 - 1e-12)):
                out[i] += 1
    return out


def mix(items: DataFrame, targets: DataFrame, item: str = "doc_id", size: str = "tokens", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Choose items so that each source of a mix supplies weight x total_share x the size of all items.

    items: item, source, size; targets: mix_id, source, weight, max_repeat, total_share. Sources are compared after
    trimming and case folding. Gives (selection, report). selection: mix_id, source, item, size, repeats (1 to
    max_repeat). report, a row per target row: needed, supply (both in size), quota (blocks), short (supply < needed).

    The blocks of a mix are apportioned among its sources and each source's blocks among its shards, both after
    Sainte-Lague; a shard gives whole rounds of its blocks and, for the rest, the items that lie in the blocks that
    follow a seeded one. What is then left of the quota is settled by one more item of the shard, that of the nearest size.
    A source that is short gives all it may. Items of null or unlisted source count in the total only; items of size null
    or 0 are never chosen. Null weights, shares or repeats count as 0. Repeated item rows are items of their own. items are
    written once and read from there.
    """
    fold = lambda c: F.lower(F.trim(c))
    wanted = targets.select(
        "mix_id", "source", fold("source").alias("key"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("weight", "max_repeat", "total_share")]
    ).toPandas()  # the mixes' definition, not data
    listed = sorted({k for k in wanted["key"] if k})
    kept = written(items.select(F.col(item), fold("source").alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__n")), "sizes")
    sums = {r[0]: r[1] for r in kept.groupBy(F.when(F.col("key").isin(listed), F.col("key")).alias("k")).agg(F.sum("__n")).collect()}
    total = sum(sums.values())
    shards = max(1, math.ceil(total / SHARD_TOKENS))

    wanted["needed"] = wanted["weight"] * wanted["total_share"] * total
    wanted["supply"] = [sums.get(k, 0) * r for k, r in zip(wanted["key"], wanted["max_repeat"])]
    wanted["short"] = wanted["supply"] < wanted["needed"]
    wanted["quota"] = 0
    for _, g in wanted.groupby("mix_id"):
        seats = round(g["needed"].sum() / BLOCK_TOKENS)
        caps = np.array([math.ceil(s / BLOCK_TOKENS) for s in g["supply"]])
        wanted.loc[g.index, "quota"] = np.minimum(sainte_lague(g["needed"].to_numpy(), seats), caps)

    rows = kept.where(F.col("key").isin(listed) & (F.col("__n") > 0)).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), item), F.lit(shards)))
    sized = rows.groupBy("key", "shard").agg(F.sum("__n").alias("tokens"))
    spark = items.sparkSession
    plan = [r for r in wanted[["mix_id", "source", "key", "quota", "max_repeat", "short"]].itertuples(index=False) if r.key]
    quotas = spark.createDataFrame([(r.mix_id, r.source, r.key, int(r.quota), int(r.max_repeat), bool(r.short)) for r in plan], "mix_id string, source string, key string, quota long, max_repeat long, short boolean")

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("shard")
        tokens, repeat = g["tokens"].to_numpy(), int(g["max_repeat"].iloc[0])
        caps = -(-tokens // BLOCK_TOKENS) * repeat
        seats = sainte_lague(tokens, int(g["quota"].iloc[0]), caps)
        wanted = np.minimum(seats * BLOCK_TOKENS, tokens * repeat)
        if g["short"].iloc[0]:
            wanted = tokens * repeat
        rounds = np.minimum(wanted // tokens, repeat)
        return g.assign(rounds=rounds, rest=np.where(rounds < repeat, wanted - rounds * tokens, 0))[["mix_id", "source", "key", "shard", "tokens", "rounds", "rest"]]

    per_shard = (
        sized.join(F.broadcast(quotas), "key").groupBy("mix_id", "source").applyInPandas(spread, "mix_id string, source string, key string, shard long, tokens long, rounds long, rest long")
    )
    order = Window.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), item), item)
    before = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    placed = rows.withColumn("__at", before).join(per_shard.where("rounds > 0 or rest > 0"), ["key", "shard"])
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "mix_id", "key", "shard"), F.col("tokens"))
    inside = (F.pmod(F.col("__at") - first, F.col("tokens")) + F.col("__n")) <= F.col("rest")
    shard = Window.partitionBy("mix_id", "source", "shard")
    gap = F.col("rest") - F.coalesce(F.sum(F.when(F.col("__in"), F.col("__n"))).over(shard), F.lit(0))
    fit = F.when(~F.col("__in") & (F.col("__n") < 2 * F.col("__gap")), F.abs(F.col("__n") - F.col("__gap")))
    best = F.row_number().over(shard.orderBy(F.asc_nulls_last("__fit"), F.xxhash64(F.lit(seed + 3), item), item))
    settled = placed.withColumn("__in", inside).withColumn("__gap", gap).withColumn("__fit", fit).withColumn("__best", (best == 1) & F.col("__fit").isNotNull())
    repeats = F.col("rounds") + (F.col("__in") | F.col("__best")).cast("long")
    chosen = settled.select("mix_id", "source", item, F.col("__n").alias(size), repeats.cast("int").alias("repeats")).where("repeats > 0")
    facts = spark.createDataFrame(
        [(r.mix_id, r.source, float(r.needed), float(r.supply), int(r.quota), bool(r.short), float(r.weight)) for r in wanted.itertuples(index=False)],
        "mix_id string, source string, needed double, supply double, quota long, short boolean, weight double",
    )
    return chosen, facts


def documents_mix(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    return mix(documents.select("doc_id", "source", token_count("text").alias("tokens")), targets)


def report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached: (mix_id, source, weight, needed, supply, reached, reached_share, short), a row per row of targets."""
    chosen, facts = documents_mix(documents, targets)
    reached = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached"))
    out = facts.join(reached, ["mix_id", "source"], "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    mine = F.sum("reached").over(Window.partitionBy("mix_id"))
    return out.select("mix_id", "source", "weight", "needed", "supply", "reached", F.when(mine > 0, F.col("reached") / mine).otherwise(0.0).alias("reached_share"), "short")


def found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source): target rows whose selection gave all that the source may give and still is below what is needed."""
    return report(documents, targets).where("reached < needed and reached >= supply").select("mix_id", "source")
