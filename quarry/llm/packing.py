"""p6: filling containers of fixed capacity with texts of varying length."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import written

#: The size of a text is the number of matches of this; fixed by the data's definition of a token.
TOKEN = "[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\r\\n]"
#: Rows of one size class are numbered in so many shards at least, and in one more per SHARD_ROWS rows.
SHARDS, SHARD_ROWS = 16, 1_000_000


def token_count(text: Column | str) -> Column:
    """Size of a text in tokens; a null text has size 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _complement(free: np.ndarray, gap: int, sizes: np.ndarray) -> tuple[int, ...]:
    """One, two or three available sizes whose sum is just gap, the most plentiful first; () if there are none."""

    def two(g: int, taken: int = 0) -> tuple[int, ...]:
        if g < 2:
            return ()
        a = np.arange(1, g // 2 + 1)
        n = free[a]
        m = free[g - a]
        if taken:
            n, m = n - (a == taken), m - (g - a == taken)
        both = np.minimum(n, m)
        if g % 2 == 0:
            both[-1] //= 2
        k = int(both.argmax())
        return (int(a[k]), int(g - a[k])) if both[k] > 0 else ()

    if free[gap] > 0:
        return (gap,)
    if pair := two(gap):
        return pair
    for c in sizes[np.argsort(-free[sizes], kind="stable")]:
        if free[c] > 0 and c < gap and (pair := two(gap - int(c), int(c))):
            return (int(c), *pair)
    return ()


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """How many items of each size go where: rows (size, first, end, each, container).

    Items number first to end - 1 of that size go, `each` to a container, into the containers from `container` on.
    Works on the number of items per size alone, so its work is bounded by the capacity, not by the items. Each
    pattern starts with the largest size left, is filled with the largest that fit until three sizes can fill the gap,
    then completed with sizes that fill it exactly, else with the largest that fit (best fit). A pattern is used as
    often as the counts allow.
    """
    free = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in counts.items():
        if 0 < s <= capacity:
            free[s] = n
    used = Counter()
    rows, container = [], 0
    while (sizes := np.flatnonzero(free)).size:
        left = free.copy()
        pattern: Counter[int] = Counter()

        def take(s: int, n: int = 1) -> int:
            pattern[s] += n
            left[s] -= n
            return n * s

        gap = capacity - take(int(sizes[-1]))
        while gap > 0:
            fits = np.flatnonzero(left[: gap + 1])
            if not fits.size:
                break
            top = int(fits[-1])
            if gap > 3 * top:
                gap -= take(top, int(min(left[top], max(1, gap // top - 3))))
            elif exact := _complement(left, gap, fits):
                for s in exact:
                    gap -= take(s)
            else:
                gap -= take(top)
        times = int(min(free[s] // n for s, n in pattern.items()))
        for s, n in pattern.items():
            rows.append((s, used[s], used[s] + n * times, n, container))
            used[s] += n * times
            free[s] -= n * times
        container += times
    return rows


def pack(sizes: DataFrame, containers: DataFrame, item: str = "doc_id", size: str = "size") -> DataFrame:
    """(container_id, container_no, item, piece, pieces, tokens): every item assigned for every capacity.

    An item larger than the capacity is divided into pieces that fill a container each and a rest; others stay whole.
    Items of size 0 are spread over the containers (over number 0 if there is none). Repeated rows are items of their
    own; a null size counts as 0; null or non-positive capacities and repeated container ids after the first are left out.
    Only numbers of items per size reach the driver, at most one row per size up to the capacity.
    """
    spark = sizes.sparkSession
    caps = {r[0]: r[1] for r in reversed(containers.where("capacity > 0").select("container_id", "capacity").orderBy("container_id", "capacity").collect())}
    if not caps:
        return spark.createDataFrame([], f"container_id string, container_no long, {item} {sizes.schema[item].dataType.simpleString()}, piece int, pieces int, tokens long")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(int(v)).cast("long").alias("cap")) for k, v in caps.items()]))
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    sizes = written(sizes.select(item, n.alias("__size")), "sizes")  # texts are measured once
    items = sizes.select(item, "__size", each.alias("__c"))
    pieces = F.greatest(F.ceil(F.col("__size") / F.col("__c.cap")), F.lit(1)).cast("int")
    items = items.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    last = F.col("piece") == F.col("pieces") - 1
    items = items.select(
        F.col("__c.id").alias("container_id"), item, "piece", "pieces",
        F.when(last, F.col("__size") - F.col("piece") * F.col("__c.cap")).otherwise(F.col("__c.cap")).alias("tokens"),
    )
    shards = max(SHARDS, math.ceil(sizes.count() / SHARD_ROWS))
    items = items.withColumn("__shard", F.pmod(F.xxhash64(item, "piece"), F.lit(shards)))
    classes = items.groupBy("container_id", "tokens", "__shard").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("container_id", "tokens").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = classes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    number = F.row_number().over(Window.partitionBy("container_id", "tokens", "__shard").orderBy(item, "piece"))
    numbered = items.withColumn("__k", number - 1).join(offsets, ["container_id", "tokens", "__shard"]).withColumn("__k", F.col("__k") + F.col("__before"))

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (c,), g in pd.concat([pd.DataFrame(columns=["container_id", "tokens", "n"]), *frames]).groupby(["container_id"]):
            rows = plan_containers(dict(zip(g["tokens"].astype(int), g["n"].astype(int))), caps[c])
            yield pd.DataFrame([(c, *r) for r in rows], columns=["container_id", "size", "first", "end", "each", "container"])

    ids = {k: i for i, k in enumerate(caps)}
    number_of = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    totals = classes.groupBy("container_id", "tokens").agg(F.sum("__n").alias("n")).withColumn("__id", number_of[F.col("container_id")])
    spread = totals.repartitionById(len(caps), "__id").select("container_id", "tokens", "n")  # a container's plan to a task
    planned = spread.mapInPandas(plan, "container_id string, size long, first long, end long, each long, container long").toPandas()
    look: dict[int, tuple] = {}
    for c, g in planned.groupby("container_id"):
        g = g.sort_values(["size", "first"])
        end = int((g["container"] + (g["end"] - g["first"]) // g["each"]).max())
        look[ids[c]] = (end, {s: (h["first"].to_numpy(), h["each"].to_numpy(), h["container"].to_numpy()) for s, h in g.groupby("size")})
    plans = spark.sparkContext.broadcast(look)

    @F.pandas_udf("long")
    def place(c: pd.Series, size: pd.Series, k: pd.Series) -> pd.Series:
        out = np.zeros(len(c), dtype=np.int64)
        frame = pd.DataFrame({"c": c, "s": size, "k": k}).reset_index(drop=True)
        for (ci, s), g in frame.groupby(["c", "s"]):
            total, by_size = plans.value.get(ci, (0, {}))
            x = g["k"].to_numpy()
            if s in by_size:
                first, per, base = by_size[s]
                i = np.searchsorted(first, x, side="right") - 1
                out[g.index] = base[i] + (x - first[i]) // per[i]
            elif total:
                out[g.index] = x % total
        return pd.Series(out)

    return numbered.select("container_id", place(number_of[F.col("container_id")], "tokens", "__k").alias("container_no"), item, "piece", "pieces", "tokens")


def assignments(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """pack over the documents' texts, sized in tokens."""
    return pack(documents.select("doc_id", token_count("text").alias("size")), containers)


def fill(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, containers, tokens, fill): how many containers of each kind are used and how full they are."""
    per = assignments(documents, containers).groupBy("container_id", "container_no").agg(F.sum("tokens").alias("tokens"))
    total = per.where("tokens > 0").groupBy("container_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    share = F.col("tokens") / (F.col("containers") * F.col("capacity"))
    return total.join(containers, "container_id").select("container_id", "containers", "tokens", F.round(share, 6).alias("fill"))


def found(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, doc_id): documents whose pieces lie in more than one container of the kind."""
    spread = assignments(documents, containers).where("pieces > 1").groupBy("container_id", "doc_id", "pieces")
    apart = spread.agg(F.min("container_no").alias("lo"), F.max("container_no").alias("hi")).where("lo < hi")
    return apart.select("container_id", "doc_id").distinct()
