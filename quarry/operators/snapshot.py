"""Snapshot operators: the current row of each key, and merges of a stored snapshot with new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], newest: str, tie: Sequence[Column | str] = ()) -> DataFrame:
    """One row per key: the one with the greatest `newest`; ties go to the greatest `tie`.

    Null keys form one key together, a null `newest` is older than any other. The rank limit runs before the
    shuffle as well, so a key that holds a large part of all rows sends one row per task.
    """
    order = [F.col(newest).desc_nulls_last(), *(F.desc(t) if isinstance(t, str) else t.desc() for t in tie)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def beside(rows: DataFrame, key: str, order: str, columns: Sequence[str], ahead: bool = True, size: int = 1024) -> DataFrame:
    """rows with `__beside`, a struct of the columns of the next row (or the one before) of the same key, by a whole number.

    A key is cut into blocks of so many numbers, so one of a large part of all rows is many windows; what lies at the
    edge of a block comes from the next block's first row. Null keys and orders are left out; orders must not repeat in a key.
    """
    cut = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("__block", F.floor(F.col(order) / size))
    cell, step = F.struct(*columns), F.lead if ahead else F.lag
    near = step(cell).over(Window.partitionBy(key, "__block").orderBy(order))
    edge = (F.min_by if ahead else F.max_by)(cell, F.col(order))
    over = step("__edge").over(Window.partitionBy(key).orderBy("__block"))
    edges = cut.groupBy(key, "__block").agg(edge.alias("__edge")).withColumn("__over", over).drop("__edge")
    return cut.withColumn("__near", near).join(edges, [key, "__block"]).withColumn("__beside", F.coalesce("__near", "__over")).drop("__block", "__near", "__over")


def upsert(stored: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next snapshot: changed rows replace stored rows of equal key, other rows stay. Null keys match each other."""
    on = [stored[k].eqNullSafe(changed[k]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return stored.join(changed, condition, "left_anti").unionByName(changed)


def append_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows plus those new rows whose key is not there yet; repeated new keys are appended once."""
    fresh = new.dropDuplicates(list(keys))
    on = None
    for k in keys:
        c = fresh[k].eqNullSafe(stored[k])
        on = c if on is None else on & c
    return stored.unionByName(fresh.join(stored, on, "left_anti"))
