"""Equi joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of fewer rows than this are never salted; a salt gets about so many rows.
HOT_ROWS = 20_000
#: Keys salted at most, those of most rows: any other holds less than a 1/HOT_KEYS part of the rows.
HOT_KEYS, SALTS = 1024, 1024


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> dict:
    """{key: salts} of the keys with at least `rows` rows; at most HOT_KEYS rows reach the driver."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    salts = F.least(F.lit(SALTS), F.ceil(F.col("count") / rows)).cast("int")
    top = counts.where(F.col("count") >= rows).orderBy(F.desc("count"), key).limit(HOT_KEYS).select(key, salts).collect()
    return {r[0]: r[1] for r in top}


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int = HOT_ROWS) -> DataFrame:
    """left join right on `key`, where left may have hot keys: their rows get a salt, right rows one copy per salt.

    Results equal the plain join's (inner or left). Null keys match nothing.
    """
    hot = hot_keys(left, key, rows)
    if not hot:
        return left.join(right, key, how)
    known = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), f"{key} {left.schema[key].dataType.simpleString()}, __salts int"))
    of = F.coalesce("__salts", F.lit(1))
    salted = left.join(known, key, "left").withColumn("__salt", F.floor(F.rand(7) * of).cast("int")).drop("__salts")
    copies = right.join(known, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), of - 1))).drop("__salts")
    return salted.join(copies, [key, "__salt"], how).drop("__salt")
