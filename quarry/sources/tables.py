"""Pages of any table: named columns, a condition, one order, limit and offset; with the number of rows that meet the condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, columns: Sequence[str] = (), where: str | None = None, order: str | None = None, desc: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
    """The columns (all if none are named) of a page of the rows that meet the condition, and `total`, how many do.

    Names are matched without regard to case and must be there, else ValueError. Without an order any rows may come. Ties
    of the order are broken by the other columns.
    """
    known = {c.lower(): c for c in df.columns}
    missing = [c for c in [*columns, *([order] if order else [])] if c.lower() not in known]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    names = [known[c.lower()] for c in columns] or df.columns
    rows = df.where(F.expr(where)) if where else df
    total = rows.agg(F.count("*").alias("total"))
    if order:
        first = F.col(known[order.lower()])
        rows = rows.orderBy(first.desc_nulls_last() if desc else first.asc_nulls_last(), *[c for c in names if c != known[order.lower()]])
    return rows.select(*names).offset(max(0, offset)).limit(max(0, limit)).join(F.broadcast(total))
