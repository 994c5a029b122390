"""Ranks and running values over keys of any size: rows are dealt out by ranges of the order, and what earlier ranges hold is carried over.

A window over a key puts all its rows in one task; these put a range of them, and a row for
each key and range besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def dealt(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows written by ranges of keys and order, with ``_range``; ranges are in the order's order."""
    by = [F.col(k).asc() for k in keys] + order
    return staged(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), name)


def with_earlier(rows: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Dealt rows with ``values`` over the rows before each in its key: name to (count, min, max or last, column).

    ``last`` is the column's value in the row just before, which must be a struct that is never null.
    """
    own = Window.partitionBy(*keys, "_range").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    make = {"count": F.count, "min": F.min, "max": F.max}
    inside, whole, carried, joined = {}, [], {}, {}
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, column) in values.items():
        if kind == "last":
            inside[f"_in_{name}"] = F.lag(column).over(own)
            whole.append(F.max_by(column, F.col("_nth")).alias(f"_all_{name}"))
            carried[f"_pre_{name}"] = F.last(f"_all_{name}").over(ranges)
            joined[name] = F.coalesce(f"_in_{name}", f"_pre_{name}")
        else:
            inside[f"_in_{name}"] = make[kind](column).over(before)
            whole.append(make[kind](column).alias(f"_all_{name}"))
            over = F.sum if kind == "count" else make[kind]
            carried[f"_pre_{name}"] = over(f"_all_{name}").over(ranges)
            a, b = F.col(f"_in_{name}"), F.col(f"_pre_{name}")
            if kind == "count":
                joined[name] = a + F.coalesce(b, F.lit(0))
            else:
                better = a < b if kind == "min" else a > b
                joined[name] = F.when(b.isNull() | better, a).otherwise(b)
    rows = rows.withColumn("_nth", F.row_number().over(own)).withColumns(inside)
    totals = rows.groupBy(*keys, "_range").agg(*whole).withColumns(carried).select(*keys, "_range", *carried)
    found = rows.join(totals, [*keys, "_range"]).withColumns(joined)
    return found.drop("_nth", "_range", *inside, *carried)
