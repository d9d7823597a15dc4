"""Running state along a capture, cut into chunks: one window per chunk, and a carry from the chunks before.

A capture of any length so spreads over tasks; only a row per chunk meets in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: str, name: str, chunk: Column) -> DataFrame:
    """Row numbers from 0 in each key by order. chunk: grows with order."""
    df = df.withColumn("_chunk", chunk)
    counts = df.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(order)) - 1
    return df.withColumn("_own", own).join(base, [key, "_chunk"]).withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).drop("_own", "_base", "_chunk")


def lagged(df: DataFrame, keys: list[str], order: str, value: str, name: str, chunk: Column) -> DataFrame:
    """The value of the row before in each key; null at the first."""
    df = df.withColumn("_chunk", chunk)
    last = df.groupBy(*keys, "_chunk").agg(F.max_by(value, order).alias("_last"))
    carry = last.select(*keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    df = df.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    return df.join(carry, [*keys, "_chunk"]).withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop("_lag", "_first", "_carry", "_chunk")


def latest_before(df: DataFrame, key: str, values: dict[str, Column], span: int) -> DataFrame:
    """For each row the latest struct(seq, ts) of each of `values` (null where it does not apply) at a strictly earlier ts.

    Chunks are spans of ts, so that rows of one instant are never parted.
    """
    df = df.withColumn("_chunk", F.floor(F.col("ts") / span)).withColumns({f"_{k}": v for k, v in values.items()})
    last = df.groupBy(key, "_chunk").agg(*[F.max(f"_{k}").alias(f"_c_{k}") for k in values])
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(key, "_chunk", *[F.max(f"_c_{k}").over(before).alias(f"_c_{k}") for k in values])
    w = Window.partitionBy(key, "_chunk").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({k: F.max(f"_{k}").over(w) for k in values}).join(carry, [key, "_chunk"])
    return df.withColumns({k: F.coalesce(k, f"_c_{k}") for k in values}).drop("_chunk", *[f"_{k}" for k in values], *[f"_c_{k}" for k in values])
