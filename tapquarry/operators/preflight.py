"""Triage of captures: how much of each can be analysed, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapquarry.operators.ordered import lagged

MAX_UNCLASSIFIED = 0.20
TOP_TYPES = 12
CHUNK_ROWS = 1_000_000


def unclassified_fraction(unclassified, total):
    return F.coalesce(F.try_divide(unclassified, total), F.lit(0.0))


def verdict(total, fraction, format_error=None):
    out = F.when(total == 0, "rejected_empty").when(fraction > MAX_UNCLASSIFIED, "coverage_gap").otherwise("analyzable")
    return out if format_error is None else F.when(format_error.isNotNull(), "format_rejected").otherwise(out)


def span_and_gap(rows: DataFrame, keys: list[str], order: str, ts: str) -> DataFrame:
    """keys, span_ns (last arrival minus first, not below 0), min_forward_gap_ns (null without a forward step)."""
    stepped = lagged(rows, keys, order, ts, "_was", F.floor(F.col(order) / CHUNK_ROWS))
    span = F.greatest(F.lit(0).cast("long"), F.max_by(ts, order) - F.min_by(ts, order))
    return stepped.groupBy(*keys).agg(span.alias("span_ns"), F.min(F.when(F.col(ts) > F.col("_was"), F.col(ts) - F.col("_was"))).alias("min_forward_gap_ns"))


def facts(decoded: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """A row per capture. captures: capture_id, format_error, ended_mid_record of files that may have no frames."""
    counts = decoded.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("parse_error").isNull()).alias("classifiable"), F.count_if(F.col("parse_error").isNotNull()).alias("unclassified"),
        F.count_if(F.length("raw") < 14).alias("malformed"), F.count_if("vlan").alias("vlan_frames"), F.count_if(F.col("incl_len") < F.col("orig_len")).alias("truncated_frames"),
        F.greatest(F.lit(0), F.max(F.col("incl_len") - F.col("orig_len"))).alias("max_excess_len"),
    ).join(span_and_gap(decoded, ["capture_id"], "frame_no", "tap_ts_ns"), "capture_id")
    if captures is not None:
        counts = captures.join(counts, "capture_id", "left")
    whole = ["total", "classifiable", "unclassified", "malformed", "vlan_frames", "truncated_frames", "span_ns"]
    counts = counts.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in whole})
    fraction = unclassified_fraction(F.col("unclassified"), F.col("total"))
    error = F.col("format_error") if captures is not None else None
    return counts.withColumn("unclassified_fraction", fraction).withColumn("verdict", verdict(F.col("total"), F.col("unclassified_fraction"), error))


def ethertypes(decoded: DataFrame, top: int = TOP_TYPES) -> DataFrame:
    """The most frequent EtherTypes of all frames, ties by type."""
    return decoded.where("ethertype is not null").groupBy("ethertype").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ethertype").limit(top)
