"""Timing profile of each stream: gaps, log-bucket histogram and its quantiles, toggling bits, rejected types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapquarry.functions.expressions import bucket_edge, ethertype_name, ethertype_status, log_bucket
from tapquarry.operators.ordered import lagged

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99, "p999": 0.999}
MIN_SAMPLES = 30
TOGGLES_SHOWN = 16
CHUNK_ROWS = 1_000_000


def streams(decoded: DataFrame) -> DataFrame:
    """Accepted frames with stream kind, its rank for reports, and id."""
    ok = decoded.where("parse_error is null")
    kind = F.when(F.col("proto") == "cyclic", "cyclic").when(F.col("proto") == "s7", "s7").otherwise("udp")
    stream = F.when(F.col("proto") == "cyclic", F.col("frame_id")).when(F.col("proto") == "s7", F.col("s7_port")).otherwise(F.col("dst_port"))
    return ok.withColumns({"kind": kind, "kind_rank": F.when(kind == "cyclic", 0).when(kind == "udp", 1).otherwise(2), "stream_id": stream})


def gaps(rows: DataFrame, keys: list[str], order: str = "frame_no", ts: str = "tap_ts_ns") -> DataFrame:
    """Adds gap_ns to the row before in the stream, 0 where time runs backward; null at the first row."""
    out = lagged(rows, keys, order, ts, "_was", F.floor(F.col(order) / CHUNK_ROWS))
    return out.withColumn("gap_ns", F.when(F.col("_was").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col(ts) - F.col("_was")))).drop("_was")


def gap_stats(with_gaps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frames, gap_count, gap_min, gap_max, gap_mean (whole ns; 0 without gaps)."""
    zero = F.lit(0).cast("long")
    total = F.sum(F.col("gap_ns").cast("decimal(38,0)"))
    return with_gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count("gap_ns").alias("gap_count"), F.coalesce(F.min("gap_ns"), zero).alias("gap_min"),
        F.coalesce(F.max("gap_ns"), zero).alias("gap_max"), F.coalesce(F.floor(total / F.count("gap_ns")).cast("long"), zero).alias("gap_mean"),
    )


def buckets(with_gaps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket, bucket_lo, n: at most 512 rows a stream."""
    counted = with_gaps.where("gap_ns is not null").withColumn("bucket", log_bucket(F.col("gap_ns"))).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("bucket_lo", bucket_edge(F.col("bucket"))).select(*keys, "bucket", "bucket_lo", "n")


def quantiles(with_gaps: DataFrame, keys: list[str], wanted: dict[str, float] = QUANTILES, least: int = MIN_SAMPLES) -> DataFrame:
    """keys and a column per quantile: the lower edge of the first bucket that reaches its rank, within [min, max]; null under `least` gaps."""
    stats = gap_stats(with_gaps, keys)
    w = Window.partitionBy(*keys).orderBy("bucket")
    cum = buckets(with_gaps, keys).withColumn("cum", F.sum("n").over(w)).join(stats, keys)
    out = []
    for name, q in wanted.items():
        rank = F.greatest(F.lit(1.0), F.least(F.ceil(F.lit(float(q)) * F.col("gap_count")).cast("double"), F.col("gap_count").cast("double")))
        out.append(F.min(F.when(F.col("cum") >= rank, F.col("bucket_lo"))).alias(name))
    found = cum.groupBy(*keys, "gap_count", "gap_min", "gap_max").agg(*out)
    clamped = {n: F.when(F.col("gap_count") >= least, F.least(F.greatest(F.col(n), F.col("gap_min")), F.col("gap_max"))) for n in wanted}
    return found.withColumns(clamped).select(*keys, *wanted)


def toggles(cyclic: DataFrame, keys: list[str]) -> DataFrame:
    """keys, byte_index, bit_index of bits that are not constant, within the first payload's length.

    cyclic: rows with `payload` (BINARY) and `frame_no`. A row per eight bytes of a payload folds with or and and; a bit
    toggles if the two differ. Bytes beyond a payload's end count in neither.
    """
    each = cyclic.select(*keys, "frame_no", F.length("payload").alias("size"), "payload", F.expr("explode(sequence(0, greatest(0, length(payload) - 1) div 8))").alias("word"))
    part = F.hex(F.expr("substring(payload, word * 8 + 1, 8)"))
    fold = lambda fill: F.conv(F.rpad(part, 16, fill), 16, -10).cast("long")
    masks = each.groupBy(*keys, "word").agg(F.bit_or(fold("0")).alias("o"), F.bit_and(fold("F")).alias("a"), F.min_by("size", "frame_no").alias("first_len"))
    first = masks.groupBy(*keys).agg(F.max(F.when(F.col("word") == 0, F.col("first_len"))).alias("first_size"))
    masks = masks.join(first, keys).withColumn("mask", F.expr("o ^ a"))
    bits = F.expr("filter(transform(sequence(0, 63), b -> named_struct('byte_index', cast(word * 8 + b div 8 as int), 'bit_index', b % 8, 'set', (shiftrightunsigned(mask, (7 - cast(b div 8 as int)) * 8 + b % 8) & 1) = 1)), x -> x.set and x.byte_index < first_size)")
    return masks.select(*keys, F.explode(bits).alias("b")).select(*keys, "b.byte_index", "b.bit_index")


def profile(decoded: DataFrame) -> DataFrame:
    """A row per stream in report order: counts, gap figures, quantiles, toggling (byte, bit) pairs of cyclic streams."""
    keys = ["capture_id", "kind_rank", "kind", "stream_id"]
    rows = gaps(streams(decoded), keys)
    cyclic = rows.where("kind = 'cyclic'").withColumn("payload", F.expr("substring(raw, payload_at + 1)"))
    pairs = toggles(cyclic, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("byte_index", "bit_index"))).alias("toggles"))
    out = gap_stats(rows, keys).join(quantiles(rows, keys), keys, "left").join(pairs, keys, "left")
    return out.orderBy("capture_id", "kind_rank", "stream_id")


def report(profiles: DataFrame, shown: int = TOGGLES_SHOWN) -> DataFrame:
    """The profile with `toggles` as text, byte.bit, the first `shown` of them, and how many there are."""
    text = F.transform(F.slice(F.col("toggles"), 1, shown), lambda x: F.concat_ws(".", x["byte_index"], x["bit_index"]))
    return profiles.withColumn("n_toggles", F.coalesce(F.size("toggles"), F.lit(0))).withColumn("toggles", F.array_join(text, " "))


def rejected(decoded: DataFrame) -> DataFrame:
    """capture_id, ethertype (null: malformed), its name and status, n of refused frames, most frequent first."""
    counted = decoded.where("parse_error is not null").groupBy("capture_id", "ethertype").agg(F.count(F.lit(1)).alias("n"))
    et = F.col("ethertype")
    named = counted.select("capture_id", "ethertype", F.when(et.isNull(), "malformed").otherwise(ethertype_name(et)).alias("name"), F.when(et.isNull(), "unsupported").otherwise(ethertype_status(et)).alias("status"), "n")
    return named.orderBy("capture_id", F.desc("n"), "ethertype")
