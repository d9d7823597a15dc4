"""Scalar expressions: bytes of a frame, log buckets, durations, lookups. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Protocol numbers and names.
ETHERTYPE_CYCLIC, ETHERTYPE_IPV4, ETHERTYPE_VLAN = 0x8892, 0x0800, 0x8100
ETHERTYPE_NAMES = {0x0800: "IPv4", 0x0806: "ARP", 0x8100: "VLAN", 0x86DD: "IPv6", 0x8892: "Profinet RT", 0x88CC: "LLDP"}
POSE_PORT, S7_PORT = 60008, 102
#: Jitter floor by where timestamps come from, in ns.
JITTER_FLOOR_NS = {"hardware": 1_000, "kernel": 100_000, "replay": 0}


def lit_long(x: int) -> Column:
    return F.lit(x).cast("long")


def byte_at(raw: Column, at) -> Column:
    """The byte at a 0-based place, as an int."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int")


def be16(raw: Column, at) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(raw, at + 1, F.lit(2))), 16, 10).cast("int")


def word32_le(raw: Column, at) -> Column:
    """Four little-endian bytes as a whole number."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.concat(*[F.hex(F.substring(raw, at + i, F.lit(1))) for i in (4, 3, 2, 1)]), 16, 10).cast("long")


def float32(bits: Column) -> Column:
    """The IEEE-754 single of 32 bits, infinities and NaN included."""
    sign = F.when(bits >= 1 << 31, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255)).cast("int")
    mantissa = bits.bitwiseAND(F.lit((1 << 23) - 1).cast("long"))
    normal = sign * F.pow(F.lit(2.0), (exponent - 127).cast("double")) * (1 + mantissa / F.lit(8388608.0))
    small = sign * mantissa * F.pow(F.lit(2.0), F.lit(-149.0))
    special = F.when(mantissa > 0, F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(exponent == 255, special).when(exponent == 0, small).otherwise(normal).cast("float")


def bit_of(status: Column, bit: Column) -> Column:
    return F.expr("1") == F.call_function("shiftright", status, bit).bitwiseAND(F.lit(1))


def log_bucket(v: Column) -> Column:
    """Eight buckets for each power of two; 0 and 1 share bucket 0."""
    band = F.length(F.bin(v)) - 1
    rest = v - F.call_function("shiftleft", lit_long(1), band)
    sub = F.when(band >= 3, F.call_function("shiftright", rest, band - 3)).otherwise(F.call_function("shiftleft", rest, 3 - band))
    return F.when(v == 0, lit_long(0)).otherwise(band * 8 + sub).cast("int")


def bucket_edge(i: Column) -> Column:
    """The least value of a bucket, 0 for bucket 0."""
    band, sub = F.expr("0") + F.floor(i / 8).cast("int"), (i % 8).cast("long")
    part = F.when(band >= 3, F.call_function("shiftleft", sub, band - 3)).otherwise(F.shiftright(F.call_function("shiftleft", sub, band), 3))
    return F.when(i == 0, lit_long(0)).otherwise(F.call_function("shiftleft", lit_long(1), band) + part)


def format_duration(ns: Column) -> Column:
    """Milliseconds with three places from 1e6 ns on, microseconds with one from 1e3 on, else ns. Whole arithmetic: halves round up."""
    us, tenths = F.floor((ns + 500) / 1000), F.floor((ns + 50) / 100)
    ms = F.format_string("%d.%03d ms", F.floor(us / 1000), us % 1000)
    return F.when(ns >= 1_000_000, ms).when(ns >= 1_000, F.format_string("%d.%d us", F.floor(tenths / 10), tenths % 10)).otherwise(F.format_string("%d ns", ns))


def jitter_floor(source: Column) -> Column:
    out = lit_long(0)
    for k, v in JITTER_FLOOR_NS.items():
        out = F.when(source == k, lit_long(v)).otherwise(out)
    return out


def ethertype_name(et: Column) -> Column:
    out = F.lit("other")
    for k, v in ETHERTYPE_NAMES.items():
        out = F.when(et == k, v).otherwise(out)
    return out


def ethertype_status(et: Column) -> Column:
    return F.when(et == ETHERTYPE_CYCLIC, "supported").when(et == ETHERTYPE_IPV4, "partial").otherwise("unsupported")


def evidence_key(ts: Column, trace_id: Column) -> Column:
    """Big-endian time, then the id: sorts as (time, id)."""
    return F.concat(F.unhex(F.lpad(F.hex(ts), 16, "0")), F.encode(trace_id, "UTF-8"))
