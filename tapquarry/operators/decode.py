"""Frames to flat columns, by expressions over BINARY: EtherType and one VLAN tag, cyclic I/O, IPv4, UDP, pose, TCP 102."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapquarry.functions.expressions import ETHERTYPE_CYCLIC, ETHERTYPE_IPV4, ETHERTYPE_VLAN, POSE_PORT, S7_PORT, be16, byte_at, float32, word32_le

COLUMNS = ["proto", "parse_error", "ethertype", "vlan", "frame_id", "status_byte", "interlock_bit", "dst_port", "payload_len", "x_mm", "y_mm", "z_mm", "s7_port"]


def held(df: DataFrame, name: str, **parts: Column) -> DataFrame:
    """Adds a struct that is computed once: a generator of one row, which the optimizer does not merge into what reads it.

    Merged, the steps repeat each other's expressions until the generated code is too large to compile.
    """
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in parts.items()]))).alias(name))


def decode(frames: DataFrame) -> DataFrame:
    """frames has `raw`; adds COLUMNS. A refused frame has its reason in parse_error and no protocol fields.

    ethertype is the tallied type: null below 14 bytes, the VLAN type where its tag is cut, else the inner type.
    """
    raw, n = F.col("raw"), F.length("raw")
    df = held(frames, "_e", outer=F.when(n >= 14, be16(raw, 12)), inner=F.when(n >= 18, be16(raw, 16)))
    vlan = F.coalesce(F.col("_e.outer") == ETHERTYPE_VLAN, F.lit(False))
    df = held(df, "_t", vlan=vlan, ethertype=F.when(vlan & (n >= 18), F.col("_e.inner")).otherwise(F.col("_e.outer")), l3=F.when(vlan, 18).otherwise(14))
    l3, et = F.col("_t.l3"), F.col("_t.ethertype")
    short = (n < 14) | (F.col("_t.vlan") & (n < 18))
    ip = ~short & (et == ETHERTYPE_IPV4) & (n >= l3 + 20)
    df = held(df, "_i", short=short, cyclic=et == ETHERTYPE_CYCLIC, ihl=F.when(ip, byte_at(raw, l3).bitwiseAND(F.lit(15))), proto=F.when(ip, byte_at(raw, l3 + 9)))
    l4 = l3 + F.col("_i.ihl") * 4
    good = F.coalesce((F.col("_i.ihl") >= 5) & (n >= l4 + 8), F.lit(False))
    df = held(df, "_p", l4=l4, good=good, src=F.when(good, be16(raw, l4)), dst=F.when(good, be16(raw, l4 + 2)), udp=F.when(good, be16(raw, l4 + 4)))
    l4, dst, udp, tcp = F.col("_p.l4"), F.col("_p.dst"), F.col("_p.udp"), F.col("_i.proto") == 6
    s7 = F.when(dst == S7_PORT, S7_PORT).when(F.col("_p.src") == S7_PORT, S7_PORT)
    error = (
        F.when(F.col("_i.short"), "truncated")
        .when(F.col("_i.cyclic") & (n < l3 + 3), "truncated")
        .when(F.col("_i.cyclic"), F.lit(None))
        .when(et != ETHERTYPE_IPV4, "unhandled_ethertype")
        .when(~F.col("_p.good"), "bad_ipv4")
        .when(tcp & s7.isNotNull(), F.lit(None))
        .when(F.col("_i.proto") != 17, "unhandled_ethertype")
        .when((udp < 8) | (n < l4 + udp), "bad_udp")
        .when((dst == POSE_PORT) & (udp - 8 < 12), "short_payload")
    )
    df = held(df, "_r", error=error, s7=s7)
    proto = F.when(F.col("_r.error").isNull(), F.when(F.col("_i.cyclic"), "cyclic").when(tcp, "s7").when(dst == POSE_PORT, "pose").otherwise("udp"))
    df = held(df, "_q", proto=proto)
    p = F.col("_q.proto")
    df = held(df, "_w", status=F.when(p == "cyclic", byte_at(raw, l3 + 2)), x=F.when(p == "pose", word32_le(raw, l4 + 8)), y=F.when(p == "pose", word32_le(raw, l4 + 12)), z=F.when(p == "pose", word32_le(raw, l4 + 16)))
    by_port = p.isin("udp", "pose")
    return df.withColumns({
        "proto": p,
        "parse_error": F.col("_r.error"),
        "ethertype": et,
        "vlan": F.col("_t.vlan"),
        "frame_id": F.when(p == "cyclic", be16(raw, l3)),
        "status_byte": F.col("_w.status"),
        "interlock_bit": F.col("_w.status").bitwiseAND(F.lit(1)) == 1,
        "dst_port": F.when(by_port, dst),
        "payload_len": F.when(by_port, udp - 8),
        "x_mm": float32(F.col("_w.x")),
        "y_mm": float32(F.col("_w.y")),
        "z_mm": float32(F.col("_w.z")),
        "s7_port": F.when(p == "s7", F.col("_r.s7")),
        "payload_at": F.when(p == "cyclic", l3 + 2),
    }).drop("_e", "_t", "_i", "_p", "_r", "_q", "_w")
