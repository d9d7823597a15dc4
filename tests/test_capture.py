import io
import json
import struct

import pytest

from tapquarry.__main__ import main
from tapquarry.operators import decode, discovery, evidence, manifest, preflight
from tapquarry.operators.manifest import ManifestError
from tapquarry.plans import attribution as A
from tapquarry.sources import pcap
from tapquarry.sources.store import DuplicateEvidence, EvidenceMemory, EvidenceStore

MS = 1_000_000
ETHER = bytes(12)


def udp(port, payload, ihl=5, length=None):
    return ETHER + b"\x08\x00" + bytes([0x40 | ihl]) + bytes(8) + b"\x11" + bytes(10 + 4 * (ihl - 5)) + bytes(2) + struct.pack(">HH", port, 8 + len(payload) if length is None else length) + bytes(2) + payload


def tcp(src, dst):
    return ETHER + b"\x08\x00\x45" + bytes(8) + b"\x06" + bytes(10) + struct.pack(">HH", src, dst) + bytes(16)


def frames(spark, raws):
    return spark.createDataFrame([("c", i, i * MS, len(r), len(r), bytearray(r)) for i, r in enumerate(raws)], "capture_id string, frame_no long, tap_ts_ns long, incl_len int, orig_len int, raw binary")


def test_decode_cases(spark):
    cases = [
        ((ETHER + struct.pack(">HHB", 0x8892, 2, 5)).ljust(60, b"\0"), "cyclic", None),
        (ETHER + b"\x81\x00\x00\x01" + struct.pack(">HHB", 0x8892, 2, 4), "cyclic", None),
        (bytes(8), None, "truncated"),
        (ETHER + b"\x81\x00\x00", None, "truncated"),
        (ETHER + struct.pack(">HH", 0x8892, 2), None, "truncated"),
        (ETHER + b"\x88\xa4" + bytes(40), None, "unhandled_ethertype"),
        (udp(7400, bytes(32)), "udp", None),
        (udp(7400, bytes(32), ihl=7), "udp", None),
        (udp(60008, struct.pack("<fff", 100.5, -200, 0.1)), "pose", None),
        (udp(60008, struct.pack("<fff", float("inf"), float("nan"), 1e-40)), "pose", None),
        (udp(60008, bytes(8)), None, "short_payload"),
        (udp(7400, bytes(4), length=7), None, "bad_udp"),
        (udp(7400, bytes(4), length=40), None, "bad_udp"),
        (udp(7400, bytes(4))[:20], None, "bad_ipv4"),
        (ETHER + b"\x08\x00\x44" + bytes(40), None, "bad_ipv4"),
        (tcp(102, 9), "s7", None), (tcp(9, 102), "s7", None), (tcp(80, 81), None, "unhandled_ethertype"),
    ]
    got = decode.decode(frames(spark, [c[0] for c in cases])).orderBy("frame_no").collect()
    assert [(r["proto"], r["parse_error"]) for r in got] == [c[1:] for c in cases]
    assert (got[0]["frame_id"], got[0]["status_byte"], got[0]["interlock_bit"]) == (2, 5, True)
    assert got[1]["vlan"] and got[1]["ethertype"] == 0x8892 and got[3]["ethertype"] == 0x8100 and got[2]["ethertype"] is None
    assert [got[8][c] for c in ("x_mm", "y_mm")] == [100.5, -200] and abs(got[8]["z_mm"] - 0.1) < 1e-8
    assert got[9]["x_mm"] == float("inf") and got[9]["y_mm"] != got[9]["y_mm"] and got[9]["z_mm"] == pytest.approx(1e-40, rel=1e-4)
    assert got[7]["payload_len"] == 32 and got[15]["s7_port"] == 102


US = 1_000
PRESS = {
    "cell_name": "press 4",
    "nodes": [{"id": 11, "type": "ros2_port", "label": "start", "topic_port": 9100}, {"id": 12, "type": "fanuc_pose"}, {"id": 13, "type": "profinet", "frame_id": 40, "bit_index": 2}],
    "edges": [{"from": 11, "to": 12, "wcet_ns": 6_000}, {"from": 12, "to": 13, "wcet_ns": 2_500}],
    "trip_node": 13,
}


def guard(status):
    return (ETHER + struct.pack(">HHB", 0x8892, 40, status)).ljust(64, b"\0")


def press_records():
    """Two strokes of the press; the guard falls late in the second. An ARP frame and a runt come in between."""
    pose = udp(60008, struct.pack("<fff", 7.5, -3, 0))
    return [(5 * US, udp(9100, bytes(12)), None), (9 * US, pose, None), (11 * US, guard(6), None), (12 * US, ETHER + b"\x08\x06" + bytes(28), None), (13 * US, bytes(9), 64),
            (105 * US, udp(9100, bytes(20)), None), (110 * US, pose, None), (120 * US, guard(2), None)]


@pytest.fixture(scope="module")
def press(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cap") / "press.pcap")
    pcap.write_capture(path, press_records(), nanoseconds=True)
    pcap.register(spark)
    return path, decode.decode(spark.read.format("pcap").load(path)).cache()


def test_capture_to_evidence(spark, press, tmp_path):
    _, d = press
    m = manifest.validate(manifest.parse(json.dumps(PRESS)))
    t = A.transitions(A.classify(d, m)).cache()
    assert [(r["seq"], r["node"], r["level"]) for r in t.orderBy("seq").collect()] == [(0, 11, None), (1, 12, None), (2, 13, True), (3, 11, None), (4, 12, None), (5, 13, False)]
    found = A.trips(t, 13)
    doc = evidence.documents(found, A.catalysts(A.candidates(t, found, m)), t, window=3)
    row = evidence.parsed(doc).first()
    assert row["trace_id"].endswith(":120000:5") and row["finding"] == "attributable" and row["within_budget"] and row["response_time_ns"] == 10 * US
    assert row["document"]["root"]["normalized_overrun"] == 3.0 and row["document"]["root"]["trigger_seq"] == 4
    assert [e["offset_ns"] for e in row["document"]["events"]] == [-15 * US, -10 * US, 0]
    for sink in (EvidenceStore(spark, str(tmp_path / "store")), EvidenceMemory()):
        assert sink.is_empty() and len(sink) == 0
        sink.put(doc)
        assert len(sink) == 1 and sink.range(0, 120 * US).count() == 0 and sink.range(120 * US, 121 * US).count() == 1 and sink.range(200 * US, 100 * US).count() == 0
        with pytest.raises(DuplicateEvidence):
            sink.put(doc)


def test_triage_and_profile(spark, press):
    _, d = press
    f = preflight.facts(d).first()
    assert (f["total"], f["classifiable"], f["unclassified"], f["malformed"], f["vlan_frames"], f["truncated_frames"]) == (8, 6, 2, 1, 0, 1)
    assert f["span_ns"] == 115 * US and f["min_forward_gap_ns"] == US and f["verdict"] == "coverage_gap"
    assert [tuple(r) for r in preflight.ethertypes(d).collect()] == [(0x0800, 4), (0x8892, 2), (0x0806, 1)]
    assert [(r["ethertype"], r["name"], r["status"], r["n"]) for r in discovery.rejected(d).collect()] == [(None, "malformed", "unsupported", 1), (0x0806, "ARP", "unsupported", 1)]
    p = {(r["kind"], r["stream_id"]): r for r in discovery.profile(d).collect()}
    assert {k: (r["frames"], r["gap_min"], r["p50"]) for k, r in p.items()} == {("cyclic", 40): (2, 109 * US, None), ("udp", 9100): (2, 100 * US, None), ("udp", 60008): (2, 101 * US, None)}
    assert [tuple(x) for x in p[("cyclic", 40)]["toggles"]] == [(0, 2)]


def test_toggles_within_the_first_payload(spark):
    rows = [(0, b"\x0f" + bytes(9)), (1, b"\x0e" + bytes(8) + b"\x81" + b"\xff"), (2, b"\x0f"), (3, b"")]
    df = spark.createDataFrame([(1, i, bytearray(p)) for i, p in rows], "node long, frame_no long, payload binary")
    assert sorted(tuple(r) for r in discovery.toggles(df, ["node"]).collect()) == [(1, 0, 0), (1, 9, 0), (1, 9, 7)]


def test_large_captures_are_read_in_parts(spark, tmp_path):
    p = str(tmp_path / "a.pcap")
    records = [(i * 7, bytes([i % 251]) * (40 + i % 90), None) for i in range(900)]
    pcap.write_capture(p, records, nanoseconds=True)
    pcap.register(spark)
    df = spark.read.format("pcap").option("split_bytes", 9_000).load("file://" + p)
    assert df.rdd.getNumPartitions() > 5
    got = df.orderBy("frame_no").collect()
    assert [(r["frame_no"], r["tap_ts_ns"], bytes(r["raw"])) for r in got] == [(i, ts, raw) for i, (ts, raw, _) in enumerate(records)]
    assert {r["capture_id"] for r in got} == {"file://" + p}


def test_captures_of_one_name_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        pcap.write_capture(str(tmp_path / folder / "x.pcap"), [(1, b"z", None)])
    pcap.register(spark)
    both = [spark.read.format("pcap").load(str(tmp_path / f)) for f in "ab"]
    assert both[0].unionByName(both[1]).select("capture_id").distinct().count() == 2


def test_a_late_file_with_an_early_name_is_read_once(spark, tmp_path):
    pcap.register(spark)
    landing, out = tmp_path / "landing", []
    landing.mkdir()
    for step, name in enumerate(["m.pcap", "z.pcap", "a.pcap"]):
        pcap.write_capture(str(landing / name), [(step + 1, bytes([step]), None)])
        q = spark.readStream.format("pcap").load(str(landing)).writeStream.foreachBatch(lambda df, _: out.extend(r["capture_id"].rpartition("/")[2] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert out == ["m.pcap", "z.pcap", "a.pcap"]


def test_provenance_and_policy(spark, tmp_path):
    p = str(tmp_path / "a.pcap")
    pcap.write_capture(p, [(1, b"z", None)])
    pcap.register(spark)
    assert spark.read.format("pcap").option("ts_source", "hardware").option("require_hardware", "true").load(p).first()["ts_source"] == "hardware"
    for options in ({"require_hardware": "true"}, {"ts_source": "sundial"}):
        with pytest.raises(Exception, match="policy"):
            spark.read.format("pcap").options(**options).load(p).count()
    with pytest.raises(pcap.CaptureError) as e:
        pcap.CaptureFile(io.BytesIO(b"\xd4\xc3"), "strict")
    assert e.value.kind == "truncated"
    with pytest.raises(pcap.CaptureError) as e:
        pcap.CaptureFile(io.BytesIO(b""))
    assert e.value.kind == "io"


def test_commands(spark, press, tmp_path, capsys):
    path, _ = press
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(PRESS))
    bad.write_text(json.dumps(PRESS | {"trip_node": 12}))
    assert main(["validate", str(good)]) == 0 and main(["validate", str(bad)]) == 1 and main(["validate", str(tmp_path / "none")]) == 1
    assert "trip_not_interlock" in capsys.readouterr().err
    tight = tmp_path / "tight.json"
    tight.write_text(json.dumps(PRESS | {"edges": [{"from": 11, "to": 13, "wcet_ns": 400}]}))
    assert main(["validate", str(tight)]) == 0 and "tight_budget" in capsys.readouterr().out
    assert main(["preflight", path]) == 0 and "coverage_gap" in capsys.readouterr().out
    assert main(["discover", path]) == 0 and "udp 9100" in capsys.readouterr().out
    assert main(["run", path, str(good), str(tmp_path / "out")]) == 0
    shown = capsys.readouterr().out
    assert "frames 8, parsed 6, dropped 2, trips 1, attributed 1, rows 1" in shown and "12 -> 13" in shown
    assert main(["run", path, str(good), str(tmp_path / "out")]) == 1 and main(["preflight", str(tmp_path / "absent")]) == 1


def test_verdicts(spark):
    rows = [(0, 0.0), (5, 0.2), (5, 0.21)]
    df = spark.createDataFrame(rows, "t long, f double")
    assert [r[0] for r in df.select(preflight.verdict(df["t"], df["f"])).collect()] == ["rejected_empty", "analyzable", "coverage_gap"]


def test_quantiles_are_clamped_and_gated(spark):
    ts, t = [0], 0
    for g in [3_000_000] * 800 + [5_000_000] * 120 + [70_000_000] * 4:  # buckets from 2883584, 4718592 and 67108864
        t += g
        ts.append(t)
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(ts)], "node long, frame_no long, tap_ts_ns long")
    q = discovery.quantiles(discovery.gaps(df, ["node"]), ["node"]).first()
    assert (q["p50"], q["p95"], q["p99"], q["p999"]) == (3_000_000, 4_718_592, 4_718_592, 67_108_864)
    few = discovery.quantiles(discovery.gaps(df.where("frame_no < 4"), ["node"]), ["node"]).first()
    assert few["p50"] is None


def test_gap_saturates(spark):
    df = spark.createDataFrame([(1, 0, 50), (1, 1, 20), (1, 2, 25)], "node long, frame_no long, tap_ts_ns long")
    assert [r["gap_ns"] for r in discovery.gaps(df, ["node"]).orderBy("frame_no").collect()] == [None, 0, 5]


@pytest.mark.parametrize("big,nano", [(False, False), (True, False), (False, True), (True, True)])
def test_pcap_variants(spark, tmp_path, big, nano):
    p = str(tmp_path / "a.pcap")
    pcap.write_capture(p, [(1_500_000_000, b"x" * 40, 60), (2_000_000_000, b"y", None)], big, nano)
    pcap.register(spark)
    got = spark.read.format("pcap").load(p).orderBy("frame_no").collect()
    assert [r["tap_ts_ns"] for r in got] == [1_500_000_000, 2_000_000_000] and bytes(got[0]["raw"]) == b"x" * 40
    c = spark.read.format("pcap").option("view", "captures").load(p).first()
    assert c["frames"] == 2 and c["truncated_frames"] == 1 and c["nanoseconds"] == nano and not c["ended_mid_record"]


def test_pcap_damage(spark, tmp_path):
    p = str(tmp_path / "a.pcap")
    pcap.write_capture(p, [(1, b"abc", None)])
    whole = open(p, "rb").read()
    pcap.register(spark)

    def facts(data, name):
        q = str(tmp_path / name)
        open(q, "wb").write(data)
        return spark.read.format("pcap").option("view", "captures").load(q).first(), q

    tail, q = facts(whole + bytes(8), "tail")
    assert tail["ended_mid_record"] and tail["frames"] == 1
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("pcap").option("mode", "strict").load(q).count()
    assert facts(struct.pack("<I", 0x0A0D0D0A) + bytes(40), "ng")[0]["format_error"]
    assert facts(b"", "none")[0]["format_error"]
    long, q = facts(whole + struct.pack("<IIII", 0, 0, 262_145, 262_145), "long")
    assert long["record_error"] and spark.read.format("pcap").load(q).count() == 1
    fits, _ = facts(whole + struct.pack("<IIII", 0, 0, 262_144, 262_144) + bytes(262_144), "fits")
    assert fits["frames"] == 2


def change(**parts):
    return json.dumps(PRESS | parts)


@pytest.mark.parametrize("parts,kind", [
    ({"nodes": []}, "empty"), ({"trip_node": 77}, "trip_undeclared"), ({"trip_node": 11}, "trip_not_interlock"),
    ({"edges": [{"from": 12, "to": 55, "wcet_ns": 8}]}, "dangling_node"), ({"edges": [{"from": 11, "to": 13, "wcet_ns": 0}]}, "bad_budget"),
    ({"edges": [{"from": 11, "to": 13, "wcet_ns": 60_000_000_001}]}, "bad_budget"),
    ({"edges": [{"from": 11, "to": 12, "wcet_ns": 8}, {"from": 12, "to": 11, "wcet_ns": 8}]}, "dependency_cycle"), ({"edges": [{"from": 12, "to": 12, "wcet_ns": 8}]}, "dependency_cycle"),
    ({"edges": [{"from": 11, "to": 12, "wcet_ns": -4}]}, "json"), ({"nodes": [{"id": 12, "type": "fanuc_pose"}] * 2}, "duplicate_node"),
    ({"nodes": [{"id": 13, "type": "profinet", "frame_id": 40, "bit_index": 8}]}, "bad_bit_index"), ({"nodes": [{"id": 13, "type": "lamp"}]}, "json"),
])
def test_manifest_errors(parts, kind):
    with pytest.raises(ManifestError) as e:
        manifest.validate(manifest.parse(change(**parts)))
    assert e.value.kind == kind


def test_manifest_lints():
    assert manifest.lint(manifest.validate(manifest.parse(json.dumps(PRESS)))) == []
    assert manifest.lint(manifest.validate(manifest.parse(change(edges=[{"from": 11, "to": 12, "wcet_ns": 999}])))) == [("trip_unreachable", 13), ("orphan_node", 13), ("tight_budget", 11, 12, 999)]
    assert manifest.validate(manifest.parse(change(edges=[{"from": 11, "to": 13, "wcet_ns": 60_000_000_000}])))
