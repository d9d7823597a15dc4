import random

import pytest
from pyspark.sql import functions as F

from tapquarry.operators.manifest import Edge, Manifest, Node
from tapquarry.plans import attribution as A
from tapquarry.streaming import detector

from .model import walk

SCHEMA = "capture_id long, frame_no long, node long, ts long, level boolean"


def manifest(edges, n=5):
    return Manifest(tuple(Node(i, "profinet", frame_id=i) for i in range(1, n + 1)), tuple(Edge(*e) for e in edges), n)


def capture(rng, cid, n, backward):
    rows, ts = [], 0
    for i in range(n):
        ts += rng.choice([0, 1, 5, 20]) if not (backward and rng.random() < 0.2) else -rng.randint(1, 30)
        node = rng.choice([1, 2, 3, 4, 5, 5])
        rows.append((cid, i, node, max(0, ts), rng.random() < 0.5 if node == 5 else None))
    return rows


def expected(rows, edges, cap):
    out, was, ring = [], None, []
    for seq, (cid, _, node, ts, level) in enumerate(rows):
        ring.append((seq, node, ts))
        if node == 5:
            if was and not level:
                out += [(cid, seq, r, *x) for r, x in enumerate(walk(ring[-cap:], edges, 5), 1)]
            was = level
    return out


@pytest.mark.parametrize("cap", [12, 10_000])
def test_walk_matches_model(spark, cap):
    rng = random.Random(cap)
    edges = [(1, 2, 7), (1, 3, 9), (2, 4, 8), (3, 4, 6), (4, 5, 9), (2, 5, 10), (1, 5, 3)]
    rows, want = [], []
    for cid in range(14):
        own = capture(rng, cid, 70, cid % 2 == 1)
        rows += own
        want += expected(own, edges, cap)
    m = manifest(edges)
    t = A.transitions(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk_rows=16).cache()
    found = A.trips(t, 5, chunk_rows=16)
    got = A.catalysts(A.candidates(t, found, m, cap, chunk_ns=40)).select("capture_id", "trip_seq", "rank", "edge_from", "edge_to", "observed_dt_ns", "trigger_seq", "effect_seq")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def press_line():
    """A press: a port (11) starts a robot (12), which arms a guard (13); the guard's bit 2 is the trip."""
    return Manifest((Node(11, "ros2_port", topic_port=9100), Node(12, "fanuc_pose"), Node(13, "profinet", frame_id=40, bit_index=2)), (Edge(11, 12, 6_000), Edge(12, 13, 2_500)), 13)


@pytest.mark.parametrize("second,root", [((500, 509, 519), (12, 13, 10_000, 3.0)), ((500, 530, 532), (11, 12, 30_000, 4.0)), ((500, 504, 505), None)])
def test_root_is_the_edge_with_the_widest_overrun(spark, second, root):
    rows = [(1, i, n, us * 1_000, level) for i, (n, us, level) in enumerate([(11, 100, None), (12, 101, None), (13, 102, True), (11, second[0], None), (12, second[1], None), (13, second[2], False)])]
    t = A.transitions(spark.createDataFrame(rows, SCHEMA)).cache()
    found = A.trips(t, 13)
    got = A.roots(found, A.catalysts(A.candidates(t, found, press_line()))).collect()
    assert len(got) == 1
    assert (got[0]["edge_from"], got[0]["edge_to"], got[0]["observed_dt_ns"], got[0]["normalized_overrun"]) == (root or (None,) * 4)


def test_explain_matches_model():
    rng = random.Random(4)
    edges = [(1, 2, 7), (1, 3, 9), (2, 4, 8), (3, 4, 6), (4, 5, 9), (2, 5, 10)]
    for _ in range(200):
        ring = [(i, rng.randint(1, 5), rng.randint(0, 60)) for i in range(30)] + [(30, 5, rng.randint(30, 60))]
        got = [(a, b, dt, trigger, effect) for _, a, b, dt, _, _, trigger, effect, _ in detector.explain(ring, manifest(edges))]
        assert got == walk(ring, edges, 5)


def test_stream_detects_across_batches(spark, tmp_path):
    rng = random.Random(9)
    edges = [(1, 2, 7), (2, 4, 8), (4, 5, 9), (2, 5, 10)]
    rows = capture(rng, 7, 60, False)
    for i, part in enumerate((rows[:25], rows[25:41], rows[41:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = detector.detect(source, manifest(edges)).writeStream.format("memory").queryName("trips_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["capture_id"], r["trip_seq"], r["rank"], r["edge_from"], r["edge_to"], r["observed_dt_ns"], r["trigger_seq"], r["effect_seq"]) for r in spark.table("trips_out").where(F.col("rank") > 0).collect())
    assert got == sorted(expected(rows, edges, 10_000))
