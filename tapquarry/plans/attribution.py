"""Trips and what explains them: classification, sequence numbers, falling edges, the walk over the dependency DAG.

The walk is unrolled into the plan, node by node upstream of the trip node. Where a capture's time never runs
backward, triggers come from one windowed as-of; elsewhere from the ring of the last `cap` transitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapquarry.functions.expressions import bit_of
from tapquarry.operators.manifest import Manifest
from tapquarry.operators.ordered import lagged, latest_before, numbered

CAP = 10_000
CHUNK_ROWS = 1_000_000
CHUNK_NS = 60_000_000_000
RANKED = ["capture_id", "trip_seq", "trip_ts", "rank", "edge_from", "edge_to", "observed_dt_ns", "wcet_ns", "normalized_overrun", "trigger_seq", "effect_seq", "trigger_ts"]


def nodes_table(spark: SparkSession, m: Manifest) -> DataFrame:
    rows = [(n.id, {"profinet": "cyclic", "ros2_port": "udp", "fanuc_pose": "pose"}[n.kind], n.frame_id if n.kind == "profinet" else n.topic_port, n.bit_index) for n in m.nodes]
    return spark.createDataFrame(rows, "node long, match_proto string, match_id int, bit_index int")


def classify(decoded: DataFrame, m: Manifest) -> DataFrame:
    """capture_id, frame_no, node, ts, level of the accepted frames that a node claims; the least node id where several do.

    A port node claims the pose port's frames too if it names that port and no pose node does.
    """
    nodes = nodes_table(decoded.sparkSession, m)
    ok = decoded.where("parse_error is null")
    match = F.when(F.col("proto") == "cyclic", F.col("frame_id")).when(F.col("proto") == "udp", F.col("dst_port"))
    ok = ok.withColumns({"_id": match})
    best = nodes.groupBy("match_proto", "match_id").agg(F.min_by(F.struct("node", "bit_index"), "node").alias("n"))
    joined = ok.join(F.broadcast(best), (F.col("proto") == F.col("match_proto")) & F.col("_id").eqNullSafe(F.col("match_id")))  # a row per declared node
    level = F.when(F.col("proto") == "cyclic", bit_of(F.col("status_byte"), F.col("n.bit_index")))
    return joined.select("capture_id", "frame_no", F.col("n.node").alias("node"), F.col("tap_ts_ns").alias("ts"), level.alias("level"))


def transitions(classified: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds seq: the number of the classified frame in its capture, from 0."""
    return numbered(classified, "capture_id", "frame_no", "seq", F.floor(F.col("frame_no") / chunk_rows))


def trips(trans: DataFrame, trip_node: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Falling edges of the trip node's level; its first observation is none."""
    own = trans.where((F.col("node") == trip_node) & F.col("level").isNotNull())
    own = lagged(own, ["capture_id"], "seq", "level", "was", F.floor(F.col("seq") / chunk_rows))
    return own.where("was and not level").select("capture_id", F.col("seq").alias("trip_seq"), F.col("ts").alias("trip_ts"))


def with_triggers(trans: DataFrame, sources: list[int], chunk_ns: int = CHUNK_NS) -> DataFrame:
    """Adds trig_<node>: struct(seq, ts) of the node's latest transition strictly before, for monotone captures."""
    values = {f"trig_{n}": F.when(F.col("node") == n, F.struct("seq", "ts")) for n in sources}
    return latest_before(trans, "capture_id", values, chunk_ns)


def saturating(a, b):
    return F.greatest(F.lit(0).cast("long"), a - b)


def overrun(dt, budget: int):
    return (dt.cast("double") - F.lit(float(budget))) / F.lit(float(budget))


def candidate(edge, index: int, place: int, instance, trigger):
    dt = saturating(instance["ts"], trigger["ts"])
    return F.when(
        trigger.isNotNull(),
        F.struct(
            instance["path"].alias("path"), F.lit(place).alias("place"), F.lit(index).alias("edge_idx"),
            F.lit(edge.source).cast("long").alias("edge_from"), F.lit(edge.target).cast("long").alias("edge_to"),
            dt.alias("observed_dt_ns"), F.lit(edge.budget_ns).cast("long").alias("wcet_ns"), overrun(dt, edge.budget_ns).alias("normalized_overrun"),
            trigger["seq"].alias("trigger_seq"), instance["seq"].alias("effect_seq"), trigger["ts"].alias("trigger_ts"),
        ),
    )


def walk(found: DataFrame, m: Manifest, lookup) -> DataFrame:
    """found: capture_id, trip_seq, trip_ts. lookup(df, node) gives df and, by source, the trigger of the node's instance.

    A path is the list of negated places of the edges taken, so the least path is the first in a depth-first walk
    that takes the last declared edge first; a node keeps the instance of its least path.
    """
    none = "cast(null as struct<path:array<int>,seq:bigint,ts:bigint>)"
    order = m.walk_order()
    df = found.withColumns({f"i_{n}": F.expr(none) for n in order if n != m.trip_node})
    df = df.withColumn(f"i_{m.trip_node}", F.struct(F.array().cast("array<int>").alias("path"), F.col("trip_seq").alias("seq"), F.col("trip_ts").alias("ts")))
    candidates = []
    for u in order:
        if not m.incoming.get(u):
            continue
        df, trigger = lookup(df, u)
        own = F.col(f"i_{u}")
        for place, e in m.incoming[u]:
            name = f"c_{len(candidates)}"
            t = trigger(e.source)
            df = df.withColumn(name, candidate(e, m.edges.index(e), place, own, t))
            push = F.when(t.isNotNull(), F.struct(F.concat(own["path"], F.array(F.lit(-place))).alias("path"), t["seq"].alias("seq"), t["ts"].alias("ts")))
            df = df.withColumn(f"i_{e.source}", F.least(F.col(f"i_{e.source}"), push))
            candidates.append(name)
        df = df.drop(*[c for c in df.columns if c.startswith("t_")])
    kept = F.filter(F.array(*candidates), lambda c: c.isNotNull()) if candidates else F.array()
    return df.select("capture_id", "trip_seq", "trip_ts", F.explode(kept).alias("c")).select("capture_id", "trip_seq", "trip_ts", "c.*")


def by_window(trans: DataFrame, found: DataFrame, m: Manifest, cap: int, chunk_ns: int) -> DataFrame:
    sources = sorted({e.source for e in m.edges})
    known = with_triggers(trans, sources, chunk_ns).select(F.col("capture_id"), F.col("node").alias("t_node"), F.col("seq").alias("t_seq"), *[F.col(f"trig_{n}").alias(f"t_{n}") for n in sources])

    def lookup(df, u):
        need = sorted({e.source for _, e in m.incoming[u]})
        at = known.where(F.col("t_node") == u).select(F.col("capture_id").alias("t_capture"), "t_seq", *[f"t_{n}" for n in need])
        df = df.join(at, (df["capture_id"] == at["t_capture"]) & (df[f"i_{u}"]["seq"] == at["t_seq"]), "left")
        return df, lambda n: F.when(F.col(f"t_{n}.seq") > F.col("trip_seq") - cap, F.col(f"t_{n}"))

    return walk(found, m, lookup)


def ring(trans: DataFrame, found: DataFrame, cap: int, sources: list[int]) -> DataFrame:
    """found with `ring`: those of the last cap transitions up to the trip that are of a node an edge comes from. Rows meet by seq div cap, two buckets for a trip."""
    rows = trans.where(F.col("node").isin(sources)).select(F.col("capture_id").alias("r_capture"), F.floor(F.col("seq") / cap).alias("r_bucket"), F.col("seq").alias("r_seq"), F.col("node").alias("r_node"), F.col("ts").alias("r_ts"))
    b = F.floor(F.col("trip_seq") / cap)
    near = found.withColumn("bucket", F.explode(F.array(b, b - 1)))
    near = near.join(rows, (near["capture_id"] == rows["r_capture"]) & (near["bucket"] == rows["r_bucket"]) & (F.col("r_seq") <= F.col("trip_seq")) & (F.col("r_seq") > F.col("trip_seq") - cap))
    return near.groupBy("capture_id", "trip_seq", "trip_ts").agg(F.collect_list(F.struct(F.col("r_seq").alias("seq"), F.col("r_node").alias("node"), F.col("r_ts").alias("ts"))).alias("ring"))


def by_ring(trans: DataFrame, found: DataFrame, m: Manifest, cap: int) -> DataFrame:
    def lookup(df, u):
        def trigger(n):
            hit = F.array_max(F.filter("ring", lambda r: (r["node"] == n) & (r["ts"] < F.col(f"i_{u}.ts"))))
            return F.when(hit.isNotNull(), F.struct(hit["seq"].alias("seq"), hit["ts"].alias("ts")))

        return df, trigger

    return walk(ring(trans, found, cap, sorted({e.source for e in m.edges})), m, lookup)


def backward(trans: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Captures in which time runs backward between successive classified frames."""
    return lagged(trans, ["capture_id"], "seq", "ts", "was", F.floor(F.col("seq") / chunk_rows)).where("ts < was").select("capture_id").distinct()


def candidates(trans: DataFrame, found: DataFrame, m: Manifest, cap: int = CAP, chunk_ns: int = CHUNK_NS, monotone: bool | None = None) -> DataFrame:
    """Every edge evaluated for every trip. monotone: whether time is known never to run backward, or that it is to be looked at."""
    if monotone is None:
        odd = backward(trans)
        steady = by_window(trans.join(odd, "capture_id", "left_anti"), found.join(odd, "capture_id", "left_anti"), m, cap, chunk_ns)
        return steady.unionByName(by_ring(trans.join(odd, "capture_id", "left_semi"), found.join(odd, "capture_id", "left_semi"), m, cap))
    return by_window(trans, found, m, cap, chunk_ns) if monotone else by_ring(trans, found, m, cap)


def catalysts(evaluated: DataFrame) -> DataFrame:
    """Edges over their budgets, ranked by overrun, then in the order of the walk."""
    w = Window.partitionBy("capture_id", "trip_seq").orderBy(F.desc("normalized_overrun"), "path", "place")
    return evaluated.where("observed_dt_ns > wcet_ns").withColumn("rank", F.row_number().over(w)).select(*RANKED)


def roots(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each trip with its first catalyst, nulls where no budget was exceeded."""
    return found.join(ranked.where("rank = 1").drop("rank", "trip_ts"), ["capture_id", "trip_seq"], "left")
