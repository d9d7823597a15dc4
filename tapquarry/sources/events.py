"""The events table seen as a capture: order by event_id, microseconds as the clock, event types as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapquarry.operators.manifest import Edge, Manifest, Node

NODES = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 5}
TRIP = 5
EDGES = [(1, 2, 700_000_000), (1, 3, 900_000_000), (2, 4, 800_000_000), (3, 4, 600_000_000), (4, 5, 900_000_000), (2, 5, 1_000_000_000)]
MANIFEST = Manifest(tuple(Node(v, "profinet", k, frame_id=v) for k, v in NODES.items()), tuple(Edge(*e) for e in EDGES), TRIP, "events")


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


def classified(spark: SparkSession, sf_dir: str, per_user: bool = False) -> DataFrame:
    """capture_id, frame_no, node, ts, level, as the frame classifier gives them."""
    node = F.lit(None).cast("long")
    for name, n in NODES.items():
        node = F.when(F.col("event_type") == name, F.lit(n).cast("long")).otherwise(node)
    e = read(spark, sf_dir).withColumn("node", node).where("node is not null")
    capture = F.col("user_id") if per_user else F.lit(0).cast("long")
    return e.select(capture.alias("capture_id"), F.col("event_id").alias("frame_no"), "node", "ts", F.when(F.col("node") == TRIP, F.col("k") % 2 == 1).alias("level"))
