"""Evidence documents and their flat rows, from trips and ranked catalysts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APPLIANCE, SAFETY_FUNCTION, RESPONSE_BUDGET_NS = "tap-0", "SF-1", 50_000_000
#: Columns of a document's parts.
SAFETY = "struct<safety_function_id:string,response_time_ns:bigint,response_budget_ns:bigint,within_budget:boolean>"
CATALYST = "struct<edge_from:bigint,edge_to:bigint,observed_dt_ns:bigint,wcet_ns:bigint,normalized_overrun:double,trigger_seq:bigint,effect_seq:bigint>"
EVENT = "struct<seq:bigint,node:bigint,ts:bigint,offset_ns:bigint,interlock:boolean>"
DOCUMENT = f"struct<trace_id:string,capture_id:string,trip_ts:bigint,trip_seq:bigint,finding:string,root:{CATALYST},catalysts:array<{CATALYST}>,events:array<{EVENT}>,safety:{SAFETY}>"


def trace_id(ts, seq, appliance: str = APPLIANCE):
    return F.concat_ws(":", F.lit(appliance), ts, seq)


def response(rooted: DataFrame, budget: int = RESPONSE_BUDGET_NS) -> DataFrame:
    """Adds finding, response_time_ns (from the root's trigger; 0 without a root), within_budget."""
    has = F.col("edge_from").isNotNull()
    time = F.coalesce(F.greatest(F.lit(0).cast("long"), F.col("trip_ts") - F.col("trigger_ts")), F.lit(0).cast("long"))
    return rooted.withColumns({"finding": F.when(has, "attributable").otherwise("unattributed"), "response_time_ns": time, "within_budget": has & (time <= budget)})


def rows(rooted: DataFrame, appliance: str = APPLIANCE, budget: int = RESPONSE_BUDGET_NS) -> DataFrame:
    """One flat row per trip; root columns are null where nothing exceeded its budget."""
    r = response(rooted, budget)
    return r.select(
        trace_id(F.col("trip_ts"), F.col("trip_seq"), appliance).alias("trace_id"), "capture_id", "trip_ts", "trip_seq", "finding",
        F.col("edge_from").alias("root_from"), F.col("edge_to").alias("root_to"), F.col("normalized_overrun").alias("root_overrun"), "response_time_ns", "within_budget",
    )


def preceding(trans: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """capture_id, trip_seq and each of the last `window` transitions up to the trip with its offset. Equi-joined by seq div window."""
    near = found.withColumn("_b", F.explode(F.array(F.floor(F.col("trip_seq") / window), F.floor(F.col("trip_seq") / window) - 1)))
    t = trans.withColumn("_b", F.floor(F.col("seq") / window))
    return near.join(t, ["capture_id", "_b"]).where((F.col("seq") <= F.col("trip_seq")) & (F.col("seq") > F.col("trip_seq") - window)).select("capture_id", "trip_seq", "seq", "node", "ts", (F.col("ts") - F.col("trip_ts")).alias("offset_ns"), "level")


def documents(found: DataFrame, ranked: DataFrame, trans: DataFrame, appliance: str = APPLIANCE, safety_function: str = SAFETY_FUNCTION, budget: int = RESPONSE_BUDGET_NS, window: int = 1) -> DataFrame:
    """Flat rows plus `evidence`, the nested document as JSON."""
    parts = F.struct("rank", F.struct("edge_from", "edge_to", "observed_dt_ns", "wcet_ns", "normalized_overrun", "trigger_seq", "effect_seq").alias("c"))
    lists = ranked.groupBy("capture_id", "trip_seq").agg(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["c"]).alias("catalysts"))
    events = preceding(trans, found, window).groupBy("capture_id", "trip_seq").agg(F.sort_array(F.collect_list(F.struct("seq", "node", "ts", "offset_ns", F.col("level").alias("interlock")))).alias("events"))
    key = ["capture_id", "trip_seq"]
    from tapquarry.plans.attribution import roots

    flat = rows(roots(found, ranked), appliance, budget)
    full = flat.join(lists, key, "left").join(events, key, "left").withColumn("catalysts", F.coalesce("catalysts", F.array().cast(f"array<{CATALYST}>")))
    safety = F.struct(F.lit(safety_function).alias("safety_function_id"), "response_time_ns", F.lit(budget).cast("long").alias("response_budget_ns"), "within_budget")
    doc = F.struct("trace_id", F.col("capture_id").cast("string").alias("capture_id"), "trip_ts", "trip_seq", "finding", F.try_element_at("catalysts", F.lit(1)).alias("root"), "catalysts", "events", safety.alias("safety"))
    return full.select(*flat.columns, F.to_json(doc, {"pretty": "true"}).alias("evidence"))


def parsed(stored: DataFrame) -> DataFrame:
    """The nested document again, from the JSON of a stored row."""
    return stored.withColumn("document", F.from_json("evidence", DOCUMENT))
