"""Queries over the driver's tables, by name, and their DuckDB counterparts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapquarry.functions import expressions as X
from tapquarry.operators import decode, discovery, evidence, manifest, preflight
from tapquarry.plans import attribution as A
from tapquarry.sources import events, pcap, store

M = events.MANIFEST
CAP, SMALL_CAP, BEFORE = A.CAP, 64, 8
TRIP_COLUMNS = ["capture_id", "trip_seq", "trip_ts"]
RANGE = (1_704_500_000_000_000, 1_705_500_000_000_000)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = COMMON + oracle
        return f

    return add


def shared(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one of this machine where the session runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tapquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def trans(spark: SparkSession, d: str, per_user: bool = False) -> DataFrame:
    return A.transitions(events.classified(spark, d, per_user))


def evaluated(spark: SparkSession, d: str, cap: int = CAP):
    t = trans(spark, d)
    found = A.trips(t, M.trip_node)
    return t, found, A.candidates(t, found, M, cap, monotone=True)  # ts grows with event_id


def streams(spark: SparkSession, d: str) -> DataFrame:
    return events.classified(spark, d).select("node", "frame_no", F.col("ts").alias("tap_ts_ns"))


def asof(alias: str, node: int, before: str, ok: str = "true") -> str:
    return f"ASOF LEFT JOIN (SELECT seq, ts FROM tr WHERE node = {node}) {alias} ON {before} > {alias}.ts"


def chain(cap: int) -> str:
    """The walk over the events' DAG: one as-of per edge; o is the order of discovery."""
    def valid(a, c):
        return f"CASE WHEN {a}.seq > trip_seq - {cap} THEN {a}.{c} END"

    return f""", h1 AS (SELECT trips.*, {valid('a', 'seq')} AS s4, {valid('a', 'ts')} AS t4, {valid('b', 'seq')} AS s2, {valid('b', 'ts')} AS t2
  FROM trips {asof('a', 4, 'trips.trip_ts')} {asof('b', 2, 'trips.trip_ts')}),
h2 AS (SELECT h1.*, {valid('a', 'seq')} AS s1, {valid('a', 'ts')} AS t1, {valid('b', 'seq')} AS s24, {valid('b', 'ts')} AS t24, {valid('c', 'seq')} AS s3, {valid('c', 'ts')} AS t3
  FROM h1 {asof('a', 1, 'h1.t2')} {asof('b', 2, 'h1.t4')} {asof('c', 3, 'h1.t4')}),
h3 AS (SELECT h2.*, {valid('a', 'seq')} AS s13, {valid('a', 'ts')} AS t13 FROM h2 {asof('a', 1, 'h2.t3')}),
flat AS (
  SELECT capture_id, trip_seq, trip_ts, 0 AS o, 4 AS edge_from, 5 AS edge_to, trip_ts - t4 AS dt, 900000000 AS w, s4 AS trigger_seq, trip_seq AS effect_seq, t4 AS trigger_ts FROM h3 UNION ALL
  SELECT capture_id, trip_seq, trip_ts, 1, 2, 5, trip_ts - t2, 1000000000, s2, trip_seq, t2 FROM h3 UNION ALL
  SELECT capture_id, trip_seq, trip_ts, 2, 1, 2, t2 - t1, 700000000, s1, s2, t1 FROM h3 UNION ALL
  SELECT capture_id, trip_seq, trip_ts, 3, 2, 4, t4 - t24, 800000000, s24, s4, t24 FROM h3 UNION ALL
  SELECT capture_id, trip_seq, trip_ts, 4, 3, 4, t4 - t3, 600000000, s3, s4, t3 FROM h3 UNION ALL
  SELECT capture_id, trip_seq, trip_ts, 5, 1, 3, t3 - t13, 900000000, s13, s3, t13 FROM h3),
cand AS (SELECT capture_id, trip_seq, trip_ts, o, edge_from::BIGINT AS edge_from, edge_to::BIGINT AS edge_to, dt AS observed_dt_ns, w::BIGINT AS wcet_ns,
  (dt::DOUBLE - w::DOUBLE) / w::DOUBLE AS normalized_overrun, trigger_seq, effect_seq, trigger_ts FROM flat WHERE trigger_seq IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id, trip_seq ORDER BY normalized_overrun DESC, o)::INT AS rank FROM cand WHERE observed_dt_ns > wcet_ns),
rooted AS (SELECT trips.*, r.* EXCLUDE (capture_id, trip_seq, trip_ts, o, rank) FROM trips LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (capture_id, trip_seq))"""


COMMON = """WITH RECURSIVE base AS (SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  (CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END)::BIGINT AS node FROM events),
tr AS (SELECT 0::BIGINT AS capture_id, event_id AS frame_no, node, ts, CASE WHEN node = 5 THEN k % 2 = 1 END AS level, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM base WHERE node IS NOT NULL),
tru AS (SELECT user_id AS capture_id, event_id AS frame_no, node, ts, CASE WHEN node = 5 THEN k % 2 = 1 END AS level, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM base WHERE node IS NOT NULL),
trips AS (SELECT capture_id, seq AS trip_seq, ts AS trip_ts FROM (SELECT *, lag(level) OVER (PARTITION BY capture_id ORDER BY seq) AS was FROM tr WHERE node = 5) WHERE was AND NOT level),
tripsu AS (SELECT capture_id, seq AS trip_seq, ts AS trip_ts FROM (SELECT *, lag(level) OVER (PARTITION BY capture_id ORDER BY seq) AS was FROM tru WHERE node = 5) WHERE was AND NOT level),
gaps AS (SELECT node, frame_no, ts AS tap_ts_ns, greatest(0, ts - lag(ts) OVER (PARTITION BY node ORDER BY frame_no)) AS gap0, lag(ts) OVER (PARTITION BY node ORDER BY frame_no) AS was FROM tr),
g AS (SELECT node, frame_no, tap_ts_ns, CASE WHEN was IS NOT NULL THEN gap0 END AS gap_ns FROM gaps),
stats AS (SELECT node, count(*) AS frames, count(gap_ns) AS gap_count, coalesce(min(gap_ns), 0) AS gap_min, coalesce(max(gap_ns), 0) AS gap_max,
  coalesce(sum(gap_ns)::HUGEINT // nullif(count(gap_ns), 0), 0)::BIGINT AS gap_mean FROM g GROUP BY node),
bits AS (SELECT node, gap_ns, length(bin(gap_ns)) - 1 AS band FROM g WHERE gap_ns IS NOT NULL),
bk AS (SELECT node, CASE WHEN gap_ns = 0 THEN 0 ELSE band * 8 + CASE WHEN band >= 3 THEN (gap_ns - (1::BIGINT << band)) >> (band - 3) ELSE ((gap_ns - (1::BIGINT << band)) * 8) >> band END END::INT AS bucket FROM bits),
bc AS (SELECT node, bucket, count(*) AS n, CASE WHEN bucket = 0 THEN 0 ELSE (1::BIGINT << (bucket // 8)) + (((bucket % 8)::BIGINT << (bucket // 8)) >> 3) END AS bucket_lo FROM bk GROUP BY node, bucket),
cum AS (SELECT bc.*, sum(n) OVER (PARTITION BY node ORDER BY bucket) AS c, gap_count, gap_min, gap_max FROM bc JOIN stats USING (node)),
quant AS (SELECT node, """ + ", ".join(f"CASE WHEN any_value(gap_count) >= 30 THEN least(greatest(min(CASE WHEN c >= greatest(1, least(ceil({q}::DOUBLE * gap_count), gap_count)) THEN bucket_lo END), any_value(gap_min)), any_value(gap_max)) END AS {n}" for n, q in discovery.QUANTILES.items()) + """ FROM cum GROUP BY node)"""


@query("state_transitions", " SELECT capture_id, frame_no, node, ts, level, seq FROM tr")
def state_transitions(spark, d):
    return trans(spark, d)


@query("node_counts", " SELECT node, count(*) AS n FROM tr GROUP BY node")
def node_counts(spark, d):
    return events.classified(spark, d).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query("trip_detection", " SELECT * FROM trips")
def trip_detection(spark, d):
    return A.trips(trans(spark, d), M.trip_node)


@query("trip_detection_by_capture", " SELECT * FROM tripsu")
def trip_detection_by_capture(spark, d):
    return A.trips(trans(spark, d, True), M.trip_node)


EDGE_ROWS = ", e AS (" + " UNION ALL ".join(f"SELECT {i}::INT AS edge_idx, t.seq AS effect_seq, f.seq AS trigger_seq, t.ts - f.ts AS observed_dt_ns, {w}::BIGINT AS wcet_ns FROM (SELECT * FROM tr WHERE node = {b}) t ASOF JOIN (SELECT seq, ts FROM tr WHERE node = {a}) f ON t.ts > f.ts" for i, (a, b, w) in enumerate(events.EDGES)) + ")"


def edge_rows(spark, d) -> DataFrame:
    t = A.with_triggers(trans(spark, d), sorted({e.source for e in M.edges}))
    each = F.array(*[F.when((F.col("node") == e.target) & F.col(f"trig_{e.source}").isNotNull(), F.struct(F.lit(i).alias("edge_idx"), F.col(f"trig_{e.source}.seq").alias("trigger_seq"), A.saturating(F.col("ts"), F.col(f"trig_{e.source}.ts")).alias("observed_dt_ns"), F.lit(e.budget_ns).cast("long").alias("wcet_ns"))) for i, e in enumerate(M.edges)])
    return t.select(F.col("seq").alias("effect_seq"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("effect_seq", "x.*")


@query("edge_instances", EDGE_ROWS + " SELECT * FROM e")
def edge_instances(spark, d):
    return edge_rows(spark, d)


@query("edge_violations", EDGE_ROWS + " SELECT *, (observed_dt_ns::DOUBLE - wcet_ns::DOUBLE) / wcet_ns::DOUBLE AS normalized_overrun FROM e WHERE observed_dt_ns > wcet_ns")
def edge_violations(spark, d):
    over = (F.col("observed_dt_ns").cast("double") - F.col("wcet_ns").cast("double")) / F.col("wcet_ns").cast("double")
    return edge_rows(spark, d).where("observed_dt_ns > wcet_ns").withColumn("normalized_overrun", over)


@query("edge_violation_summary", EDGE_ROWS + " SELECT edge_idx, count(*) AS n, count_if(observed_dt_ns > wcet_ns) AS violations, max(observed_dt_ns) AS worst_dt_ns FROM e GROUP BY edge_idx")
def edge_violation_summary(spark, d):
    return edge_rows(spark, d).groupBy("edge_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("observed_dt_ns") > F.col("wcet_ns")).alias("violations"), F.max("observed_dt_ns").alias("worst_dt_ns"))


CANDIDATE = "capture_id, trip_seq, trip_ts, edge_from, edge_to, observed_dt_ns, wcet_ns, normalized_overrun, trigger_seq, effect_seq, trigger_ts"


@query("trip_candidates", chain(CAP) + f" SELECT {CANDIDATE} FROM cand")
def trip_candidates(spark, d):
    return evaluated(spark, d)[2].select(*CANDIDATE.split(", "))


@query("trip_catalysts", chain(CAP) + f" SELECT {CANDIDATE} FROM cand WHERE observed_dt_ns > wcet_ns")
def trip_catalysts(spark, d):
    return evaluated(spark, d)[2].where("observed_dt_ns > wcet_ns").select(*CANDIDATE.split(", "))


@query("trip_catalysts_ranked", chain(CAP) + f" SELECT {CANDIDATE}, rank FROM ranked")
def trip_catalysts_ranked(spark, d):
    return A.catalysts(evaluated(spark, d)[2])


@query("trip_catalysts_ring64", chain(SMALL_CAP) + f" SELECT {CANDIDATE}, rank FROM ranked")
def trip_catalysts_ring64(spark, d):
    return A.catalysts(evaluated(spark, d, SMALL_CAP)[2])


@query("trip_catalysts_ring64_exact", chain(SMALL_CAP) + f" SELECT {CANDIDATE}, rank FROM ranked")
def trip_catalysts_ring64_exact(spark, d):
    """The same over ring arrays, the way for captures whose time runs backward."""
    t = trans(spark, d)
    return A.catalysts(A.candidates(t, A.trips(t, M.trip_node), M, SMALL_CAP, monotone=False))


def rooted(spark, d) -> DataFrame:
    _, found, c = evaluated(spark, d)
    return A.roots(found, A.catalysts(c))


@query("root_catalyst", chain(CAP) + " SELECT * FROM rooted")
def root_catalyst(spark, d):
    return rooted(spark, d)


@query("attribution_summary", chain(CAP) + " SELECT (SELECT count(*) FROM events) AS frames, (SELECT count(*) FROM tr) AS parsed, (SELECT count(*) FROM events) - (SELECT count(*) FROM tr) AS dropped, count(*) AS trips, count(edge_from) AS attributed, count(*) AS rows_written FROM rooted")
def attribution_summary(spark, d):
    r = rooted(spark, d).agg(F.count(F.lit(1)).alias("trips"), F.count("edge_from").alias("attributed"), F.count(F.lit(1)).alias("rows_written"))
    frames = events.read(spark, d).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("event_type").isin(*events.NODES)).alias("parsed"))
    return frames.withColumn("dropped", F.col("frames") - F.col("parsed")).crossJoin(r)  # one row each


TRACE = f"'{evidence.APPLIANCE}:' || trip_ts || ':' || trip_seq"
RESPONSE = "CASE WHEN edge_from IS NULL THEN 0 ELSE greatest(0, trip_ts - trigger_ts) END"
WITHIN = f"edge_from IS NOT NULL AND {RESPONSE} <= {evidence.RESPONSE_BUDGET_NS}"
FLAT = f"SELECT {TRACE} AS trace_id, capture_id, trip_ts, trip_seq, CASE WHEN edge_from IS NULL THEN 'unattributed' ELSE 'attributable' END AS finding, edge_from AS root_from, edge_to AS root_to, normalized_overrun AS root_overrun, {RESPONSE} AS response_time_ns, {WITHIN} AS within_budget FROM rooted"


@query("trace_rows", chain(CAP) + f" {FLAT}")
def trace_rows(spark, d):
    return evidence.rows(rooted(spark, d))


DOCS = f""", lists AS (SELECT capture_id, trip_seq, string_agg(edge_from || '>' || edge_to || ':' || observed_dt_ns, ' ' ORDER BY rank) AS catalysts, count(*)::INT AS n_catalysts FROM ranked GROUP BY ALL),
lasts AS (SELECT trips.trip_seq, string_agg(seq || '@' || (ts - trip_ts), ' ' ORDER BY seq) AS events FROM trips JOIN tr ON seq <= trip_seq AND seq > trip_seq - {BEFORE} GROUP BY ALL)
SELECT {TRACE} AS trace_id, rooted.capture_id::VARCHAR AS capture_id, trip_ts, rooted.trip_seq, CASE WHEN edge_from IS NULL THEN 'unattributed' ELSE 'attributable' END AS finding, normalized_overrun AS root_overrun, trigger_seq AS root_trigger,
  coalesce(catalysts, '') AS catalysts, coalesce(n_catalysts, 0)::INT AS n_catalysts, events, '{evidence.SAFETY_FUNCTION}' AS safety_function_id, {RESPONSE} AS response_time_ns, {evidence.RESPONSE_BUDGET_NS}::BIGINT AS response_budget_ns, {WITHIN} AS within_budget
FROM rooted LEFT JOIN lists USING (capture_id, trip_seq) LEFT JOIN lasts USING (trip_seq)"""


@query("evidence_documents", chain(CAP) + DOCS)
def evidence_documents(spark, d):
    """Documents written as JSON, read again and flattened."""
    t, found, c = evaluated(spark, d)
    docs = evidence.parsed(evidence.documents(found, A.catalysts(c), t, window=BEFORE)).select("document.*")
    listed = lambda c, f: F.array_join(F.transform(c, f), " ")
    return docs.select(
        "trace_id", "capture_id", "trip_ts", "trip_seq", "finding", F.col("root.normalized_overrun").alias("root_overrun"), F.col("root.trigger_seq").alias("root_trigger"),
        listed("catalysts", lambda x: F.concat(x["edge_from"], F.lit(">"), x["edge_to"], F.lit(":"), x["observed_dt_ns"])).alias("catalysts"), F.size("catalysts").alias("n_catalysts"),
        listed("events", lambda x: F.concat_ws("@", x["seq"], x["offset_ns"])).alias("events"), "safety.*",
    )


@query("safety_response", chain(CAP) + f" SELECT capture_id, trip_seq, {RESPONSE} AS response_time_ns, {WITHIN} AS within_budget FROM rooted")
def safety_response(spark, d):
    return evidence.response(rooted(spark, d)).select("capture_id", "trip_seq", "response_time_ns", "within_budget")


@query("preceding_events", f" SELECT trips.capture_id, trip_seq, seq, node, ts, ts - trip_ts AS offset_ns, level FROM trips JOIN tr ON seq <= trip_seq AND seq > trip_seq - {BEFORE}")
def preceding_events(spark, d):
    t = trans(spark, d)
    return evidence.preceding(t, A.trips(t, M.trip_node), BEFORE)


@query("interarrival_gaps", " SELECT * FROM g")
def interarrival_gaps(spark, d):
    return discovery.gaps(streams(spark, d), ["node"])


@query("interarrival_stats", " SELECT * FROM stats")
def interarrival_stats(spark, d):
    return discovery.gap_stats(discovery.gaps(streams(spark, d), ["node"]), ["node"])


@query("loghist_buckets", " SELECT node, bucket, bucket_lo, n FROM bc")
def loghist_buckets(spark, d):
    return discovery.buckets(discovery.gaps(streams(spark, d), ["node"]), ["node"])


@query("loghist_quantiles", " SELECT * FROM quant")
def loghist_quantiles(spark, d):
    return discovery.quantiles(discovery.gaps(streams(spark, d), ["node"]), ["node"])


@query("stream_profile", " SELECT * FROM stats JOIN quant USING (node) ORDER BY node")
def stream_profile(spark, d):
    g = discovery.gaps(streams(spark, d), ["node"])
    return discovery.gap_stats(g, ["node"]).join(discovery.quantiles(g, ["node"]), "node").orderBy("node")


@query("toggle_bits", " SELECT node, 0 AS byte_index, b::INT AS bit_index FROM (SELECT node, xor(bit_or(k), bit_and(k)) AS mask FROM base WHERE node IS NOT NULL GROUP BY node), (SELECT unnest(generate_series(0, 7)) AS b) WHERE (mask >> b) & 1 = 1")
def toggle_bits(spark, d):
    e = events.read(spark, d).where(F.col("event_type").isin(*events.NODES))
    node = F.element_at(F.create_map(*[F.lit(x) for kv in events.NODES.items() for x in kv]), F.col("event_type")).cast("long")
    rows = e.select(node.alias("node"), F.col("event_id").alias("frame_no"), F.unhex(F.lpad(F.hex(F.col("k").cast("long")), 2, "0")).alias("payload"))
    return discovery.toggles(rows, ["node"])


def whole(spark, d) -> DataFrame:
    return preflight.span_and_gap(events.read(spark, d).withColumn("capture_id", F.lit(0)), ["capture_id"], "event_id", "ts")


@query("capture_span", " SELECT greatest(0, arg_max(ts, event_id) - arg_min(ts, event_id)) AS span_ns FROM base")
def capture_span(spark, d):
    return whole(spark, d).select("span_ns")


@query("min_forward_gap", " SELECT min(CASE WHEN ts > was THEN ts - was END) AS min_forward_gap_ns FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS was FROM base)")
def min_forward_gap(spark, d):
    return whole(spark, d).select("min_forward_gap_ns")


TOPOLOGY = ", nodes AS (SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey % 11 != 4), edges AS (SELECT n_nationkey::INT AS edge_idx, (n_nationkey * 3 % 21)::BIGINT AS source, (n_nationkey * 5 % 27)::BIGINT AS target, CASE n_regionkey WHEN 0 THEN 0 WHEN 1 THEN 500 WHEN 2 THEN 60000000000 WHEN 3 THEN 60000000001 ELSE 9000 END::BIGINT AS budget_ns FROM nation)"


def topology(spark, d):
    """A dependency graph made of the nations."""
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("k", F.col("n_nationkey").cast("long"))
    budget = F.element_at(F.array(*[F.lit(x).cast("long") for x in (0, 500, 60_000_000_000, 60_000_000_001, 9_000)]), F.col("n_regionkey").cast("int") + 1)
    return n.where("k % 11 != 4").select(F.col("k").alias("id")), n.select(F.col("k").cast("int").alias("edge_idx"), (F.col("k") * 3 % 21).alias("source"), (F.col("k") * 5 % 27).alias("target"), budget.alias("budget_ns"))


@query("manifest_dangling", TOPOLOGY + " SELECT edge_idx, source AS missing FROM edges WHERE source NOT IN (SELECT id FROM nodes) UNION ALL SELECT edge_idx, target FROM edges WHERE target NOT IN (SELECT id FROM nodes)")
def manifest_dangling(spark, d):
    return manifest.dangling(*topology(spark, d))


@query("manifest_orphans", TOPOLOGY + " SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def manifest_orphans(spark, d):
    return manifest.orphans(*topology(spark, d))


@query("manifest_degree", TOPOLOGY + " SELECT id, (SELECT count(*) FROM edges WHERE target = id) AS in_degree, (SELECT count(*) FROM edges WHERE source = id) AS out_degree FROM nodes")
def manifest_degree(spark, d):
    return manifest.degrees(*topology(spark, d))


@query("manifest_budgets", TOPOLOGY + " SELECT edge_idx, CASE WHEN budget_ns <= 0 OR budget_ns > 60000000000 THEN 'bad_budget' WHEN budget_ns < 1000 THEN 'tight_budget' END AS finding FROM edges WHERE budget_ns <= 0 OR budget_ns > 60000000000 OR budget_ns < 1000")
def manifest_budgets(spark, d):
    return manifest.budgets(topology(spark, d)[1])


@query("manifest_cycle_nodes", TOPOLOGY + ", reach(start, node) AS (SELECT source, target FROM edges UNION SELECT r.start, e.target FROM reach r JOIN edges e ON e.source = r.node) SELECT DISTINCT start AS id FROM reach WHERE start = node")
def manifest_cycle_nodes(spark, d):
    return manifest.cycle_members(topology(spark, d)[1])


def document(k: int, region: int) -> str:
    """A manifest as JSON: five nodes in a line, with one fault of each kind by k."""
    import json

    nodes = [{"id": i, "type": "profinet", "frame_id": 100 + i, "bit_index": region} for i in range(1, 5)] + [{"id": 5, "type": "ros2_port", "topic_port": 9000 + region}]
    edges = [{"from": i, "to": i + 1, "wcet_ns": 2_000 + k} for i in range(1, 4)] + [{"from": 5, "to": 1, "wcet_ns": 40_000}]
    doc = {"cell_name": f"cell {region}", "nodes": nodes, "edges": edges, "trip_node": 4}
    kind = k % 12
    if kind == 1:
        doc["nodes"] = []
    elif kind == 2:
        nodes.append({"id": 2, "type": "fanuc_pose"})
    elif kind == 3:
        doc["trip_node"] = 70
    elif kind == 4:
        doc["trip_node"] = 5
    elif kind == 5:
        edges.append({"from": 1, "to": 80, "wcet_ns": 10})
    elif kind in (6, 7, 8):
        edges[0]["wcet_ns"] = {6: 0, 7: 60_000_000_001, 8: 60_000_000_000}[kind]
    elif kind == 9:
        edges.append({"from": 4, "to": 1, "wcet_ns": 10_000})
    elif kind == 10:
        edges.append({"from": 3, "to": 3, "wcet_ns": 10_000})
    elif kind == 11:
        del doc["trip_node"]
    return json.dumps(doc)


OUTCOMES = "['valid', 'empty', 'duplicate_node', 'trip_undeclared', 'trip_not_interlock', 'dangling_node', 'bad_budget', 'bad_budget', 'valid', 'dependency_cycle', 'dependency_cycle', 'json']"


@query("manifest_validation", f" SELECT n_nationkey::BIGINT AS id, ({OUTCOMES})[n_nationkey % 12 + 1] AS outcome, CASE WHEN n_nationkey % 12 IN (0, 8) THEN 0 ELSE 1 END::INT AS code FROM nation")
def manifest_validation(spark, d):
    """The first failure of a manifest for each nation (25 rows), and the command's return code."""
    out = []
    for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_regionkey").collect():
        outcome = manifest.outcome(document(int(r["n_nationkey"]), int(r["n_regionkey"])))
        out.append((int(r["n_nationkey"]), outcome, 0 if outcome == "valid" else 1))
    return spark.createDataFrame(out, "id long, outcome string, code int")


@query("evidence_range", chain(CAP) + f", rows_ AS ({FLAT}) SELECT * FROM rows_ WHERE trip_ts >= {RANGE[0]} AND trip_ts < {RANGE[1]}")
def evidence_range(spark, d):
    """Rows put into a store by day in the shared folder, and scanned by time."""
    kept = store.EvidenceStore(spark, f"{shared(spark)}/evidence-{uuid.uuid4().hex}")
    kept.put(evidence.rows(rooted(spark, d)))
    return kept.range(*RANGE)


@query("evidence_in_memory", chain(CAP) + f", rows_ AS ({FLAT}) SELECT * FROM rows_ WHERE trip_ts >= {RANGE[0]} AND trip_ts < {RANGE[1]}")
def evidence_in_memory(spark, d):
    kept, rows = store.EvidenceMemory(), evidence.rows(rooted(spark, d))
    kept.put(rows.where("trip_seq % 2 = 0"))
    kept.put(rows.where("trip_seq % 2 = 1"))
    return kept.range(*RANGE)


@query("evidence_length", chain(CAP) + " SELECT count(*) AS n, count(*) = 0 AS is_empty FROM rooted")
def evidence_length(spark, d):
    kept = store.EvidenceStore(spark, f"{shared(spark)}/evidence-{uuid.uuid4().hex}")
    kept.put(evidence.rows(rooted(spark, d)))
    return spark.createDataFrame([(len(kept), kept.is_empty())], "n long, is_empty boolean")


@query("evidence_duplicates", chain(CAP) + f", rows_ AS ({FLAT}), twice AS (SELECT * FROM rows_ UNION ALL SELECT * FROM rows_ WHERE trip_seq % 2 = 0) SELECT trip_ts, trace_id, count(*) AS n FROM twice GROUP BY trip_ts, trace_id HAVING count(*) > 1")
def evidence_duplicates(spark, d):
    r = evidence.rows(rooted(spark, d))
    return store.duplicates(r.unionByName(r.where("trip_seq % 2 = 0")))


@query("evidence_keys", chain(CAP) + f" SELECT trip_seq, hex(trip_ts) AS ts_hex, upper(lpad(hex(trip_ts), 16, '0')) || upper(hex({TRACE})) AS key_hex FROM rooted")
def evidence_keys(spark, d):
    r = evidence.rows(rooted(spark, d))
    return r.select("trip_seq", F.hex("trip_ts").alias("ts_hex"), F.hex(X.evidence_key(F.col("trip_ts"), F.col("trace_id"))).alias("key_hex"))


@query("jitter_floor_flag", chain(CAP) + ", floors(ts_source, floor_ns) AS (VALUES ('hardware', 1000::BIGINT), ('kernel', 100000), ('replay', 0)) SELECT trip_seq, rank, ts_source, floor_ns, (observed_dt_ns - wcet_ns) > floor_ns AS above_floor FROM ranked, floors")
def jitter_floor_flag(spark, d):
    c = A.catalysts(evaluated(spark, d)[2]).withColumn("ts_source", F.explode(F.array(*[F.lit(s) for s in X.JITTER_FLOOR_NS])))
    return c.withColumn("floor_ns", X.jitter_floor(F.col("ts_source"))).select("trip_seq", "rank", "ts_source", "floor_ns", ((F.col("observed_dt_ns") - F.col("wcet_ns")) > F.col("floor_ns")).alias("above_floor"))


@query("format_duration", " SELECT frame_no, CASE WHEN v >= 1000000 THEN printf('%d.%03d ms', (v + 500) // 1000000, (v + 500) // 1000 % 1000) WHEN v >= 1000 THEN printf('%d.%d us', (v + 50) // 1000, (v + 50) // 100 % 10) ELSE printf('%d ns', v) END AS shown FROM (SELECT frame_no, gap_ns // (10 ** (frame_no % 8))::BIGINT AS v FROM g WHERE gap_ns IS NOT NULL)")
def format_duration(spark, d):
    g = discovery.gaps(streams(spark, d), ["node"]).where("gap_ns is not null").withColumn("v", F.expr("gap_ns div cast(pow(10, frame_no % 8) as bigint)"))
    return g.select("frame_no", X.format_duration(F.col("v")).alias("shown"))


def f32_hex(v) -> F.Column:
    """Little-endian bytes of a whole number from 0 to 99 as a single."""
    e = F.length(F.bin(v)) - 1
    bits = F.when(v == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", (F.lit(127) + e).cast("long"), F.lit(23)) + F.call_function("shiftleft", v - F.call_function("shiftleft", F.lit(1).cast("long"), e), F.lit(23) - e))
    be = F.lpad(F.hex(bits), 8, "0")
    return F.concat(*[F.substring(be, i, 2) for i in (7, 5, 3, 1)])


def frames(spark, d) -> DataFrame:
    """A frame for each event: views are UDP, clicks poses, signups TCP 102, purchases tagged cyclic I/O, errors cyclic I/O."""
    e = events.read(spark, d)
    k = F.col("k").cast("long")
    h2, h4 = (lambda v: F.lpad(F.hex(v), 2, "0")), (lambda v: F.lpad(F.hex(v), 4, "0"))
    zero = lambda n: F.lit("00" * n)
    ip = lambda proto: F.concat(F.lit("45"), zero(8), F.lit(proto), zero(10))
    t = F.col("event_type")
    cyclic = F.concat(h4(F.lit(5).cast("long")), h2(k), zero(43))
    udp = F.concat(F.lit("0800"), ip("11"), zero(2), h4(7400 + k), h4(8 + k % 16), zero(2), F.repeat(F.lit("AB"), (k % 16).cast("int")))
    pose = F.concat(F.lit("0800"), ip("11"), zero(2), F.lit("EA68"), h4(F.lit(20).cast("long")), zero(2), f32_hex(k), f32_hex(k % 7), f32_hex(F.lit(0).cast("long")))
    tcp = F.concat(F.lit("0800"), ip("06"), F.lit("0066"), h4(40000 + k), zero(16))
    body = F.when(t == "view", udp).when(t == "click", pose).when(t == "signup", tcp).when(t == "purchase", F.concat(F.lit("81000001"), F.lit("8892"), cyclic)).otherwise(F.concat(F.lit("8892"), cyclic))
    return e.select("event_id", "event_type", "k", F.lit("0").alias("capture_id"), F.col("event_id").alias("frame_no"), F.col("ts").alias("tap_ts_ns"), F.unhex(F.concat(zero(12), body)).alias("raw"))


DECODED = ["frame_no", "proto", "parse_error", "ethertype", "vlan", "frame_id", "status_byte", "interlock_bit", "dst_port", "payload_len", "x_mm", "y_mm", "z_mm", "s7_port"]


@query("frame_roundtrip", """ SELECT event_id AS frame_no,
  CASE event_type WHEN 'view' THEN 'udp' WHEN 'click' THEN 'pose' WHEN 'signup' THEN 's7' ELSE 'cyclic' END AS proto, NULL::VARCHAR AS parse_error,
  CASE WHEN event_type IN ('purchase', 'error') THEN 34962 ELSE 2048 END::INT AS ethertype, event_type = 'purchase' AS vlan,
  CASE WHEN event_type IN ('purchase', 'error') THEN 5 END::INT AS frame_id, CASE WHEN event_type IN ('purchase', 'error') THEN k END::INT AS status_byte, CASE WHEN event_type IN ('purchase', 'error') THEN k % 2 = 1 END AS interlock_bit,
  CASE event_type WHEN 'view' THEN 7400 + k WHEN 'click' THEN 60008 END::INT AS dst_port, CASE event_type WHEN 'view' THEN k % 16 WHEN 'click' THEN 12 END::INT AS payload_len,
  CASE WHEN event_type = 'click' THEN k END::FLOAT AS x_mm, CASE WHEN event_type = 'click' THEN k % 7 END::FLOAT AS y_mm, CASE WHEN event_type = 'click' THEN 0 END::FLOAT AS z_mm,
  CASE WHEN event_type = 'signup' THEN 102 END::INT AS s7_port FROM base""")
def frame_roundtrip(spark, d):
    return decode.decode(frames(spark, d)).select(*DECODED)


@query("ethertype_histogram", " SELECT CASE WHEN event_type IN ('purchase', 'error') THEN 34962 ELSE 2048 END::INT AS ethertype, count(*) AS n FROM base GROUP BY 1")
def ethertype_histogram(spark, d):
    return preflight.ethertypes(decode.decode(frames(spark, d)))


@query("vlan_frames", " SELECT count(*) FILTER (event_type = 'purchase') AS n FROM base")
def vlan_frames(spark, d):
    return decode.decode(frames(spark, d)).agg(F.count_if("vlan").alias("n"))


KINDS = 12


def odd_frames(spark, d) -> DataFrame:
    """A frame for each event, in turn of twelve kinds, refused ones among them; three captures; some cut by the tap, some longer than they claim."""
    e = events.read(spark, d)
    k = F.col("k").cast("long")
    h2, h4 = (lambda v: F.lpad(F.hex(v), 2, "0")), (lambda v: F.lpad(F.hex(v), 4, "0"))
    zero = lambda n: F.lit("00" * n)
    ip = lambda proto: F.concat(F.lit("080045"), zero(8), F.lit(proto), zero(10))
    cyclic = F.concat(F.lit("8892"), h4(F.lit(5).cast("long")), h2(k), h2(k * 37 % 256), h2(k * 101 % 256), zero(8))
    udp = lambda port, length, payload: F.concat(ip("11"), zero(2), h4(port), h4(length), zero(2), payload)
    long_ = lambda x: F.lit(x).cast("long")
    tcp = lambda a, b: F.concat(ip("06"), h4(a), h4(b), zero(16))
    bodies = [
        cyclic, F.concat(F.lit("81000001"), cyclic), udp(7400 + k % 4, 8 + k % 16, F.repeat(F.lit("AB"), (k % 16).cast("int"))),
        udp(long_(60008), long_(20), F.concat(f32_hex(k), f32_hex(k % 7), f32_hex(long_(0)))), tcp(40000 + k, long_(102)), tcp(40000 + k, long_(80)), None,
        F.concat(F.lit("88A4"), zero(40)), udp(7400 + k % 4, long_(40), zero(4)), udp(long_(60008), long_(16), zero(8)), F.concat(F.lit("0800"), zero(6)), F.lit("81000001"),
    ]
    kind = F.col("event_id") % KINDS
    hexed = F.lit("00" * 8)
    for i, body in enumerate(bodies):
        if body is not None:
            hexed = F.when(kind == i, F.concat(zero(12), body)).otherwise(hexed)
    raw = F.unhex(hexed)
    out = e.select((F.col("event_id") % 3).cast("string").alias("capture_id"), F.col("event_id").alias("frame_no"), F.col("ts").alias("tap_ts_ns"), raw.alias("raw"), F.when(k % 5 == 0, 10).when(k % 5 == 1, -3).otherwise(0).alias("more"))
    return out.select("capture_id", "frame_no", "tap_ts_ns", F.length("raw").alias("incl_len"), (F.length("raw") + F.col("more")).cast("int").alias("orig_len"), "raw")


#: The same frames by arithmetic: what each is, and what it holds.
ODD = """, odd AS (SELECT (event_id % 3)::VARCHAR AS capture_id, event_id AS frame_no, ts AS tap_ts_ns, k, (event_id % 12)::INT AS kind, k % 5 = 0 AS cut FROM base),
dec AS (SELECT *, CASE kind WHEN 0 THEN 'cyclic' WHEN 1 THEN 'cyclic' WHEN 2 THEN 'udp' WHEN 3 THEN 'pose' WHEN 4 THEN 's7' END AS proto,
  CASE kind WHEN 5 THEN 'unhandled_ethertype' WHEN 6 THEN 'truncated' WHEN 7 THEN 'unhandled_ethertype' WHEN 8 THEN 'bad_udp' WHEN 9 THEN 'short_payload' WHEN 10 THEN 'bad_ipv4' WHEN 11 THEN 'truncated' END AS parse_error,
  CASE WHEN kind IN (0, 1) THEN 34962 WHEN kind = 6 THEN NULL WHEN kind = 7 THEN 34980 WHEN kind = 11 THEN 33024 ELSE 2048 END::INT AS ethertype, kind IN (1, 11) AS vlan FROM odd),
claimed AS (SELECT *, CASE WHEN kind IN (0, 1) THEN 4 WHEN kind = 2 AND k % 4 = 1 THEN 1 WHEN kind = 2 AND k % 4 = 2 THEN 2 WHEN kind = 3 THEN 3 END::BIGINT AS node FROM dec),
cls AS (SELECT capture_id, frame_no, node, tap_ts_ns AS ts, CASE WHEN node = 4 THEN (k >> 1) % 2 = 1 END AS level FROM claimed WHERE node IS NOT NULL),
str AS (SELECT *, CASE WHEN kind < 2 THEN 'cyclic' WHEN kind < 4 THEN 'udp' ELSE 's7' END AS skind, CASE WHEN kind < 2 THEN 0 WHEN kind < 4 THEN 1 ELSE 2 END::INT AS kind_rank, CASE WHEN kind < 2 THEN 5 WHEN kind = 2 THEN 7400 + k % 4 WHEN kind = 3 THEN 60008 ELSE 102 END::INT AS stream_id FROM dec WHERE parse_error IS NULL),
sg AS (SELECT *, CASE WHEN was IS NOT NULL THEN greatest(0, tap_ts_ns - was) END AS gap_ns FROM (SELECT *, lag(tap_ts_ns) OVER (PARTITION BY capture_id, skind, stream_id ORDER BY frame_no) AS was FROM str))"""
FRAME_NODES = manifest.parse('{"nodes": [{"id": 1, "type": "ros2_port", "topic_port": 7401}, {"id": 2, "type": "ros2_port", "topic_port": 7402}, {"id": 3, "type": "fanuc_pose"}, {"id": 4, "type": "profinet", "frame_id": 5, "bit_index": 1}, {"id": 6, "type": "profinet", "frame_id": 5, "bit_index": 3}], "edges": [{"from": 1, "to": 3, "wcet_ns": 900000000}, {"from": 2, "to": 3, "wcet_ns": 300000000}, {"from": 3, "to": 4, "wcet_ns": 700000000}], "trip_node": 4}')


def odd(spark, d) -> DataFrame:
    return decode.decode(odd_frames(spark, d))


@query("frame_refusals", ODD + " SELECT capture_id, frame_no, proto, parse_error, ethertype, vlan FROM dec")
def frame_refusals(spark, d):
    return odd(spark, d).select("capture_id", "frame_no", "proto", "parse_error", "ethertype", "vlan")


@query("rejected_types", ODD + " SELECT capture_id, ethertype, CASE WHEN ethertype IS NULL THEN 'malformed' WHEN ethertype = 2048 THEN 'IPv4' WHEN ethertype = 33024 THEN 'VLAN' ELSE 'other' END AS name, CASE WHEN ethertype = 2048 THEN 'partial' ELSE 'unsupported' END AS status, count(*) AS n FROM dec WHERE parse_error IS NOT NULL GROUP BY capture_id, ethertype")
def rejected_types(spark, d):
    return discovery.rejected(odd(spark, d))


@query("top_types", ODD + " SELECT ethertype, count(*) AS n FROM dec WHERE ethertype IS NOT NULL GROUP BY ethertype ORDER BY n DESC, ethertype LIMIT 12")
def top_types(spark, d):
    return preflight.ethertypes(odd(spark, d))


FACTS = """, tally AS (SELECT capture_id, count(*) AS total, count_if(parse_error IS NULL) AS classifiable, count_if(parse_error IS NOT NULL) AS unclassified, count_if(kind = 6) AS malformed, count_if(vlan) AS vlan_frames, count_if(cut) AS truncated_frames, max(CASE WHEN k % 5 = 1 THEN 3 ELSE 0 END)::INT AS max_excess_len,
  greatest(0, arg_max(tap_ts_ns, frame_no) - arg_min(tap_ts_ns, frame_no)) AS span_ns, min(CASE WHEN tap_ts_ns > before THEN tap_ts_ns - before END) AS min_forward_gap_ns
  FROM (SELECT *, lag(tap_ts_ns) OVER (PARTITION BY capture_id ORDER BY frame_no) AS before FROM dec) GROUP BY capture_id)"""


@query("preflight_facts", ODD + FACTS + " SELECT *, unclassified::DOUBLE / total::DOUBLE AS unclassified_fraction, CASE WHEN unclassified::DOUBLE / total::DOUBLE > 0.20::DOUBLE THEN 'coverage_gap' ELSE 'analyzable' END AS verdict FROM tally")
def preflight_facts(spark, d):
    return preflight.facts(odd(spark, d))


MILD = " WHERE kind IN (0, 1, 2, 3) OR (capture_id = '1' AND kind IN (4, 7)) OR (capture_id = '2' AND k % 5 = 1)"


@query("preflight_verdict", ODD + f", part AS (SELECT * FROM dec{MILD}) SELECT capture_id, count(*) AS total, count_if(parse_error IS NOT NULL)::DOUBLE / count(*)::DOUBLE AS unclassified_fraction, CASE WHEN count_if(parse_error IS NOT NULL)::DOUBLE / count(*)::DOUBLE > 0.20::DOUBLE THEN 'coverage_gap' ELSE 'analyzable' END AS verdict FROM part GROUP BY capture_id UNION ALL SELECT 'none', 0::BIGINT, 0.0::DOUBLE, 'rejected_empty' UNION ALL SELECT 'odd', 0::BIGINT, 0.0::DOUBLE, 'format_rejected'")
def preflight_verdict(spark, d):
    """Captures of which some frames were kept, an empty one, and one that is no capture."""
    kind = F.col("frame_no") % KINDS
    frames_ = odd_frames(spark, d).join(events.read(spark, d).select(F.col("event_id").alias("frame_no"), "k"), "frame_no")
    kept = frames_.where(kind.isin(0, 1, 2, 3) | ((F.col("capture_id") == "1") & kind.isin(4, 7)) | ((F.col("capture_id") == "2") & (F.col("k") % 5 == 1)))
    names = spark.createDataFrame([("0", None), ("1", None), ("2", None), ("none", None), ("odd", "magic")], "capture_id string, format_error string")
    return preflight.facts(decode.decode(kept), names).select("capture_id", "total", "unclassified_fraction", "verdict")


@query("frame_classification", ODD + " SELECT * FROM cls")
def frame_classification(spark, d):
    """Frames claimed by the nodes of a manifest; two nodes name one frame id, the lesser has it."""
    return A.classify(odd(spark, d), manifest.validate(FRAME_NODES))


@query("unclaimed_frames", ODD + " SELECT capture_id, count(*) AS n FROM claimed WHERE node IS NULL GROUP BY capture_id")
def unclaimed_frames(spark, d):
    """Frames that no node claims or that were refused, by capture."""
    decoded = odd(spark, d)
    return decoded.join(A.classify(decoded, FRAME_NODES).select("capture_id", "frame_no"), ["capture_id", "frame_no"], "left_anti").groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))


@query("frame_trips", ODD + ", num AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_no) - 1 AS seq FROM cls) SELECT capture_id, seq AS trip_seq, ts AS trip_ts FROM (SELECT *, lag(level) OVER (PARTITION BY capture_id ORDER BY seq) AS was FROM num WHERE level IS NOT NULL) WHERE was AND NOT level")
def frame_trips(spark, d):
    return A.trips(A.transitions(A.classify(odd(spark, d), FRAME_NODES)), FRAME_NODES.trip_node)


FRAME_QUANTILES = ", ".join(f"CASE WHEN any_value(gap_count) >= 30 THEN least(greatest(min(CASE WHEN c >= greatest(1, least(ceil({q}::DOUBLE * gap_count), gap_count)) THEN bucket_lo END), any_value(gap_min)), any_value(gap_max)) END AS {n}" for n, q in discovery.QUANTILES.items())
PROFILE = f""", sstats AS (SELECT capture_id, kind_rank, skind, stream_id, count(*) AS frames, count(gap_ns) AS gap_count, coalesce(min(gap_ns), 0) AS gap_min, coalesce(max(gap_ns), 0) AS gap_max, coalesce(sum(gap_ns)::HUGEINT // nullif(count(gap_ns), 0), 0)::BIGINT AS gap_mean FROM sg GROUP BY ALL),
sbits AS (SELECT capture_id, skind, stream_id, gap_ns, length(bin(gap_ns)) - 1 AS band FROM sg WHERE gap_ns IS NOT NULL),
sbk AS (SELECT capture_id, skind, stream_id, CASE WHEN gap_ns = 0 THEN 0 ELSE band * 8 + CASE WHEN band >= 3 THEN (gap_ns - (1::BIGINT << band)) >> (band - 3) ELSE ((gap_ns - (1::BIGINT << band)) * 8) >> band END END::INT AS bucket FROM sbits),
sbc AS (SELECT capture_id, skind, stream_id, bucket, count(*) AS n, CASE WHEN bucket = 0 THEN 0 ELSE (1::BIGINT << (bucket // 8)) + (((bucket % 8)::BIGINT << (bucket // 8)) >> 3) END AS bucket_lo FROM sbk GROUP BY ALL),
scum AS (SELECT sbc.*, sum(n) OVER (PARTITION BY capture_id, skind, stream_id ORDER BY bucket) AS c, gap_count, gap_min, gap_max FROM sbc JOIN sstats USING (capture_id, skind, stream_id)),
squant AS (SELECT capture_id, skind, stream_id, {FRAME_QUANTILES} FROM scum GROUP BY ALL),
pay AS (SELECT capture_id, unnest([0, 1, 2]) AS byte, unnest([k, k * 37 % 256, k * 101 % 256]) AS v FROM str WHERE kind < 2),
mask AS (SELECT capture_id, byte, xor(bit_or(v), bit_and(v)) AS m FROM pay GROUP BY ALL),
tog AS (SELECT capture_id, byte, b FROM mask, (SELECT unnest(generate_series(0, 7)) AS b) WHERE (m >> b) & 1 = 1),
shown AS (SELECT capture_id, count(*)::INT AS n_toggles, string_agg(byte || '.' || b, ' ' ORDER BY byte, b) FILTER (r <= {discovery.TOGGLES_SHOWN}) AS toggles FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY byte, b) AS r FROM tog) GROUP BY capture_id)
SELECT s.capture_id, s.kind_rank, s.skind AS kind, s.stream_id, frames, gap_count, gap_min, gap_max, gap_mean, {", ".join(discovery.QUANTILES)}, CASE WHEN s.kind_rank = 0 THEN toggles END AS toggles, CASE WHEN s.kind_rank = 0 THEN coalesce(n_toggles, 0) ELSE 0 END::INT AS n_toggles
FROM sstats s LEFT JOIN squant q ON s.capture_id = q.capture_id AND s.skind = q.skind AND s.stream_id = q.stream_id LEFT JOIN shown ON s.capture_id = shown.capture_id"""


@query("frame_profile", ODD + PROFILE)
def frame_profile(spark, d):
    return discovery.report(discovery.profile(odd(spark, d)))


@query("pcap_roundtrip", ODD + """ SELECT regexp_replace('capture-' || capture_id, '$', '.pcap') AS name, row_number() OVER (PARTITION BY capture_id ORDER BY frame_no) - 1 AS frame_no, tap_ts_ns // 1000 * 1000 AS tap_ts_ns,
  size AS incl_len, (size + CASE WHEN cut THEN 10 WHEN k % 5 = 1 THEN -3 ELSE 0 END)::INT AS orig_len, 'kernel' AS ts_source, proto, parse_error, ethertype
FROM (SELECT *, (CASE kind WHEN 0 THEN 27 WHEN 1 THEN 31 WHEN 2 THEN 42 + k % 16 WHEN 3 THEN 54 WHEN 4 THEN 54 WHEN 5 THEN 54 WHEN 6 THEN 8 WHEN 7 THEN 54 WHEN 8 THEN 46 WHEN 9 THEN 50 WHEN 10 THEN 20 ELSE 16 END)::INT AS size FROM dec)""")
def pcap_roundtrip(spark, d):
    """Captures written to the shared folder by a task each, read by the data source in parts, and decoded."""
    folder = f"{shared(spark)}/captures-{uuid.uuid4().hex}"
    pcap.write_captures(odd_frames(spark, d), folder)
    pcap.register(spark)
    read = spark.read.format("pcap").option("ts_source", "kernel").option("split_bytes", 60_000).load(folder)
    return decode.decode(read).select(F.element_at(F.split("capture_id", "/"), -1).alias("name"), "frame_no", "tap_ts_ns", "incl_len", "orig_len", "ts_source", "proto", "parse_error", "ethertype")
