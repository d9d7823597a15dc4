"""Dependency manifests: loading, validation (first failure wins), lints, graph order. Tens of edges, on the driver;
the checks also exist over DataFrames for topologies kept in tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BUDGET_NS, TIGHT_BUDGET_NS = 60_000_000_000, 1_000


class ManifestError(ValueError):
    """Why a manifest was refused: kind, and the ids it is about."""

    def __init__(self, kind: str, *ids: int):
        super().__init__(f"{kind}{ids or ''}")
        self.kind, self.ids = kind, ids


@dataclass(frozen=True)
class Node:
    id: int
    kind: str  # profinet, ros2_port, fanuc_pose
    label: str = ""
    frame_id: int | None = None
    bit_index: int = 0
    topic_port: int | None = None


@dataclass(frozen=True)
class Edge:
    source: int
    target: int
    budget_ns: int


@dataclass(frozen=True)
class Manifest:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]
    trip_node: int
    cell_name: str = ""
    incoming: dict[int, list[tuple[int, Edge]]] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for e in self.edges:
            into = self.incoming.setdefault(e.target, [])
            into.append((len(into), e))

    def walk_order(self) -> list[int]:
        """The trip node and all upstream of it, each after the nodes that it feeds."""
        reach, todo = set(), [self.trip_node]
        while todo:
            n = todo.pop()
            if n not in reach:
                reach.add(n)
                todo += [e.source for _, e in self.incoming.get(n, [])]
        waiting = {n: sum(e.source == n and e.target in reach for e in self.edges) for n in reach}
        ready, out = [self.trip_node], []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for _, e in self.incoming.get(n, []):
                waiting[e.source] -= 1
                if not waiting[e.source]:
                    ready.append(e.source)
        return out


def _whole(obj: dict, key: str, bits: int, required: bool = True):
    if key not in obj or obj[key] is None:
        if required:
            raise ManifestError("json")
        return None
    v = obj[key]
    if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v < 1 << bits:
        raise ManifestError("json")
    return v


def parse(text: str) -> Manifest:
    """From JSON; a missing key or a number out of range is a 'json' error. Not validated yet."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise ManifestError("json") from e
    if not isinstance(doc, dict) or not all(isinstance(doc.get(k), list) for k in ("nodes", "edges")):
        raise ManifestError("json")
    nodes = []
    for n in doc["nodes"]:
        kind = n.get("type") if isinstance(n, dict) else None
        if kind not in ("profinet", "ros2_port", "fanuc_pose"):
            raise ManifestError("json")
        cyclic = kind == "profinet"
        nodes.append(Node(_whole(n, "id", 32), kind, n.get("label", ""), _whole(n, "frame_id", 16, cyclic), _whole(n, "bit_index", 8, cyclic) or 0, _whole(n, "topic_port", 16, kind == "ros2_port")))
    edges = [Edge(_whole(e, "from", 32), _whole(e, "to", 32), _whole(e, "wcet_ns", 64)) for e in doc["edges"] if isinstance(e, dict) or _refuse()]
    return Manifest(tuple(nodes), tuple(edges), _whole(doc, "trip_node", 32), doc.get("cell_name", ""))


def _refuse():
    raise ManifestError("json")


def load(path: str) -> Manifest:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except OSError as e:
        raise ManifestError("io") from e


def cycle_nodes(edges) -> set[int]:
    """Nodes on or between cycles: what stays when sources and sinks are taken away again and again."""
    left = list(edges)
    while True:
        starts, ends = {e.source for e in left}, {e.target for e in left}
        kept = [e for e in left if e.source in ends and e.target in starts]
        if len(kept) == len(left):
            return {e.source for e in left}
        left = kept


def validate(m: Manifest) -> Manifest:
    ids = set()
    if not m.nodes:
        raise ManifestError("empty")
    for n in m.nodes:
        if n.id in ids:
            raise ManifestError("duplicate_node", n.id)
        if n.bit_index > 7:
            raise ManifestError("bad_bit_index", n.id)
        ids.add(n.id)
    if m.trip_node not in ids:
        raise ManifestError("trip_undeclared", m.trip_node)
    if next(n for n in m.nodes if n.id == m.trip_node).kind != "profinet":
        raise ManifestError("trip_not_interlock", m.trip_node)
    for e in m.edges:
        for end in (e.source, e.target):
            if end not in ids:
                raise ManifestError("dangling_node", end)
        if not 0 < e.budget_ns <= MAX_BUDGET_NS:
            raise ManifestError("bad_budget", e.source, e.target)
    if looped := cycle_nodes(m.edges):
        raise ManifestError("dependency_cycle", min(looped))
    return m


def outcome(text: str) -> str:
    """'valid', or the kind of the first failure of a manifest given as JSON."""
    try:
        validate(parse(text))
    except ManifestError as e:
        return e.kind
    return "valid"


def lint(m: Manifest) -> list[tuple]:
    """(kind, ids...) in a fixed order: unreachable trip, orphans, tight budgets, ambiguous matchers."""
    ends = {x for e in m.edges for x in (e.source, e.target)}
    out: list[tuple] = []
    if not m.incoming.get(m.trip_node):
        out.append(("trip_unreachable", m.trip_node))
    out += [("orphan_node", i) for i in sorted(n.id for n in m.nodes if n.id not in ends)]
    out += [("tight_budget", e.source, e.target, e.budget_ns) for e in sorted(m.edges, key=lambda e: (e.source, e.target)) if e.budget_ns < TIGHT_BUDGET_NS]
    seen: dict = {}
    for n in sorted(m.nodes, key=lambda n: n.id):
        key = (n.kind, n.frame_id, n.topic_port)
        if key in seen:
            out.append(("ambiguous_matcher", seen[key], n.id))
        seen.setdefault(key, n.id)
    return out


# The checks over tables nodes(id) and edges(edge_idx, source, target, budget_ns).


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("edge_idx", F.explode(F.array("source", "target")).alias("id"))
    return ends.join(nodes.select("id"), "id", "left_anti").select("edge_idx", F.col("id").alias("missing"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    summed = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("long")
    return nodes.select("id").join(summed, "id", "left").select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))



def budgets(edges: DataFrame) -> DataFrame:
    """edge_idx and what is wrong with its budget: bad_budget or tight_budget."""
    b = F.col("budget_ns")
    finding = F.when((b <= 0) | (b > MAX_BUDGET_NS), "bad_budget").when(b < TIGHT_BUDGET_NS, "tight_budget")
    return edges.select("edge_idx", finding.alias("finding")).where("finding is not null")


#: Edges that may pass the driver; a manifest has tens.
MOST_EDGES = 100_000


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves; edges are few, which is checked, and come through the driver."""
    rows = [(r["source"], r["target"]) for r in edges.select("source", "target").limit(MOST_EDGES + 1).collect()]
    if len(rows) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges")
    reach = {a: {b for x, b in rows if x == a} for a, _ in rows}
    grown = True
    while grown:
        grown = False
        for a in reach:
            more = set().union(*(reach.get(b, set()) for b in reach[a])) - reach[a]
            if more:
                reach[a] |= more
                grown = True
    return edges.sparkSession.createDataFrame([(a,) for a in sorted(reach) if a in reach[a]], "id long")
