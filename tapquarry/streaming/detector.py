"""Trips in a stream of classified frames: state per capture is the next number, the trip node's last level and the ring.

Rows of a micro-batch are put in frame order first; across batches order is that of arrival, so no watermark
is needed. Each trip comes out with its ranked catalysts, walked over the ring as the batch plan does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from tapquarry.operators.manifest import Manifest

CAP = 10_000
OUT = "capture_id long, trip_seq long, trip_ts long, rank int, edge_from long, edge_to long, observed_dt_ns long, wcet_ns long, normalized_overrun double, trigger_seq long, effect_seq long, trigger_ts long"
STATE = "seq long, level int, ring array<struct<seq:bigint,node:bigint,ts:bigint>>"


def explain(ring: list[tuple[int, int, int]], m: Manifest) -> list[tuple]:
    """Ranked catalysts of the trip that is the ring's last entry (seq, node, ts); entries in order of arrival."""
    seq, node, ts = ring[-1]
    by_node: dict[int, list[tuple[int, int]]] = {}
    for s, n, t in ring:
        by_node.setdefault(n, []).append((s, t))
    visited, found = set(), []

    def visit(n, s, t):
        if n in visited:
            return
        visited.add(n)
        onward = []
        for _, e in m.incoming.get(n, []):
            hit = next(((a, b) for a, b in reversed(by_node.get(e.source, [])) if b < t), None)
            if hit is None:
                continue
            dt = max(0, t - hit[1])
            if dt > e.budget_ns:
                found.append(((float(dt) - float(e.budget_ns)) / float(e.budget_ns), e, dt, hit, s))
            onward.append((e.source, *hit))
        for x in reversed(onward):
            visit(*x)

    visit(node, seq, ts)
    found.sort(key=lambda x: -x[0])
    return [(r, e.source, e.target, dt, e.budget_ns, over, hit[0], effect, hit[1]) for r, (over, e, dt, hit, effect) in enumerate(found, 1)]


def detect(classified: DataFrame, m: Manifest, cap: int = CAP) -> DataFrame:
    """classified: a stream of capture_id (long), frame_no, node, ts, level. Rows of OUT; a trip without catalysts has rank 0."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, level, ring = state.get if state.exists else (0, -1, [])
        ring = [tuple(x) for x in ring]
        out = []
        rows = pd.concat(list(frames)).sort_values("frame_no", kind="stable")
        for node, ts, now in zip(rows["node"], rows["ts"], rows["level"], strict=True):
            ring.append((seq, int(node), int(ts)))
            if len(ring) > 2 * cap:
                ring = ring[-cap:]
            if node == m.trip_node and not pd.isna(now):
                if level == 1 and not now:
                    found = explain(ring[-cap:], m) or [(0, *[None] * 8)]
                    out += [(key[0], seq, int(ts), *f) for f in found]
                level = int(bool(now))
            seq += 1
        state.update((seq, level, [dict(zip(("seq", "node", "ts"), x, strict=True)) for x in ring[-cap:]]))
        names = [c.split()[0] for c in OUT.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names if n != "normalized_overrun"} | {"normalized_overrun": "float64"})

    return classified.groupBy("capture_id").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")
