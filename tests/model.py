"""Attribution by its definition, to hold the plans against.

A node's instance belongs to the least of its paths from the trip, where a path is the list of the negated places
of the edges taken (an edge's place counts those declared before it into the same node), and leads only over
nodes' own instances. An edge's trigger is the source's latest entry, by arrival, that is strictly earlier in time.
"""

from graphlib import TopologicalSorter


def walk(ring, edges, trip_node):
    """ring: (seq, node, ts) in order of arrival, the trip last. edges: (from, to, budget). Ranked (from, to, dt, trigger, effect)."""
    places = [sum(e[1] == target for e in edges[:i]) for i, (_, target, _) in enumerate(edges)]
    feeds = {n: {e[1] for e in edges if e[0] == n} for e in edges for n in e[:2]}
    instance, evaluated = {trip_node: ((), ring[-1][0], ring[-1][2])}, []
    for node in TopologicalSorter(feeds).static_order():  # what a node feeds comes first
        paths = []
        for (source, target, _), place in zip(edges, places, strict=True):
            if source == node and target in instance:
                path, _, at = instance[target]
                earlier = [(seq, ts) for seq, n, ts in ring if n == source and ts < at]
                if earlier:
                    paths.append((path + (-place,), *max(earlier)))
        if paths and node != trip_node:
            instance[node] = min(paths)
    for (source, target, budget), place in zip(edges, places, strict=True):
        if target in instance:
            path, effect, at = instance[target]
            earlier = [(seq, ts) for seq, n, ts in ring if n == source and ts < at]
            if earlier:
                trigger, ts = max(earlier)
                evaluated.append(((budget - (at - ts)) / budget, path, place, source, target, at - ts, trigger, effect))
    return [x[3:] for x in sorted(evaluated) if x[0] < 0]
