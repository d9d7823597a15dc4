"""Commands over captures and manifests: `python -m tapquarry validate|preflight|discover|run`. They return 0, or 1 on failure.

A manifest with lints is valid. Reports are formatted here and nowhere else.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tapquarry.functions.expressions import format_duration
from tapquarry.operators import decode, discovery, evidence, manifest, preflight
from tapquarry.plans import attribution as A
from tapquarry.sources import pcap
from tapquarry.sources.store import DuplicateEvidence, EvidenceStore


def captures(spark: SparkSession, path: str, view: str = "frames"):
    pcap.register(spark)
    return spark.read.format("pcap").option("view", view).load(path)


def validate(_, args) -> None:
    m = manifest.validate(manifest.load(args.manifest))
    print(f"valid: {len(m.nodes)} nodes, {len(m.edges)} edges, trip node {m.trip_node}")
    for kind, *ids in manifest.lint(m):
        print(f"warning: {kind} {' '.join(map(str, ids))}")


def report_preflight(spark, args) -> None:
    decoded = decode.decode(captures(spark, args.captures))
    names = captures(spark, args.captures, "captures").select("capture_id", "format_error", "ended_mid_record")
    for r in preflight.facts(decoded, names).withColumn("span", format_duration(F.col("span_ns"))).orderBy("capture_id").toLocalIterator():
        print(f"{r['capture_id']}: {r['verdict']}, {r['classifiable']} of {r['total']} frames understood, {r['malformed']} malformed, {r['vlan_frames']} tagged, {r['truncated_frames']} cut by the tap, span {r['span']}")
    for r in preflight.ethertypes(decoded).collect():
        print(f"  type {r['ethertype']:#06x}: {r['n']}")


def report_discovery(spark, args) -> None:
    decoded = decode.decode(captures(spark, args.captures))
    shown = discovery.report(discovery.profile(decoded)).withColumns({c: F.when(F.col(c).isNotNull(), format_duration(F.col(c))) for c in ("gap_min", "gap_mean", "gap_max", *discovery.QUANTILES)})
    for r in shown.toLocalIterator():
        gaps = ", ".join(f"{n} {r[n]}" for n in ("gap_min", "gap_mean", "gap_max", *discovery.QUANTILES) if r[n] is not None)
        print(f"{r['capture_id']} {r['kind']} {r['stream_id']}: {r['frames']} frames, {gaps}" + (f", toggling {r['toggles']}" if r["n_toggles"] else ""))
    for r in discovery.rejected(decoded).collect():
        print(f"  not understood: {r['name']} ({r['status']}) {r['n']}")


def run(spark, args) -> None:
    m = manifest.validate(manifest.load(args.manifest))
    decoded = decode.decode(captures(spark, args.captures))
    t = A.transitions(A.classify(decoded, m)).persist()
    try:
        found = A.trips(t, m.trip_node)
        ranked = A.catalysts(A.candidates(t, found, m))
        rows = evidence.documents(found, ranked, t)
        EvidenceStore(spark, args.store).put(rows)
        n = decoded.agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("parse_error").isNull()).alias("parsed")).first()
        k = rows.agg(F.count(F.lit(1)).alias("trips"), F.count("root_from").alias("attributed")).first()
        print(f"frames {n['frames']}, parsed {n['parsed']}, dropped {n['frames'] - n['parsed']}, trips {k['trips']}, attributed {k['attributed']}, rows {k['trips']}")
        for r in rows.orderBy("trip_ts", "trace_id").select("trace_id", "finding", "root_from", "root_to", "root_overrun", "within_budget").toLocalIterator():
            root = f"{r['root_from']} -> {r['root_to']}, over by {r['root_overrun']:.3f} of its budget" if r["root_from"] is not None else "no budget exceeded"
            print(f"{r['trace_id']}: {r['finding']}, {root}, response {'within' if r['within_budget'] else 'outside'} its budget")
    finally:
        t.unpersist()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tapquarry")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, f, names in (("validate", validate, ["manifest"]), ("preflight", report_preflight, ["captures"]), ("discover", report_discovery, ["captures"]), ("run", run, ["captures", "manifest", "store"])):
        p = commands.add_parser(name)
        p.set_defaults(run=f)
        for n in names:
            p.add_argument(n)
    args = parser.parse_args(argv)
    spark = None if args.command == "validate" else SparkSession.builder.getOrCreate()
    try:
        args.run(spark, args)
    except (manifest.ManifestError, pcap.CaptureError, DuplicateEvidence, FileNotFoundError, PySparkException) as e:
        print(f"failed: {e}".splitlines()[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
