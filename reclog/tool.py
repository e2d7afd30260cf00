"""Command line: scrub a store, make, verify and install snapshots, and collect what nobody reads."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.recovery import scrub
from .sources.store import RecordStore


def run(spark: SparkSession, args: list[str]) -> tuple[int, dict]:
    """Exit code and report of a command."""
    p = argparse.ArgumentParser(prog="reclog")
    p.add_argument("command", choices=("scrub", "snapshot", "verify-snapshot", "install-snapshot", "resume-install", "compact", "collect"))
    p.add_argument("root")
    p.add_argument("other", nargs="?", help="the snapshot's root")
    p.add_argument("--pin", type=int, action="append", default=[], help="a generation that readers hold")
    a = p.parse_args(args)
    store = RecordStore(spark, a.root)
    if a.command in ("snapshot", "install-snapshot") and not a.other:
        p.error("the snapshot's root is missing")
    if a.command == "scrub":
        faults = scrub(store.scan(), store.extents()).groupBy("fault").count().collect()  # five kinds at most
        report = {"generations": store.verify_chain(), "faults": {r["fault"]: r["count"] for r in faults}, "segments": store.verify().count()}
        return int(bool(report["faults"] or report["segments"])), report
    if a.command == "snapshot":
        return 0, {"last_entry_id": store.snapshot(a.other).manifest()["last_entry_id"]}
    if a.command == "verify-snapshot":
        n = store.verify().count()
        return int(n > 0), {"faults": n, "generations": store.verify_chain()}
    if a.command == "install-snapshot":
        return 0, {"generation": store.install(a.other)["generation"]}
    if a.command == "resume-install":
        return 0, {"generation": store.resume_install()["generation"]}
    if a.command == "compact":
        return 0, {"segments": len(store.compact()["segments"])}
    return 0, {"deleted": store.vacuum(a.pin)}


if __name__ == "__main__":
    import sys

    code, found = run(SparkSession.builder.getOrCreate(), sys.argv[1:])
    print(json.dumps(found))
    sys.exit(code)
