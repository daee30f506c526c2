"""Findings as JSON lines."""

from __future__ import annotations

import json
import sys
from datetime import UTC, datetime
from typing import TextIO

from pyspark.sql import DataFrame

from tickloom.plans.engine import run_id, summary


def envelopes(findings: DataFrame, request: dict):
    """run_start, one dict a finding in a fixed order, sweep_summary and run_end. Rows come to the driver one partition
    at a time."""
    run, started = run_id(), datetime.now(UTC)
    yield {"kind": "run_start", "run_id": run, "produced_at_utc": started.isoformat(), "request": request}
    order = [c for c in ("scan", "instruments", "job", "segment", "start_ms", "extra") if c in findings.columns]
    for r in findings.orderBy(*order).toLocalIterator():
        d = {k: v for k, v in r.asDict(True).items() if v is not None}
        if "extra" in d:
            d["extra"] = json.loads(d["extra"])
        yield d | {"run_id": run}
    if "p_value" in findings.columns:
        for r in summary(findings).orderBy("scan").toLocalIterator():
            yield {"kind": "sweep_summary", "run_id": run} | r.asDict()
    yield {"kind": "run_end", "run_id": run, "wall_clock_s": (datetime.now(UTC) - started).total_seconds()}


def write_lines(rows, out: TextIO = sys.stdout) -> int:
    """One JSON line each, flushed; returns how many were scan errors."""
    errors = 0
    for r in rows:
        errors += r.get("kind") == "scan_error"
        out.write(json.dumps(r, sort_keys=True, allow_nan=False, default=str) + "\n")
        out.flush()
    return errors


def write_table(findings: DataFrame, path: str) -> None:
    """Findings as JSON files, written by the tasks."""
    findings.write.mode("overwrite").json(path)
