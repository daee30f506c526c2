"""python -m tickloom.cli scan|sweep|scans: the command line. Exit codes: 0 done, 1 refused before it ran, 2 scan errors, 130 stopped."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tomllib

from tickloom.model import Invalid, ScanRequest, instrument, parse_params, window
from tickloom.plans import engine
from tickloom.plans.registry import catalogue


def config(args: argparse.Namespace) -> dict:
    """root (day files) and output: arguments, then environment (TICKLOOM_*), then the TOML file."""
    doc = {}
    if args.config:
        with open(args.config, "rb") as f:
            doc = tomllib.load(f)
    out = {k: getattr(args, k, None) or os.environ.get(f"TICKLOOM_{k.upper()}") or doc.get(k) for k in ("root", "output")}
    if not out["root"]:
        raise Invalid("missing_required_config", "no root of day files: --root, TICKLOOM_ROOT or the configuration file")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickloom")
    p.add_argument("--config")
    p.add_argument("--root")
    p.add_argument("--output")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("scan")
    s.add_argument("--instrument", action="append", required=True)
    s.add_argument("--timeframe", required=True)
    s.add_argument("--window", required=True)
    s.add_argument("--gap-policy", default="continuous_only")
    s.add_argument("--params", action="append", default=[])
    s.add_argument("--dry-run", action="store_true")
    w = sub.add_parser("sweep")
    w.add_argument("manifest")
    for q in (s, w):
        q.add_argument("--bootstrap")
        q.add_argument("--bootstrap-n", type=int, default=0)
        q.add_argument("--null")
        q.add_argument("--null-n", type=int, default=0)
        q.add_argument("--seed", type=int)
    sub.add_parser("scans")
    return p


def minutes(spark, root: str, jobs: list[ScanRequest]):
    from tickloom.sources.dayfiles import read_minutes

    out = None
    who = {i for j in jobs for i in j.instruments}
    start, end = min(j.window[0] for j in jobs), max(j.window[1] for j in jobs)
    for symbol, side in sorted(map(instrument, who)):
        bars, _ = read_minutes(spark, root, symbol, side, start, end)
        out = bars if out is None else out.unionByName(bars)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "scans":
            for row in catalogue():
                print(json.dumps(row, sort_keys=True, default=str))
            return 0
        where = config(args)
        if args.command == "scan":
            job = ScanRequest(args.scan, tuple(args.instrument), args.timeframe, window(args.window), args.gap_policy, parse_params(args.params), args.bootstrap, args.bootstrap_n or 1000, args.null, args.null_n or 1000, args.seed or 0, args.dry_run)
            engine.preflight(job)
            sweep = engine.Sweep([job], "none")
        else:
            with open(args.manifest, encoding="utf-8") as f:
                sweep = engine.parse_sweep(f.read(), args.seed, args.bootstrap, args.bootstrap_n, args.null, args.null_n)
        if not sweep.jobs:
            raise Invalid("invalid_config", "the manifest has no jobs")
    except Invalid as e:
        print(json.dumps({"code": e.code, "message": str(e)}), file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from tickloom.sources.findings import envelopes, write_lines

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found = engine.run_sweep(minutes(spark, where["root"], sweep.jobs), sweep)
        rows = envelopes(found, {"jobs": len(sweep.jobs), "command": args.command})
        if where["output"]:
            with open(where["output"], "w", encoding="utf-8") as f:
                return 2 if write_lines(rows, f) else 0
        return 2 if write_lines(rows) else 0
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
