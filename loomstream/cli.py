"""python -m loomstream.cli: read logs from a node, cut a window, build the models, check them."""

from __future__ import annotations

import argparse
import json
import os
import time
from pathlib import Path

from loomstream.operators import experiments, findings
from loomstream.operators.quality import all_passed, run_checks
from loomstream.operators.reconcile import reconcile_all
from loomstream.plans.warehouse import MODELS, Warehouse
from loomstream.session import build_session
from loomstream.sources.adapters import TOKEN, read_transfers
from loomstream.sources.ingest import Source, ingest
from loomstream.sources.segments import Manifest, extract_window, find_manifest
from loomstream.sources.synthetic import SyntheticConfig, synthetic_transfers


def fetch(spark, args) -> int:
    """Transfers of a block range, stored by segment with a manifest; goes on where an earlier run stopped."""
    source = Source(args.url, args.chain_id, args.network, args.token, args.topic, args.decimals, args.chunk_blocks, args.wait)
    print(ingest(spark, source, args.out, args.start, args.end, segment_blocks=args.segment_blocks, progress=print))
    return 0


def window(spark, args) -> int:
    """The rows of a block range out of verified segments."""
    print(extract_window(spark, args.folder, Manifest.load(find_manifest(args.folder, args.manifest)), args.start, args.end, args.out))
    return 0


def transform(spark, args) -> int:
    """Every model as Parquet below --out."""
    house = Warehouse(read_transfers(spark, *args.paths), dedup=not args.disjoint, share=True)
    for name in MODELS:
        getattr(house, name).write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
        print(name)
    return 0


def validate(spark, args) -> int:
    """Checks and reconciliations; 1 if one fails."""
    raw = read_transfers(spark, *args.paths)
    house = Warehouse(raw, share=True)
    checks = run_checks(house.stg_transfers, raw, args.token)
    for check in checks:
        print(check)
    mismatches = reconcile_all(raw, house)
    for name, n in mismatches.items():
        print(f"{name}: {n} mismatches")
    return int(not all_passed(checks) or any(mismatches.values()))


def analyze(spark, args) -> int:
    """Every summary of the models of the given transfers, on the screen and with --json as sorted JSON."""
    house = Warehouse(read_transfers(spark, *args.paths), dedup=not args.disjoint, share=True)
    found = findings.findings(house)
    for name, rows in found.items():
        print(f"\n== {name} ==")
        for row in rows:
            print("  " + ", ".join(f"{k}: {v}" for k, v in row.items()))
    if args.json:
        findings.save(found, args.json)
    return 0


def experiment(spark, args) -> int:
    """A synthetic experiment and all tests of it; never run on observed events."""
    report = experiments.experiment_report(experiments.generate_scenario(spark, args.scenario))
    print(json.dumps(findings.plain(report), indent=2))
    return 0


def demo(spark, args) -> int:
    """Synthetic transfers, their models, checks and summaries below --out; seconds of each step in steps.json."""
    raw, seconds = f"{args.out.rstrip('/')}/raw", {}
    steps = {
        "generate": lambda: synthetic_transfers(spark, SyntheticConfig(n_days=args.days)).write.mode("overwrite").parquet(raw) or 0,
        "transform": lambda: main(["transform", raw, "--out", f"{args.out}/models"]),
        "validate": lambda: main(["validate", raw, "--token", TOKEN]),
        "analyze": lambda: main(["analyze", raw, "--json", f"{args.out}/findings.json"]),
        "experiment": lambda: main(["experiment"]),
    }
    for name, step in steps.items():
        began = time.perf_counter()
        if step():
            return 1
        seconds[name] = round(time.perf_counter() - began, 3)
    Path(args.out, "steps.json").write_text(json.dumps(seconds, indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomstream")
    top.add_argument("--master")
    commands = top.add_subparsers(required=True)

    def command(run, *, paths: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__, help=run.__doc__)
        p.set_defaults(run=run)
        if paths:
            p.add_argument("paths", nargs="+")
        return p

    p = command(fetch)
    p.add_argument("--url", default=os.environ.get("LOOMSTREAM_RPC_URL"), required="LOOMSTREAM_RPC_URL" not in os.environ)
    for name in ("--token", "--topic", "--network", "--out"):
        p.add_argument(name, required=True)
    for name in ("--start", "--end", "--chain-id"):
        p.add_argument(name, type=int, required=True)
    p.add_argument("--wait", type=float, default=1.0)
    for name, value in (("--decimals", 6), ("--segment-blocks", 2000), ("--chunk-blocks", 500)):
        p.add_argument(name, type=int, default=value)
    p = command(window)
    p.add_argument("folder")
    p.add_argument("--manifest")
    p.add_argument("--start", type=int, required=True)
    p.add_argument("--end", type=int, required=True)
    p.add_argument("--out", required=True)
    p = command(transform, paths=True)
    p.add_argument("--out", required=True)
    p.add_argument("--disjoint", action="store_true", help="events are known to be unique; a repeated one is an error")
    p = command(validate, paths=True)
    p.add_argument("--token", required=True)
    p = command(analyze, paths=True)
    p.add_argument("--json")
    p.add_argument("--disjoint", action="store_true")
    p = command(experiment)
    p.add_argument("--scenario", default="positive_effect", choices=sorted(experiments.SCENARIOS))
    p = command(demo)
    p.add_argument("--out", required=True)
    p.add_argument("--days", type=int, default=SyntheticConfig.n_days)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(build_session("loomstream", args.master), args)


if __name__ == "__main__":
    raise SystemExit(main())
