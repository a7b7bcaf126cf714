"""python -m recordspark.cli COMMAND --source DIR --warehouse DIR: info, ingest, transform, unify, dq, evaluate, pipeline."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from recordspark.operators import evaluation as E
from recordspark.operators import quality as Q
from recordspark.ops import ingest as I
from recordspark.ops import models as M
from recordspark.ops import runner as R
from recordspark.session import local_session


def _evaluate(ctx: R.Context, out: str | None) -> None:
    """The clusters made here against the given crosswalk, for records that both know."""
    truth = ctx.read("fan_xref").select(F.concat_ws(":", "source_system", "source_record_id").alias("ref"), F.col("fan_id").alias("entity"))
    found = ctx.table("identity.clusters").select("ref", F.col("root").alias("cluster"))
    row = E.pair_metrics(found.join(truth, "ref")).first().asDict()
    print(row)
    if out:
        R.report_json(f"{out}.json", [row])
        R.report_markdown(f"{out}.md", "Linkage accuracy", [row])


def _gate(ctx: R.Context) -> None:
    results = Q.run_checks(M.checks(ctx))
    for name, severity, n, some in results:
        print(f"{severity} {name}: {n}" + (f" e.g. {some[0]}" if some else ""))
        R.audit(ctx, "check", name, "violated" if n else "passed", n, None, "; ".join(some) or None)
    Q.gate(results)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="recordspark", description=__doc__)
    p.add_argument("command", choices=["info", "ingest", "transform", "unify", "dq", "evaluate", "pipeline"])
    p.add_argument("--source", default="/root/testdata/sf0.01")
    p.add_argument("--warehouse", default="warehouse")
    p.add_argument("--mode", choices=["deterministic", "full"], default="full")
    p.add_argument("--select", nargs="*")
    p.add_argument("--report")
    p.add_argument("--drop-zone")
    p.add_argument("--months", nargs=2, metavar=("FIRST", "LAST"), default=(None, None))
    p.add_argument("--force", action="store_true")
    args = p.parse_args(argv)
    if args.command == "info":
        for k, v in R.masked({"source": args.source, "warehouse": args.warehouse, **{k: v for k, v in os.environ.items() if k.startswith("RECORDSPARK_")}}).items():
            print(f"{k}: {v}")
        return 0
    ctx = R.Context(local_session(), args.source, os.path.abspath(args.warehouse))
    models = M.models(args.mode)
    if args.command == "ingest":
        for source, good, bad in I.ingest(ctx, args.drop_zone or args.source, args.select, *args.months, force=args.force):
            print(f"{source}: {good} accepted, {bad} rejected")
    elif args.command == "transform":
        try:
            done = R.run(ctx, models, select=args.select)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        print(*(f"{n}: {rows} rows, {s:.1f} s" for n, rows, s in done), sep="\n")
    elif args.command == "unify":
        R.run(ctx, models, layers=["identity"])
    elif args.command == "dq":
        _gate(ctx)
    elif args.command == "evaluate":
        _evaluate(ctx, args.report)
    else:
        R.run(ctx, models)
        _gate(ctx)
    return 0


if __name__ == "__main__":
    sys.exit(main())
