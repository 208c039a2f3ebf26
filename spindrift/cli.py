"""Command line: ``python -m spindrift.cli list | columns PATH | contract PATH | gate TEXT | query NAME DIR | eval PATH TEXT``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from spindrift.catalog import load
from spindrift.operators.gates import cost_report, typed_gate
from spindrift.plans.compiler import evaluate
from spindrift.plans.expr import OPERATORS, canonical, fields, max_window, parse
from spindrift.session import build_session
from spindrift.sources.panels import data_contract, panel_columns, prepare_panel, read_panel


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="spindrift")
    parser.add_argument("--master", help="a Spark master; the default of the environment if absent")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="operators of the formula language and named queries")
    for name, what in (("columns", "a panel's columns"), ("contract", "what a panel lacks")):
        commands.add_parser(name, help=what).add_argument("path")
    commands.add_parser("gate", help="the verdict on a formula").add_argument("text")
    query = commands.add_parser("query", help="run a named query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--out", help="write the result there as Parquet instead of showing it")
    run = commands.add_parser("eval", help="evaluate a formula over a panel")
    run.add_argument("path")
    run.add_argument("text")
    run.add_argument("--out", help="write the signal there as Parquet instead of showing it")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "list":
        print(json.dumps({"operators": sorted(OPERATORS), "queries": sorted(load().queries)}, indent=1))
        return 0
    spark = build_session("spindrift-cli", args.master)
    if args.command == "columns":
        print("\n".join(panel_columns(spark, args.path)))
    elif args.command == "contract":
        found = data_contract(spark, args.path)
        print(json.dumps(found))
        return 0 if found["can_start"] else 2
    elif args.command == "gate":
        tree = parse(args.text)
        table = spark.createDataFrame([(args.text,)], "expression string")
        verdict = cost_report(typed_gate(table)).first().asDict()
        print(json.dumps(verdict | {"canonical": canonical(args.text), "fields": fields(tree), "max_window": max_window(tree)}))
        return 0 if verdict["typed_gate_decision"] == "allow" else 2
    else:
        if args.command == "query":
            out = load().queries[args.name](spark, args.folder.rstrip("/"))
        else:
            panel = prepare_panel(read_panel(spark, args.path))
            out = evaluate(panel, {"signal": args.text}).where(F.col("signal").isNotNull())
        if args.out:
            out.write.mode("overwrite").option("compression", "zstd").parquet(args.out)
        else:
            out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
