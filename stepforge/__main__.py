"""python -m stepforge: lists queries, runs one, explains its plan, writes its rows, or checks a settings file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from stepforge.config import load_curricula
from stepforge.plans.catalog import oracle_sql, queries
from stepforge.session import ready
from stepforge.sources.jsonl import write_jsonl


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="stepforge", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    query = commands.add_parser("query", help="work with one query").add_subparsers(dest="action", required=True)
    for action, told in (("show", "print rows"), ("explain", "print the plan"), ("sql", "print the SQL that gives the same rows"), ("write", "write rows as line-JSON")):
        one = query.add_parser(action, help=told)
        one.add_argument("name", choices=sorted(queries()), metavar="name")
        if action != "sql":
            one.add_argument("data", help="folder of the tables")
        if action == "show":
            one.add_argument("--rows", type=int, default=20)
        if action == "write":
            one.add_argument("path")
    commands.add_parser("config", help="check a settings file").add_argument("path")
    return parser


def _rows(name: str, data: str) -> DataFrame:
    return queries()[name](ready(SparkSession.builder.appName("stepforge").getOrCreate()), data)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(queries())))
    elif args.command == "config":
        print(load_curricula(args.path))
    elif args.action == "sql":
        print(oracle_sql().get(args.name, "-- not expressible in SQL"))
    elif args.action == "show":
        _rows(args.name, args.data).show(args.rows, truncate=False)
    elif args.action == "explain":
        _rows(args.name, args.data).explain("formatted")
    else:
        print(f"{write_jsonl(_rows(args.name, args.data), args.path)} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
