"""Show the answer to one or more questions.

    python -m shopfloor --csv tests/fixtures/edition_a q01_serviced_customers q47
    python -m shopfloor --warehouse /root/testdata/sf0.01 q27 --rows 10
    python -m shopfloor --warehouse /root/testdata/sf0.01 q47 --explain
    python -m shopfloor --list

A question may be given by its full key or any unique prefix (``q47``).
"""

from __future__ import annotations

import argparse
import sys

from shopfloor.plans.catalog import ALL, plan


def _resolve(name: str) -> str:
    if name in ALL:
        return name
    hits = [k for k in ALL if k.startswith(name)]
    if len(hits) != 1:
        raise SystemExit(f"unknown or ambiguous question {name!r}: {hits[:5]}")
    return hits[0]


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m shopfloor")
    src = ap.add_mutually_exclusive_group()
    src.add_argument("--csv", help="folder with the six workshop CSV files")
    src.add_argument("--parquet", help="folder with the six roles as Parquet folders")
    src.add_argument("--warehouse", help="folder with the warehouse tables")
    ap.add_argument("--rows", type=int, default=20)
    ap.add_argument("--explain", action="store_true", help="print the formatted physical plan instead of rows")
    ap.add_argument("--list", action="store_true", help="list question keys")
    ap.add_argument("questions", nargs="*")
    args = ap.parse_args(argv)
    if args.list:
        print("\n".join(ALL))
        return 0
    if not args.questions or not (args.csv or args.parquet or args.warehouse):
        ap.error("give a source and at least one question")

    from shopfloor.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.csv:
        from shopfloor.sources.workshop_csv import read_workshop_csv
        roles, warehouse = read_workshop_csv(spark, args.csv), False
    elif args.parquet:
        from shopfloor.sources.role_store import read_roles
        roles, warehouse = read_roles(spark, args.parquet), False
    else:
        from shopfloor.sources.warehouse import warehouse_roles
        roles, warehouse = warehouse_roles(spark, args.warehouse), True
    for name in map(_resolve, args.questions):
        print(f"== {name}: {(ALL[name].__doc__ or '').strip().splitlines()[0]}")
        df = plan(name, roles, warehouse=warehouse)
        if args.explain:
            df.explain("formatted")
        else:
            df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
