"""Command line: list the registered queries or run one.

    python -m quire list
    python -m quire run <query> [--data DIR] [--out PATH] [--show N] [--explain]

``run`` writes the result as Parquet when ``--out`` is given (the full
result, written by the executors), otherwise shows the first N rows.
"""

from __future__ import annotations

import argparse

from quire.plans.catalog import ORACLE, QUERIES
from quire.session import build_session


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="quire")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("--data", default="/root/testdata/sf0.01")
    run.add_argument("--out")
    run.add_argument("--show", type=int, default=20)
    run.add_argument("--explain", action="store_true")
    run.add_argument("--master", default="local[*]")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        for name in sorted(QUERIES):
            print(f"{name}{'' if name in ORACLE else '  (no SQL twin)'}")
        return
    spark = build_session(args.master)
    df = QUERIES[args.query](spark, args.data)
    if args.explain:
        df.explain("formatted")
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
        print(f"wrote {args.out}")
    else:
        df.show(args.show, truncate=80)
    spark.stop()


if __name__ == "__main__":
    main()
