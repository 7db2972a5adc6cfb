"""Summarise the physical plan of every registered query (writes PLANS.md).

Per query: shuffles (Exchange), broadcasts, sort-merge joins, Python stages
and the columns each Parquet scan reads. Plans are AQE's initial plans at the
given scale; at larger scale AQE may turn a broadcast into a shuffle join.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans.catalog import QUERIES  # noqa: E402
from quire.session import build_session  # noqa: E402

SKIP = {"read_uploads", "incremental_ingest"}  # these write files when called


def summarise(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning|"
                                   r"Exchange RoundRobinPartitioning", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "python": plan.count("MapInPandas") + plan.count("MapInArrow"),
        "scans": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))),
    }


def main(root: str = "/root/testdata/sf0.1") -> None:
    spark = build_session("local[8]", 8)
    lines = ["# Physical plans of the registered queries", "",
             f"Initial (AQE) plans at `{root}`; produced by `tools/plan_report.py`. `shuffles` counts exchanges",
             "(hash, range, single-partition). Broadcasts are of sides whose size is known or measured small.",
             "", "| query | shuffles | broadcasts | sort-merge joins | Python stages | columns read |",
             "|---|---|---|---|---|---|"]
    for name in sorted(QUERIES):
        if name in SKIP:
            continue
        plan = QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        cols = "; ".join(x.replace("struct<", "").replace(">", "").replace(":bigint", "").replace(":string", "")
                         .replace(":timestamp", "").replace(":double", "") for x in s["scans"])
        lines.append(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['python']} | {cols} |")
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(f"wrote {out}")


if __name__ == "__main__":
    main(*sys.argv[1:])
