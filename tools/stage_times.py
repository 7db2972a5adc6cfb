"""Print the slowest stages recorded in a Spark event log folder (uncompressed logs)."""

import glob
import json
import os
import sys


def main(folder: str, top: int = 15) -> None:
    stages = {}
    for f in sorted(glob.glob(os.path.join(folder, "**", "*events*"), recursive=True)) + \
            sorted(glob.glob(os.path.join(folder, "local-*"))):
        if os.path.isdir(f):
            continue
        for line in open(f, encoding="utf-8", errors="replace"):
            try:
                e = json.loads(line)
            except json.JSONDecodeError:
                continue
            if e.get("Event") == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                d = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
                stages[si["Stage ID"]] = (d, si["Number of Tasks"], si["Stage Name"][:100])
    for _, (d, n, name) in sorted(stages.items(), key=lambda x: -x[1][0])[:top]:
        print(f"{d:7.2f}s tasks={n:6d} {name}")
    print(f"{len(stages)} stages, {sum(v[0] for v in stages.values()):.1f}s in stages")


if __name__ == "__main__":
    main(sys.argv[1])
