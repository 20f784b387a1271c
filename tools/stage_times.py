"""Summarise stage / job wall times from a Spark event log (zstd or plain).

Usage: python tools/stage_times.py <event-log-file> [last_n_jobs]
"""

from __future__ import annotations

import io
import json
import sys


def read_lines(path: str):
    if path.endswith(".zstd") or path.endswith(".zst"):
        import zstandard
        with open(path, "rb") as fh:
            data = zstandard.ZstdDecompressor().stream_reader(fh).read()
        return io.StringIO(data.decode()).readlines()
    return open(path).readlines()


def main() -> None:
    path = sys.argv[1]
    last = int(sys.argv[2]) if len(sys.argv) > 2 else 0
    stages, jobs = {}, {}
    for line in read_lines(path):
        e = json.loads(line)
        ev = e["Event"]
        if ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Stage Name"][:60], si["Number of Tasks"],
                                      si["Completion Time"] - si["Submission Time"])
        elif ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None, e["Stage IDs"]]
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
    ids = sorted(jobs)[-last:] if last else sorted(jobs)
    sel = [jobs[i] for i in ids]
    print("jobs", len(ids), "wall", (max(j[1] for j in sel) - min(j[0] for j in sel)) / 1000, "s")
    st = [s for j in sel for s in j[2] if s in stages]
    for sid, (name, ntask, ms) in sorted(((s, stages[s]) for s in st), key=lambda x: -x[1][2])[:12]:
        print(f"stage {sid:4d} {ms / 1000:6.2f}s tasks={ntask:4d} {name}")


if __name__ == "__main__":
    main()
