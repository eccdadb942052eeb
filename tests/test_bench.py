"""bench.py prints one JSON line in the driver's format."""

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="4", BENCH_DRIVER_MEMORY="2g")
    proc = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        capture_output=True, text=True, timeout=900, env=env, cwd="/tmp",
    )
    assert proc.returncode == 0, proc.stderr[-2000:]
    lines = [line for line in proc.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["sf"] == 0.001 and isinstance(out["value"], float)
    assert {"top_companies", "survival_by_sector", "etl_gated_gold_load"} <= set(out["queries"])
    assert abs(sum(out["queries"].values()) - out["value"]) < 0.01
