"""Runs bench.py at 1, 2 and 4 local cores and prints one JSON line per run.

    python scripts/bench_scaling.py [sf_dir]
"""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    for cpus in (1, 2, 4):
        env = dict(os.environ, BENCH_SF_DIR=sf_dir, BENCH_CPUS=str(cpus), BENCH_REPEAT="1")
        out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                             capture_output=True, text=True, timeout=3600)
        lines = [line for line in out.stdout.splitlines() if line.startswith("{")]
        print(lines[-1] if lines else f'{{"cpus": {cpus}, "error": {out.returncode}}}', flush=True)


if __name__ == "__main__":
    main()
