"""Python workers live on beside the JVM of their executor: what a task takes at most, and what it leaves behind."""

import json
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from twinsift.llm import near_dup

MB = 1 << 20


class Plan:
    """Stands for a DataFrame: gives back the function that workers would run."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def batch(rows: int, size: int, seed: int = 3) -> pa.RecordBatch:
    """id, text, row, text_hash."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60_000, size // 7).tolist()) for _ in range(rows)]
    ids = pa.array(range(rows), pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), ids, ids], names=["id", "text", "row", "text_hash"])


def peak_mb(run, given) -> float:
    tracemalloc.start()
    try:
        for _ in run(iter([given])):
            pass
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_signing_a_large_batch_takes_no_more_than_a_small_one():
    run = near_dup._signed(Plan(), 0.8)
    peak_mb(run, batch(4, 4000))
    small, large = peak_mb(run, batch(500, 2000)), peak_mb(run, batch(6000, 2000))
    assert large < 1.7 * small + 20, (small, large)


LEFT = """
import json, re, sys
import numpy as np, pyarrow as pa
from pathlib import Path
from tests.llm.test_worker_memory import Plan, batch
from twinsift.llm import near_dup

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

run, given = near_dup._signed(Plan(), 0.8), batch(2000, 2000)
for _ in run(iter([batch(4, 4000)])):
    pass
before = held()
for _ in run(iter([given])):
    pass
print(json.dumps([before, held()]))
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_memory_back_when_a_task_ends():
    found = subprocess.run([sys.executable, "-c", LEFT], capture_output=True, text=True, check=True, timeout=120, cwd=Path(__file__).parents[2])
    before, after = json.loads(found.stdout.splitlines()[-1])
    assert after < before + 30, (before, after)


def test_slices_keep_all_rows_in_order():
    from twinsift.llm.common import slices

    texts = ["", None, "é" * 40, "a" * 500, "", "b", None, "c" * 99, "d", "e"]
    given = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts, pa.string())], names=["id", "text"])
    parts = list(slices(given, 1, 100))
    assert [r for p in parts for r in p.to_pylist()] == given.to_pylist()
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100 for p in parts)
    assert list(slices(given.slice(0, 0), 1)) == []
    assert [r for p in slices(given.slice(3, 4), 1, 1) for r in p.to_pylist()] == given.slice(3, 4).to_pylist()


def test_signatures_do_not_depend_on_slices():
    given = batch(300, 900)
    run = near_dup._signed(Plan(), 0.8)
    whole = [r for b in run(iter([given])) for r in b.to_pylist()]
    cut = [r for k in range(0, 300, 7) for b in run(iter([given.slice(k, min(7, 300 - k))])) for r in b.to_pylist()]
    assert whole == cut and len(whole) == 300
