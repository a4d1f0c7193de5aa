"""One Arrow batch of 10,000 texts of 2 KB stays far below what an executor's worker may take."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SETUP = """
import random, resource
import numpy as np, pyarrow as pa
from pavement.llm import passages, windows
draw = random.Random(1)
words = ["".join(draw.choice("aeiounrst") for _ in range(draw.randrange(2, 9))) for _ in range(3000)]
N = 10_000
texts = pa.array([" ".join(draw.choice(words) + (". " if draw.random() < .08 else "") for _ in range(330)) for _ in range(N)])
def lists(per, **columns):
    return windows.struct_lists([per] * N, [(k, np.tile(np.asarray(v), N)) for k, v in columns.items()])
"""
_BATCHES = {
    "cut": "work = lambda: passages._cut(texts)",
    "sets": "work = lambda: passages._sets(texts)",
    # every window of every text is asked for
    "hashes": """
n = pa.array([[0]] * N, pa.list_(pa.int32())), pa.array([[280]] * N, pa.list_(pa.int32()))
work = lambda: windows._hashes(texts, *n)""",
    # all pieces of all documents are repeats
    "runs": """
k = np.arange(30, dtype=np.int32)
units = lists(30, start=k * 60, end=k * 60 + 59, n=np.full(30, 11, np.int32))
marks = lists(30, seq=k, first_id=np.arange(30), first=k % 2 == 0)
wide = lists(3, begin=k[:3] * 100, stop=k[:3] * 100 + 60, start=k[:3] * 600, end=k[:3] * 600 + 360)
ids = pa.array([[1, 2, 3]] * N, pa.list_(pa.int64()))
work = lambda: passages._runs(units, marks, wide, ids)""",
}


@pytest.mark.parametrize("name", _BATCHES)
def test_batch(name):
    code = _SETUP + _BATCHES[name] + """
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(work()) == N
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    print(name, done.stdout)
    assert int(done.stdout) < 250
