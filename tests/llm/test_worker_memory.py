"""What a worker holds after a task; each case is a process of its own."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
CASE = r"""
import random, re, sys
from pathlib import Path
from types import SimpleNamespace
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from skyquilt.llm import decontaminate as D

def held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

rng = random.Random(5)
words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5_000)]
texts = [" ".join(rng.choices(words, k=350)) for _ in range(2_000)]  # about 4.5 MB
items = [("a", " ".join(texts[7].split()[:10]))]
docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda f, schema: f)
scan = D.search(docs, items, 10)
batch = pa.record_batch({"row_id": pa.nulls(2_000, pa.int64()), "doc_id": pa.array(range(2_000)), "text": pa.array(texts)})
list(scan(iter([batch.slice(0, 1)])))
before = held()
hits = [row["doc_id"] for out in scan(iter([batch])) for row in out.to_pylist() if row["items"]]
assert hits == [7], hits
print(held() - before)
"""


def test_a_worker_gives_memory_back():
    """With pieces of 4 MB a search left 128 MB of tables and most of its arrays."""
    done = subprocess.run([sys.executable, "-c", CASE, str(REPO)], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 60
