"""What a Python worker holds while it tokenizes."""

import os
import subprocess
import sys

import pytest

ONE_THREAD = """
import os, sys
import pyarrow as pa
from loglens.llm import {op} as op
encode = op.encoder(op.vocabulary())
before = len(os.listdir("/proc/self/task"))
encode(pa.array([" ".join(f"w{{i}}x{{i * 7}}" for i in range(3000))]))
sys.exit(len(os.listdir("/proc/self/task")) - before)
"""


@pytest.mark.parametrize("op", ["op6", "op12"])
@pytest.mark.skipif(not os.path.isdir("/proc/self/task"), reason="threads are counted in /proc")
def test_encoding_starts_no_threads(op):
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    assert subprocess.run([sys.executable, "-c", ONE_THREAD.format(op=op)], env=env, timeout=120).returncode == 0


def test_few_encodings_are_held_at_once(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    from loglens.llm import op6

    encode, seen = op6.Encoder(op6.vocabulary()), []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            seen.append(len(texts))
            return real.encode_batch_fast(texts, **more)

    real = encode.model
    encode.model = Counted()
    text = " ".join(f"{i}a" for i in range(9000))
    cut, ids = encode(pa.array([text]))
    assert ids.tolist() == [*real.encode(text, add_special_tokens=False).ids, op6.END] and max(seen) <= 4000


def test_near_duplicates_stop_when_no_list_is_left(spark, monkeypatch):
    from loglens.llm import op4

    calls, real = [], op4.components
    monkeypatch.setattr(op4, "components", lambda edges: calls.append(1) or real(edges))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "nothing of the kind is said in here"), (4, " ".join(words))]
    found = {r[0]: r[2] for r in op4.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 1} and len(calls) == 1
