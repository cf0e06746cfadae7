"""Functions that run in tasks must load where this package is not installed."""

import os
import subprocess
import sys

import pytest

import __spark_entry__  # noqa: F401  it has the package's functions travel by value
from lorespark.llm import periodic, repeats, simhash, treap, warc

LOAD = "import sys; sys.path = [p for p in sys.path if p not in ('', {root!r})]; import pickle; f = pickle.load(sys.stdin.buffer); f[0]; {more}"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TASKS = {
    "repeats": (lambda: (repeats._stretch_rows, repeats._string_rows, repeats._results), "import pandas as pd; print(len(list(f[0](iter([pd.DataFrame({'doc': [1, 2], 'mark': [1, 2], 'text': ['a b ' * 90] * 2})]), 100))))"),
    "periodic": (lambda: (periodic.find_runs,), "import numpy as np; print(len(f[0](np.zeros(9, int), np.array([0, 9]))))"),
    "treap": (lambda: (treap.build, treap.descend, treap.Grid), "import numpy as np; z = np.zeros(1, int); print(f[0](z, z, z + 5)[0])"),
    "warc": (lambda: (warc.read_records, warc._digest_rows), "import io; print(1 + len(list(f[0](io.BytesIO(b''), 'x'))))"),
    "simhash": (lambda: (simhash.fingerprint,), "print(f[0]('') + 1)"),
}


@pytest.mark.parametrize("name", sorted(TASKS))
def test_task_functions_load_without_the_package(name, tmp_path):
    from pyspark import cloudpickle

    functions, use = TASKS[name]
    code = LOAD.format(root=ROOT, more=use)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(functions()), capture_output=True, cwd=tmp_path, env=env, timeout=120)
    assert done.returncode == 0, done.stderr.decode()[-800:]
    assert int(done.stdout) == 1
