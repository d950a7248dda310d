"""The entry point without the training-data subpackage, or without something that it needs."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
print(len([q for q in e.queries() if q.startswith("op") and q[2].isdigit()]), "pipeline" in e.queries(), "exact_dot" in e.queries(), set(e.oracle_sql()) <= set(e.queries()))
"""


def told(*names):
    return subprocess.run([sys.executable, "-c", CODE.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()


def test_what_cannot_be_imported_is_left_out():
    for name in ("quillon.llm", "quillon.llm.queries", "ahocorasick"):
        assert told(name) == ["0", "False", "True", "True"]
    assert told("corpus_pipeline")[1:] == ["False", "True", "True"]
