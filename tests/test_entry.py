"""The entry file with and without the text operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in ({blocked}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__
print(*sorted(__spark_entry__.queries()))
"""


def names(*blocked):
    code = CODE.format(blocked=",".join([*map(repr, blocked), "''"]))
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    return set(done.stdout.split())


def test_entry_without_text_operators():
    from cohortspark.catalog import QUERIES

    assert names("cohortspark.llm", "corpus_pipeline") == set(QUERIES)
    assert names("cohortspark.llm") == set(QUERIES)
    assert set(QUERIES) <= names()
