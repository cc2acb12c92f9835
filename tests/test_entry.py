"""The driver's contract, with and without the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__ as entry
from densefold import queries

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("densefold.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) == set(e.queries())
"""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["blob_id", "col_no", "nd", "nrows", "plain_bytes", "dict_bytes", "enc"] and df.count() > 0


def test_names():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_a_broken_import_inside_is_seen():
    """Only the absence of the subpackage itself is taken for granted."""
    code = WITHOUT.replace('("densefold.llm", "corpus_pipeline")', '("xxhash",)').split("assert e.queries")[0]
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert os.path.isdir(os.path.join(ROOT, "densefold", "llm")) == (done.returncode != 0 and "xxhash" in done.stderr)
