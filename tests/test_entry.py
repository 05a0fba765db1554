"""The driver's entry with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
GONE = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith('arborea.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert 'audit_report' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q
assert set(e.oracle_sql()) <= set(q)
"""


def test_entry_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", GONE], cwd=REPO, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "check_id", "status", "n"]
