"""The registry can be read without a session, and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tidemark.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
"""


def names(block: str) -> set[str]:
    code = block + "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.splitlines()
    assert set(out[1].split()) <= set(out[0].split())
    return set(out[0].split())


def test_without_subpackage():
    got = names(BLOCK)
    assert len(got) >= 100 and not any(n.startswith("op") or n == "pipeline" for n in got)


def test_registry_reads():
    assert names(BLOCK) <= names("")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
