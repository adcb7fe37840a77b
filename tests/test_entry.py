import subprocess
import sys
from pathlib import Path

import pytest

BLOCK = """
import sys, warnings
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {gone!r} or name in {gone!r}:
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Block())
warnings.simplefilter("ignore")
import __spark_entry__ as e
print(sum(not q.startswith("op") and q != "pipeline" for q in e.queries()), len(e.queries()), sorted(e.oracle_sql()) == sorted(q for q in e.queries() if q in e.oracle_sql()))
"""


@pytest.mark.parametrize("gone", [("siltlog.llm", "corpus_pipeline"), ("corpus_pipeline",), ("xxhash", "public_tokenizers")])
def test_the_entry_does_without(gone):
    run = subprocess.run([sys.executable, "-c", BLOCK.format(gone=gone)], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    core, all_, same = run.stdout.split()
    assert core == all_ and int(core) >= 82 and same == "True", run.stderr


def test_nothing_else_imports_the_training_text_package():
    top = Path(__file__).parent.parent / "siltlog"
    for path in top.rglob("*.py"):
        if "llm" not in path.relative_to(top).parts:
            assert "siltlog.llm" not in path.read_text(), path
