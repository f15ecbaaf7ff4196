"""The entry without the parts that can be left out; each case in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

HIDE = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
print(len(entry.queries()), *sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"))
"""


@pytest.mark.parametrize("hidden", [["reliefspark.llm"], ["reliefspark.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_entry_imports_without(hidden):
    said = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    number, *names = said.stdout.split()
    assert int(number) > 150 and "pipeline" not in names and ("reliefspark.llm" not in hidden or not names)
