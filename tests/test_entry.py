import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


@pytest.mark.parametrize("gone", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_folders(tmp_path, gone):
    """What imports from a copy without the corpus operators, with and without the pipeline's own file."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *gone)
    shutil.copytree(TOP, tmp_path / "copy", ignore=skip)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, check=True)
    names, oracles = (line.split() for line in out.stdout.strip().split("\n"))
    assert len(names) >= 149 and set(oracles) <= set(names)
    assert not [n for n in names if n.startswith("op") or n == "pipeline"]
