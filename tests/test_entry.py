"""The driver contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"


def asked(root: Path) -> tuple[int, int, str]:
    out = subprocess.run([sys.executable, "-c", ASK], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1]), out[2]


def test_queries_without_the_subpackage(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    bare = asked(root)
    assert bare[0] >= 70 and bare[2] == "False"
    (root / "pricewell" / "llm" / "__pycache__").mkdir(parents=True)
    assert asked(root) == bare
