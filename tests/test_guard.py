"""Without the corpus operators the rest still imports and lists its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 50 and out[0] == out[1] and out[2] == "False"


def test_nothing_else_imports_llm():
    for p in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
