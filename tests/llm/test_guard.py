"""The rest of the repository works without the training-data operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_entry_without_the_operators(tmp_path):
    for name in ("millrace", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'four_way' in q and not any(n.startswith('op') for n in q if n[2:3].isdigit()); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_has_every_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_nothing_else_imports_the_operators():
    for f in [*ROOT.glob("millrace/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
