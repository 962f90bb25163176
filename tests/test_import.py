import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 60


def test_nothing_else_imports_the_operators_for_training_data():
    for f in (ROOT / "quillstone").rglob("*.py"):
        if "llm" not in f.parts:
            assert "quillstone.llm" not in f.read_text() and "from .llm" not in f.read_text()
