import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """With only the two folders deleted, and with the pipeline gone as well, the core imports; and its
    tests pass (one module of them is run here)."""
    for more in ((), ("corpus_pipeline.py",)):
        repo = tmp_path / f"repo{len(more)}"
        shutil.copytree(ROOT, repo, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *more))
        code = "import __spark_entry__ as e; q = e.queries(); assert 'q1_pricing_summary' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
        subprocess.run([sys.executable, "-c", code], cwd=repo, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_script.py"], cwd=tmp_path / "repo0", check=True, timeout=600)


def test_missing_packages_leave_the_core(tmp_path):
    code = "import sys; sys.modules['numpy'] = None; sys.modules['pyarrow'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q1_pricing_summary' in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_them():
    for path in (ROOT / "slatewing").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "slatewing.llm" not in path.read_text()
