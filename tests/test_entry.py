"""The entry works with and without the subpackage for training data."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])


def names(block: str) -> set[str]:
    code = f"import sys; sys.path.insert(0, {ROOT!r}); {block}\nimport __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True).stdout
    return set(out.partition("NAMES")[2].split())


def test_without_llm():
    gone = "import importlib.util as u; real = u.find_spec; u.find_spec = lambda name, package=None: None if name == 'latticework.llm' else real(name, package)"
    left = names(gone)
    assert "where_all_of" in left and "code_findings" in left and "pipeline" not in left
    assert not any(n.startswith("op1") for n in left)


@pytest.mark.skipif(not Path(ROOT, "latticework", "llm").is_dir(), reason="the subpackage is gone")
def test_a_broken_operator_is_no_missing_one():
    """Where the folder is there, an import that fails isn't passed over."""
    with pytest.raises(subprocess.CalledProcessError):
        names("sys.modules['latticework.llm.queries'] = None")


def test_a_copy_without_them(tmp_path):
    """Without the operators' two folders and the pipeline, the entry and all other tests can be imported."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, files: {f for f in files if f in ("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")})
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    found = run("-c", "import __spark_entry__ as e; print('NAMES', *e.queries())")
    assert "code_findings" in found.stdout and "op1_" not in found.stdout and "pipeline" not in found.stdout.partition("NAMES")[2], found.stderr
    collected = run("-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert collected.returncode == 0 and "test_wrong_answers" in collected.stdout, collected.stdout


def test_nothing_else_imports_llm():
    for p in Path(ROOT, "latticework").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "latticework.llm" not in p.read_text(), p


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "l_quantity", "evidence"] and df.count() >= 0
