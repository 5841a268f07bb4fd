"""The library works without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_subpackage(tmp_path):
    shutil.copytree(f"{REPO}/corpusops", tmp_path / "corpusops", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_top5' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    """Only the entry and the pipeline name it, so the tests beside tests/llm pass without it."""
    for folder, _, names in os.walk(REPO):
        inside = os.path.relpath(folder, REPO)
        if inside.startswith((".git", "corpusops/llm", "tests/llm")):
            continue
        for name in names:
            if name.endswith(".py") and (inside, name) not in {(".", "__spark_entry__.py"), (".", "corpus_pipeline.py"), ("tests", "test_guard.py")}:
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    assert "corpusops.llm" not in file.read(), name


def test_a_broken_subpackage_is_not_taken_for_an_absent_one(tmp_path):
    shutil.copytree(f"{REPO}/corpusops", tmp_path / "corpusops", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpusops/llm").mkdir()
    (tmp_path / "corpusops/llm/__init__.py").write_text("")
    (tmp_path / "corpusops/llm/queries.py").write_text("import no_such_wheel\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, timeout=120)
    assert done.returncode and b"no_such_wheel" in done.stderr
