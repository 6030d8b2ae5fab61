"""The entry module with and without the subpackage of text operators."""

from pathlib import Path
import shutil
import subprocess
import sys

ROOT = Path(__file__).resolve().parents[1]


def names(folder: Path) -> set[str]:
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return set(out.stdout.split())


def test_entry_imports_without_the_subpackage(tmp_path):
    kept = {"whole": (), "no_llm": ("llm",), "no_pipeline": ("llm", "corpus_pipeline.py")}
    found = {}
    for name, left_out in kept.items():
        shutil.copytree(ROOT, tmp_path / name, ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out))
        found[name] = names(tmp_path / name)
    assert found["no_llm"] == found["no_pipeline"] == {n for n in found["whole"] if not n.startswith("op") and n != "pipeline"}
    if (ROOT / "loreloom" / "llm").exists():
        assert "pipeline" in found["whole"]
