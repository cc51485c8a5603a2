"""The optional operators may be gone as a whole; a broken import in them must not be hidden."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


def copy(to, *without):
    shutil.copytree(ROOT, to, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", *without)])
    return to


def asked(at):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=at, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)


def test_without_the_optional_operators(tmp_path):
    out = asked(copy(tmp_path / "a", "llm", "corpus_pipeline.py"))
    assert out.returncode == 0, out.stderr
    n, some, known = out.stdout.split()
    assert int(n) > 80 and some == "False" and known == "True"


def test_nothing_else_imports_them():
    for path in [*(ROOT / "marlspike").rglob("*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.parts and path.name != "test_entry.py":
            assert "marlspike.llm" not in path.read_text()


def test_broken_imports_show(tmp_path):
    if not (ROOT / "marlspike/llm").exists():
        return
    at = copy(tmp_path / "b")
    (at / "marlspike/llm/registry.py").write_text("import no_such_module\n")
    assert "no_such_module" in asked(at).stderr
