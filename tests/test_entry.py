"""The engine without its optional subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_subpackage(tmp_path):
    shutil.copytree(f"{REPO}/galeframe", tmp_path / "galeframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_quantile_block' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for d, _, names in os.walk(f"{REPO}/galeframe"):
        if "llm" not in d.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(d, n)) as f:
                        assert "galeframe.llm" not in f.read(), n
