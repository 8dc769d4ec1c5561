import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_queries_and_sql_have_the_same_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 40


def test_without_the_optional_operators(tmp_path):
    for name in ("shelfmark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "shelfmark/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_them():
    for path in (ROOT / "shelfmark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "shelfmark").parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "row_id", "rank", "place", "group_size"] and out.count() > 0
