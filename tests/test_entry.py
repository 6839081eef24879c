import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_oracle_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 40


def test_core_needs_no_llm_subpackage():
    root = Path(__file__).resolve().parent.parent
    for f in [*(root / "factloom").rglob("*.py")]:
        if "llm" not in f.relative_to(root).parts:
            assert "factloom.llm" not in f.read_text() and "factloom import llm" not in f.read_text()
    code = "import sys; sys.modules['factloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p7') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["src_table", "row_id", "field_name", "utc_ts"]
