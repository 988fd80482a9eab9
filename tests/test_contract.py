from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_needs_the_training_data_operators(tmp_path):
    """With that subpackage away, the entry still imports and has the other queries."""
    code = "import sys; sys.modules['barline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [k for k in q if k.startswith('op') and k[2].isdigit() or k == 'pipeline'], q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for f in (ROOT / "barline").rglob("*.py"):
        if "llm" not in f.parts:
            assert "barline.llm" not in f.read_text()
