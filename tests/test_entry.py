import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_stands_without_the_training_operators(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    for f in root.glob("objsql/**/*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op1') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
