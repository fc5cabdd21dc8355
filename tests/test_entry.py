"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as registered

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_query_has_rows(spark):
    df = registered.entry(spark)
    assert df.columns == ["lang", "grade", "n"] and df.count() > 0


def test_sql_is_of_registered_queries():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_without_the_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "catalogkit", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "catalogkit").mkdir()
    for p in (ROOT / "catalogkit").iterdir():
        if p.name != "llm":
            (tmp_path / "catalogkit" / p.name).symlink_to(p)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    # a copy of the entry, since a link would be followed to the folder that has the subpackage
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_entry_names_what_it_cannot_import():
    # a missing module of the library or of what the subpackage needs is an error and leaves no query out
    for missing in ("catalogkit.plans.registry", "pyarrow"):
        code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules[{missing!r}] = None; import __spark_entry__"
        run = subprocess.run([sys.executable, "-B", "-c", code], capture_output=True, text=True)
        assert run.returncode and missing in run.stderr


def test_library_does_not_import_the_subpackage():
    for p in (ROOT / "catalogkit").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
