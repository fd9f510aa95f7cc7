import ast
import importlib

from pathlib import Path

import pytest

import __spark_entry__ as entry_points

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark, sf):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no tables")
    df = entry_points.entry(spark)
    assert df.columns == ["doc_id"] and df.count() == 35


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_nothing_outside_imports_the_optional_folder():
    for path in (ROOT / "strandloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_queries_work_without_the_optional_folder(monkeypatch):
    gone = ("strandloom.llm", "corpus_pipeline")
    real = importlib.import_module

    def missing(name, *a):
        if name.startswith(gone):
            raise ModuleNotFoundError(f"No module named '{name}'", name=next(g for g in gone if name.startswith(g)))
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", missing)
    names = entry_points.queries()
    assert names and not any(n.startswith("op") or n == "pipeline" for n in names if n[:2] == "op" and n[2].isdigit())


def test_other_import_errors_are_raised(monkeypatch):
    def broken(name, *a):
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry_points.queries()
