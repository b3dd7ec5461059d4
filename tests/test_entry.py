"""The driver contract."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    got = entry.entry(spark)
    assert got.columns == ["q_id", "fraud_n", "fraud_score", "approved"] and got.count() > 0


def test_the_rest_works_without_the_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("quintet.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quintet.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    assert "pipeline" not in again.queries() and "q1_knn_vote" in again.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_a_missing_library_is_an_error(monkeypatch):
    if not entry.llm()[0]:
        pytest.skip("the subpackage is not installed")
    for name in [n for n in sys.modules if n.startswith("quintet.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.raises(ImportError, match="zstandard"):
        entry.queries()


def test_nothing_outside_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for path in (root / "quintet").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quintet.llm" not in path.read_text(), path
