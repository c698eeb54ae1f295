"""The training-data queries join in only while they are there; a mistake in them is not hidden."""

import builtins
import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def entry():
    spec = importlib.util.spec_from_file_location("entry_under_test", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def failing(monkeypatch, name, error):
    real = builtins.__import__

    def load(module, *args, **kw):
        if module == name:
            raise error
        return real(module, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", load)


def test_queries_without_the_folders(entry, monkeypatch):
    failing(monkeypatch, "corpus_pipeline", ModuleNotFoundError("no pipeline", name="corpus_pipeline"))
    assert len(entry.queries()) >= 170 and not any(k.startswith("op") for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_a_library(entry, monkeypatch):
    failing(monkeypatch, "corpus_pipeline", ModuleNotFoundError("no library", name="zstandard"))
    assert not any(k.startswith("op") for k in entry.queries())


@pytest.mark.parametrize("error", [ModuleNotFoundError("misspelt", name="riverlens.operators.nothing"), ImportError("no such name", name="riverlens.llm.common")])
def test_mistakes_are_raised(entry, monkeypatch, error):
    if not os.path.exists(os.path.join(ROOT, "riverlens", "llm", "__init__.py")):
        pytest.skip("the subpackage is not there")
    failing(monkeypatch, "corpus_pipeline", error)
    with pytest.raises(ImportError):
        entry.queries()
