"""The entry works without the optional subpackage."""

import sys

import pytest

import __spark_entry__


@pytest.mark.parametrize("gone", ["corpus_pipeline", "ledgerline.llm", "ledgerline.llm.queries"])
def test_queries_without_the_subpackage(monkeypatch, gone):
    for name in [m for m in sys.modules if m.startswith(("ledgerline.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    assert __spark_entry__._added() == ({}, {})
    assert "j1_status_snapshot" in __spark_entry__.queries()
    assert not [k for k in __spark_entry__.oracle_sql() if k.startswith("op")]


def test_other_missing_modules_are_not_hidden(monkeypatch):
    if not __spark_entry__._added()[0]:
        pytest.skip("the subpackage is not there")
    for name in [m for m in sys.modules if m.startswith(("ledgerline.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._added()
