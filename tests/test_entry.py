import importlib
import sys

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("spantrack.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "spantrack.llm", None)
    names = importlib.reload(entry).queries()
    assert "p1_found" in names and "p8_ids" not in names
