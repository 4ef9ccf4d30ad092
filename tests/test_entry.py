"""The driver's contract."""

import importlib

import __spark_entry__


def test_names():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_without_the_other_operators(monkeypatch):
    """The entry imports and keeps its own queries when the other subpackage is gone."""
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("trellis.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("trellis.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    e = importlib.reload(__spark_entry__)
    assert not any(k.startswith("op") for k in e.queries()) and "materialize_multi_map" in e.queries()
