"""The driver's contract, with the optional parts and without them."""

import importlib.abc
import sys

import __spark_entry__ as entry


class Absent(importlib.abc.MetaPathFinder):
    """Makes the optional parts look deleted."""

    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "tessera.llm") or name.startswith("tessera.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["n_name", "y", "revenue", "place"] and df.count() > 0


def test_queries_have_oracles():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in oracles.values())


def test_the_rest_stands_alone(spark, monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n == "tessera.llm" or n.startswith("tessera.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    import tessera

    monkeypatch.delattr(tessera, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    names = entry.queries()
    assert "pipeline" not in names and not any(n.startswith("op") for n in names)
    assert names["agg_count"](spark, "/root/testdata/sf0.001").count() == 1
