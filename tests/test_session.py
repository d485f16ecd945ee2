from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

import __spark_entry__ as entry
from tidemark import session


def test_materialized_tables_can_be_cleared(spark):
    df = session.materialize(spark.range(5), "five")
    at = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 5 and at.exists() and at.parent == Path(session.shared_folder(spark).removeprefix("file://"))
    session.clear(spark)
    assert not at.exists()


@pytest.mark.parametrize(("master", "fails"), [("local", False), ("local[8]", False), ("local[*]", False), ("local-cluster[3,2,1024]", True), ("spark://a:7077", True), ("yarn", True)])
def test_a_cluster_needs_a_shared_folder(master, fails):
    conf = {}
    fake = SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=conf.get))
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake)
    else:
        assert session.shared_folder(fake) == session.shared_folder(fake) and session.shared_folder(fake).startswith("file:")
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert session.shared_folder(fake) == "hdfs://x/y"


def test_only_a_missing_subpackage_is_left_out(monkeypatch):
    real = __import__

    def lacks(name):
        def imported(module, *a, **k):
            if module == "tidemark.llm":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(module, *a, **k)

        return imported

    everything = set(entry.queries())
    monkeypatch.setattr("builtins.__import__", lacks("tidemark.llm"))
    assert set(entry.queries()) < everything or not any(q.startswith("p8_") for q in everything)
    monkeypatch.setattr("builtins.__import__", lacks("regex"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
