"""Stored indexes of many projects."""

import pytest

from srcloom.sources import store

ROWS = "project_id long, file_path string, code string"


def _named(spark, ids):
    return spark.createDataFrame([(p, f"/{p}") for p in ids], "project_id long, repo_path string")


def _edges(units):
    return units.selectExpr("project_id", "file_path as source_file", "code as import_statement")


def test_files_do_not_grow_with_the_projects(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_FOLDERS", 100)
    units = spark.range(300).selectExpr("id as project_id", "'a' as file_path", "'x' as code").coalesce(2)
    named = units.selectExpr("project_id", "concat('/', project_id) as repo_path")
    store.replace_index(str(tmp_path / "index"), named, units, _edges(units))
    assert len(list((tmp_path / "index").rglob("*.parquet"))) < 60
    assert store.read_index(spark, str(tmp_path / "index"), units.schema, _edges(units).schema)["units"].count() == 300


def test_a_replacement_that_fails_leaves_the_old_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_FOLDERS", 0)
    folder = str(tmp_path / "index")
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], ROWS)
    store.replace_index(folder, _named(spark, [1, 2]), old, _edges(old))
    new = spark.createDataFrame([(1, "c", "z")], ROWS)
    with pytest.raises(Exception, match="no edges"):
        store.replace_index(folder, _named(spark, [1]), new, _edges(new).selectExpr("project_id", "source_file", "raise_error('no edges') as import_statement"))
    read = lambda: store.read_index(spark, folder, old.schema, _edges(old).schema)
    assert sorted(tuple(r) for r in read()["units"].select("project_id", "file_path", "code").collect()) == [(1, "a", "x"), (2, "b", "y")]
    store.replace_index(folder, _named(spark, [1]), new, _edges(new))
    assert sorted(tuple(r) for r in read()["units"].select("project_id", "file_path", "code").collect()) == [(1, "c", "z"), (2, "b", "y")]
    assert sorted(r.import_statement for r in read()["edges"].collect()) == ["y", "z"]
    # A few projects are replaced in folders of their own, beside those that came together.
    monkeypatch.setattr(store, "MOST_FOLDERS", 1)
    last = spark.createDataFrame([(2, "d", "w")], ROWS)
    store.replace_index(folder, _named(spark, [2]), last, _edges(last))
    assert sorted(tuple(r) for r in read()["units"].select("project_id", "file_path", "code").collect()) == [(1, "c", "z"), (2, "d", "w")]
    assert sorted(r.import_statement for r in read()["edges"].collect()) == ["w", "z"]
