"""A read of files that change meanwhile is refused, whatever their number of rows."""

import os

import pytest

from goldseam.sources import tables
from goldseam.sources.tables import SourceChanged, consistent_read, file_list_print, trusted_read


def source(spark, folder, value="a", name="t"):
    path = str(folder / name)
    spark.range(40).selectExpr("id", f"'{value}' AS v").repartition(3).write.mode("overwrite").parquet(path)
    return path


def parts(path):
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet"))


def tampering(monkeypatch, change):
    """Runs ``change`` after the scans of the trusted read."""

    class Late:
        def __init__(self, found):
            self.found = found

        def first(self):
            row = self.found.first()
            change()
            return row

    monkeypatch.setattr(tables, "trusted_read", lambda *args: Late(trusted_read(*args)))


def test_unchanged_files_give_the_trusted_read(spark, tmp_path):
    df = spark.read.parquet(source(spark, tmp_path))
    assert consistent_read(df, "t", ["id"]) == trusted_read(df, "t", ["id"]).first()


@pytest.mark.parametrize("name", ["a b", "k=1", "x[1]{2}", "p%20q", "s*r"])
def test_paths_are_names(spark, tmp_path, name):
    path = source(spark, tmp_path, name="plain")
    odd = tmp_path / name
    os.rename(path, odd)
    df = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path))
    assert file_list_print(df)[0] == len(parts(odd)) == 3
    assert consistent_read(df, "t", ["id"]).row_count == 40


def test_a_replaced_file_with_as_many_rows(spark, tmp_path, monkeypatch):
    path, other = source(spark, tmp_path), source(spark, tmp_path, "b", "other")
    df = spark.read.parquet(path)
    tampering(monkeypatch, lambda: os.replace(parts(other)[0], parts(path)[0]))
    with pytest.raises(SourceChanged):
        consistent_read(df, "t", ["id"])


def test_a_touched_or_removed_file(spark, tmp_path, monkeypatch):
    path = source(spark, tmp_path)
    df = spark.read.parquet(path)
    tampering(monkeypatch, lambda: os.utime(parts(path)[0], (1, 1)))
    with pytest.raises(SourceChanged):
        consistent_read(df, "t", ["id"])
    tampering(monkeypatch, lambda: os.remove(parts(path)[0]))
    with pytest.raises(SourceChanged):
        consistent_read(df, "t", ["id"])


def test_sources_without_files(spark):
    df = spark.range(5).selectExpr("id", "'x' AS v")
    assert file_list_print(df) is None
    assert consistent_read(df, "t", ["id"]).row_count == 5
