import pytest
from conftest import rows

from panelwright.sources.commits import SharedTable


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n int").schema
    return SharedTable(spark, str(tmp_path / "shared"), schema, ["k"])


def batch(spark, *keys, n):
    return spark.createDataFrame([(k, n) for k in keys], "k string, n int")


def test_empty_table_reads_as_no_rows(table):
    assert table.versions() == {} and rows(table.read()) == []


def test_two_interleaved_appends(spark, table):
    one, other = table.stage(batch(spark, "a", "b", n=1), "one"), table.stage(batch(spark, "b", "c", None, n=2), "other")
    assert rows(table.read()) == []                                            # staged rows are not in the table
    assert table.commit(other) == 1 and table.commit(one) == 2
    assert rows(table.read()) == [("a", 1), ("b", 2), ("c", 2), (None, 2)]     # the second writer's b was there already
    assert table.versions() == {1: "other", 2: "one"}


def test_a_batch_is_in_the_table_once(spark, table):
    assert table.append(batch(spark, "a", n=1), "day/1") == 1
    assert table.append(batch(spark, "a", "z", n=9), "day/1") == 1             # the same batch again
    first = table.stage(batch(spark, "b", n=1), "two")
    retry = table.stage(batch(spark, "b", n=1), "two")                         # a second attempt while the first still runs
    assert table.commit(first) == 2 and table.commit(retry) == 2
    assert rows(table.read()) == [("a", 1), ("b", 1)]


def test_writer_that_loses_the_rename_tries_the_next_version(spark, table, monkeypatch):
    """Another writer publishes between the look at the versions and the rename."""
    mine, theirs = table.stage(batch(spark, "a", "b", n=1), "mine"), table.stage(batch(spark, "b", "c", n=2), "theirs")
    publish, calls = table._publish, []

    def late(folder, version):
        if not calls:
            calls.append(version)
            assert publish(theirs.folder, version)
        return publish(folder, version)

    monkeypatch.setattr(table, "_publish", late)
    assert table.commit(mine) == 2 and calls == [1]
    assert rows(table.read()) == [("a", 1), ("b", 2), ("c", 2)]


def test_snapshot_keys_and_extra_columns(spark, table):
    data = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, None, "x"), (2, None, "y")], "n int, k string, _known_0 string")
    table.append(data, "one")
    snapshot = table.read()
    table.append(batch(spark, "a", None, "b", n=3), "two")
    table.append(batch(spark, n=0), "nothing")
    assert rows(snapshot) == [("a", 1), (None, 2)]
    assert rows(table.read()) == [("a", 1), ("b", 3), (None, 2)] and len(table.versions()) == 3
