"""Published table versions: whole states only, one writer a number."""

import pytest

from plumbline.sources.files import Conflict, PublishedTable


def values(df):
    return sorted(r.v for r in df.collect())


def test_states_follow_each_other(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "rates"))
    assert table.latest() == 0 and table.versions() == {}
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.createDataFrame([(1,), (2,)], "v int")) == 1
    assert table.replace(table.read().selectExpr("v * 10 AS v")) == 2  # from its own state
    assert values(table.read()) == [10, 20] and values(table.read(1)) == [1, 2]
    assert table.replace(spark.createDataFrame([], "v int")) == 3 and values(table.read()) == []
    table.drop_before(3)
    assert list(table.versions()) == [3] and table.latest() == 3
    table.drop_before(99)
    assert list(table.versions()) == [3]


def test_a_stop_between_stage_and_publish_changes_nothing(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "rates"))
    table.replace(spark.createDataFrame([(1,)], "v int"))
    staged = table.stage(spark.createDataFrame([(7,)], "v int"))
    assert values(table.read()) == [1] and table.latest() == 1
    again = PublishedTable(spark, str(tmp_path / "rates"))  # the retried job stages anew
    assert again.replace(spark.createDataFrame([(8,)], "v int")) == 2
    assert values(table.read()) == [8]
    with pytest.raises(Conflict):
        table.publish(staged, after=1)
    assert values(table.read()) == [8]


def test_a_job_that_fails_while_staging(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "rates"))
    table.replace(spark.createDataFrame([(1,)], "v int"))
    with pytest.raises(Exception):
        table.replace(spark.createDataFrame([(1,), (0,)], "v int").selectExpr("CASE WHEN v = 0 THEN raise_error('lost') ELSE v END AS v"))
    assert values(table.read()) == [1]


def test_only_one_writer_follows_a_version(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "rates"))
    staged = [table.stage(spark.createDataFrame([(i,)], "v int")) for i in range(3)]
    assert table.publish(staged[0], after=0) == 1
    for name in staged[1:]:
        with pytest.raises(Conflict):
            table.publish(name, after=0)
    assert table.versions() == {1: staged[0]}


def test_a_marker_whose_writer_was_lost(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "rates"))
    table.replace(spark.createDataFrame([(1,)], "v int"))
    (tmp_path / "rates" / "_markers" / "2").write_text("")
    assert table.latest() == 1 and values(table.read()) == [1]
    with pytest.raises(Conflict):
        table.replace(spark.createDataFrame([(5,)], "v int"), after=1)
    assert table.replace(spark.createDataFrame([(6,)], "v int")) == 3 and values(table.read()) == [6]
