"""Landed lines of few values are dealt out over tasks."""

from pathlib import Path

from reliefspark.plans.source_queries import _landed_lines


def test_a_value_is_written_by_several_tasks(spark):
    rows = spark.range(1000).selectExpr("concat('line ', id) as value", "id % 2 as vintage")
    folder = _landed_lines(spark, rows, "vintage", spread=True)
    for vintage in (0, 1):
        assert len(list(Path(folder.removeprefix("file://"), f"vintage={vintage}").glob("part-*"))) > 1
    assert spark.read.text(folder).filter("value like 'line %'").count() == 1000
