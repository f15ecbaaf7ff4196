"""Queries beside their SQL twins on tables with values that the small tables do not hold."""

import shutil

import duckdb
import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture
def agrees(spark, tmp_path):
    def check(name, **changes):
        """``changes``: a SELECT per table, over ``old``, that replaces it."""
        folder = tmp_path / "tables"
        shutil.copytree(SF, folder)
        folder.chmod(0o755)
        for table, select in changes.items():
            (folder / f"{table}.parquet").unlink()
            duckdb.sql(f"copy (with old as (select * from '{SF}/{table}.parquet') {select}) to '{folder}/{table}.parquet' (format parquet)")
        ok, text = oracle.compare(spark, oracle.connect(folder), name, entry.queries()[name], entry.oracle_sql()[name], str(folder))
        assert ok, text

    return check


@pytest.mark.parametrize("name", ["tile_answer_class", "publish_gate"])
def test_body_lengths_are_rounded(agrees, name):
    agrees(name, events="select * replace (24.98 as value) from old")


def test_tile_keys_of_five_digits_stay_whole(agrees):
    agrees("source_geojson_index", orders="select * replace (o_custkey + 500000 as o_custkey) from old")
