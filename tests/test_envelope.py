"""Envelopes of boxes from arrays are those of the column expression."""

import pytest
from pyspark.sql import functions as F

from reliefspark.functions import arrays, geo


def test_envelope_of_arrays(spark):
    rows = spark.createDataFrame([(1, 5.5, 43.0), (2, -2.0, 48.5), (3, None, 44.0)], "i int, x double, y double")
    box = geo.bbox("x", "y", F.col("x") + 2.0, F.col("y") + 1.0)
    out = rows.select("i", arrays.transform_envelope(box, arrays.lambert93).alias("got"), geo.bbox_transform_envelope(box, geo.lambert93_from_lonlat).alias("want"))
    for r in out.filter("i < 3").collect():
        assert list(r.got) == pytest.approx(list(r.want), abs=1e-6)
    assert out.filter("i = 3").first().got.x0 is None
