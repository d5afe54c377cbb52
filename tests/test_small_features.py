"""Cases of small features that the named queries do not reach."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import sampling
from trackloom.sources import files, text


def test_limit_with_a_minimum(spark):
    assert sampling.limit_at_least(spark.range(100), 7, 100).count() == 7
    assert sampling.limit_at_least(spark.range(0), 7, 0).count() == 0
    for rows in (0, 9):
        with pytest.raises(Exception, match="fewer than 10 rows"):
            sampling.limit_at_least(spark.range(rows), 7, 10).collect()


def test_sequence_files_with_nulls_in_any_column(spark, tmp_path):
    rows = [("a", None), (None, "x"), (None, None), ("", "")]
    source = spark.createDataFrame(rows, "k string, v string").coalesce(1)
    files.write_sequence(source, "k", "v", str(tmp_path / "some"))
    assert set(map(tuple, files.read_sequence(spark, str(tmp_path / "some")).collect())) == set(rows)
    files.write_sequence(source.withColumn("v", F.lit(None)), "v", "v", str(tmp_path / "none"))
    assert set(map(tuple, files.read_sequence(spark, str(tmp_path / "none")).collect())) == {(None, None)}


def test_typed_access_log_with_missing_counts(spark, tmp_path):
    line = 'o b [t] 10.0.0.1 - id REST.GET.OBJECT k "GET /k HTTP/1.1" 404 NoSuchKey - - 12 - "-" "agent"'
    (tmp_path / "log").write_text(line + "\nbroken\n")
    found = text.read_access_log(spark, str(tmp_path / "log"), typed=True)
    assert dict(found.dtypes)["totaltime"] == "bigint"
    columns = ["httpstatus", "errorcode", "bytessent", "objsize", "totaltime", "turnaroundtime"]
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert set(got) == {(404, "NoSuchKey", None, None, 12, None), (None,) * 6}
