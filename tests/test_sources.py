"""Formats and tables beyond the named queries."""

import pytest
from pyspark.sql import functions as F

from trackloom.session import checkpoint_folder
from trackloom.sources import files, tables, text, tracks


def test_delimited_nested_values(spark, tmp_path):
    (tmp_path / "in.txt").write_text("line1|k1:v1,k2:v2|a,b,c|one,two\n\\N|\\N||x\nshort\n")
    got = text.read_delimited(
        spark, str(tmp_path / "in.txt"),
        "str string, mp map<string,string>, lst array<string>, strct struct<a:string,b:string>", "|", ",", ":").collect()
    assert got[0]["mp"] == {"k1": "v1", "k2": "v2"} and got[0]["lst"] == ["a", "b", "c"]
    assert (got[0]["strct"]["a"], got[0]["strct"]["b"]) == ("one", "two")
    assert got[1]["str"] is None and got[1]["mp"] is None and got[1]["strct"]["b"] is None
    assert got[2]["str"] == "short" and got[2]["lst"] is None


def test_delimited_round_trip_with_nulls(spark, tmp_path):
    df = spark.sql("SELECT 1 AS i, CAST(NULL AS STRING) AS s, array(1, 2) AS a, named_struct('x', 1.5D, 'y', 'q') AS st, "
                   "CAST('bytes' AS BINARY) AS b UNION ALL SELECT NULL, 't', NULL, NULL, NULL")
    text.write_delimited(df, str(tmp_path / "out"))
    back = text.read_delimited(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_regex_lines_that_do_not_match_are_null(spark, tmp_path):
    (tmp_path / "log.txt").write_text('127.0.0.1 - "GET /a" 200\nbroken\n')
    got = text.read_regex(spark, str(tmp_path / "log.txt"), r'^(\S+) (\S+) "(.*)" (\d+)$',
                          ["host", "identity", "request", "status"]).collect()
    assert tuple(got[0]) == ("127.0.0.1", "-", "GET /a", "200")
    assert tuple(got[1]) == (None, None, None, None)


def test_access_log(spark, tmp_path):
    line = ('owner bucket [06/May/2026:00:00:00 +0000] 10.0.0.1 req id REST.GET.OBJECT key "GET /k HTTP/1.1" '
            '200 - 10 20 30 40 "ref" "agent"')
    (tmp_path / "log").write_text(line + "\n")
    row = text.read_access_log(spark, str(tmp_path / "log")).first()
    assert (row["bucketowner"], row["operation"], row["httpstatus"], row["useragent"]) == (
        "owner", "REST.GET.OBJECT", "200", "agent")


def test_json_values(spark, tmp_path):
    df = spark.sql("SELECT 1 AS i, array('a', 'b') AS a, CAST(NULL AS STRING) AS s")
    text.write_json_values(df, str(tmp_path / "j"), "|")
    assert spark.read.text(str(tmp_path / "j")).first()["value"] == '1|["a","b"]|\\N'


def test_multi_insert_branches(spark, tmp_path):
    out = tables.multi_insert(spark.range(100), str(tmp_path / "m"), {
        "small": (F.col("id") < 10, [F.col("id")]),
        "even": (F.col("id") % 2 == 0, [F.col("id")])})
    assert out["small"].count() == 10 and out["even"].count() == 50


def test_compact_and_binary(spark, tmp_path):
    spark.range(100).repartition(10).write.parquet(str(tmp_path / "many"))
    files.compact(spark, str(tmp_path / "many"), str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 100
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    assert files.read_binary(spark, str(tmp_path / "one" / "*.parquet")).select("length").count() == 1


class _Session:
    """Just the settings a session shows."""

    def __init__(self, master, **settings):
        self.conf, self.sparkContext, self.master = self, self, master
        self.settings, self.folder = settings, None

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_checkpoint_folder():
    named = _Session("yarn", **{"spark.checkpoint.dir": "/shared/checkpoints"})
    assert checkpoint_folder(named) == "/shared/checkpoints" == named.folder
    with pytest.raises(ValueError):
        checkpoint_folder(_Session("yarn"))
    local = _Session("local[2]")
    assert checkpoint_folder(local) == local.folder == checkpoint_folder(local)


def test_interval_files(spark, tmp_path):
    (tmp_path / "a.narrowPeak").write_text("chr1\t9\t20\tp1\t500\t+\t3.5\t1.0\t-1\t4\n")
    row = tracks.read_narrow_peaks(spark, str(tmp_path / "a.narrowPeak")).first()
    assert (row["chr"], row["chrstart"], row["chrend"], row["value"], row["name"]) == ("chr1", 10, 20, 3.5, "p1")
    (tmp_path / "a.gtf").write_text(
        '#header\nchr1\tX\tgene\t10\t20\t.\t+\t.\tgene_type "protein_coding"; level 2;\n')
    row = tracks.read_annotation(spark, str(tmp_path / "a.gtf")).first()
    assert row["feature"] == "gene" and 'gene_type "protein_coding"' in row["attributes"]
    (tmp_path / "sizes").write_text("chrS\t355\n")
    assert tuple(tracks.read_chromosome_sizes(spark, str(tmp_path / "sizes")).first()) == ("chrS", 355)


def test_special_characters_need_an_escape(spark, tmp_path):
    import pytest

    odd = spark.createDataFrame([("a\tb\n\\c\\\\nd\r�",), ("\\N",), (None,), ("",)], "v string")
    with pytest.raises(Exception, match="escape"):
        text.write_delimited(odd, str(tmp_path / "bad"), fields="\t")
    text.write_delimited(odd, str(tmp_path / "good"), fields="\t", escape="\\")
    back = text.read_delimited(spark, str(tmp_path / "good"), odd.schema, fields="\t", escape="\\")
    assert sorted(map(str, back.collect())) == sorted(map(str, odd.collect()))


def test_sizes_come_from_the_listing(spark, tmp_path, folder):
    import os

    from trackloom.sources.files import table_bytes

    path = f"{folder}/orders.parquet"
    assert table_bytes(spark.read.parquet(path)) == os.path.getsize(path)
    assert table_bytes(spark.range(3)) == 0
