import numpy as np
import pytest

from trackloom.llm import language
from trackloom.llm.language import codewords, held_out, identify_language
from trackloom.llm.queries import QUERIES
from tests.llm import rows


@pytest.mark.parametrize("classes", [2, 3, 4, 5, 9, 20])
def test_codewords_are_far_apart(classes):
    code = codewords(classes).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2 + 99 * np.eye(classes, dtype=int)
    assert apart.min() >= (code.shape[1] // 4 if classes > 5 else 2 ** (classes - 2))
    assert all(len(set(bit)) == 2 for bit in code.T)
    assert codewords(1).shape == (1, 1)


def test_decoding_repairs_a_wrong_bit():
    code = codewords(4)
    model = language.Model(list("abcd"), code, None, None)
    for k in range(4):
        margins = 3.0 * code[k].astype(float)
        margins[k] *= -0.8
        best, score = model.decode(margins[None])
        assert best[0] == k and 0 < score[0] <= 1
    _, score = model.decode(np.zeros((1, code.shape[1])))
    assert score[0] == pytest.approx(0.25)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op9_language_codes"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows_ = got.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows_) > 100 and np.mean([r.lang == r.lang_pred for r in rows_]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows_)


def test_held_out_rows_teach_nothing(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    got = [identify_language(d, d.filter(~held_out("doc_id"))).orderBy("doc_id").collect() for d in (docs, wrong)]
    assert got[0] == got[1]


def test_cases(spark):
    frame = rows.documents(spark)
    got = {r.doc_id: r for r in identify_language(frame).collect()}
    assert identify_language(frame).count() == frame.count()
    assert got[1].lang_pred == "en" and got[4].lang_pred == got[5].lang_pred == "de"
    for k in (6, 7, 8, 10):
        assert (got[k].lang_pred, got[k].score, got[k].ambiguous) == ("und", 0.0, True)
    assert identify_language(rows.empty(spark)).collect() == []
    unlabelled = frame.drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    assert {r.lang_pred for r in identify_language(unlabelled).collect()} == {"und"}
