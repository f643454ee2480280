import os

import pytest

from cradlemart.llm.language import identify

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in identify(docs).collect() if r.held_out]
    assert len(held) > 200
    right = sum(truth[r.id] == r.lang_pred for r in held) / len(held)
    assert right > 0.95, right


def test_odd_input(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 20)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "12 :: 34", "fr", "x"), (103, "É", None, "x"), (None, "the mat", None, "x"), (1, "the cat", None, "x"), (104, "the cat " * 40_000, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(d).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert by[104].lang_pred == "en" and by[None].lang_pred == "en" and by[103].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(none).collect()] == ["und"]
    assert identify(none.limit(0)).count() == 0
