"""Columns of any name stay as they are, the operators' own inner names too."""

from pyspark.sql import functions as F

from tallyfold.llm import language_id, weighted_near_dup

ROWS = [(1, "the cat sat on the mat and the dog", "en", "a.b"), (2, "der Hund und die Katze sind hier", "de", "a.b"), (3, "the cat sat on the mat and the dog", "en", "c"), (4, None, None, None)]


def framed(spark, **more):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({k: F.lit(v) for k, v in more.items()})


def test_language_id(spark):
    df = framed(spark, __host="mine", __declared="too", __scores=1, __vote=2, __h=3, c0="x")
    model = language_id.fit_text_model(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "text", "lang")
    for keep in (True, False):
        got = language_id.with_language(df, model, keep_text=keep)
        names = [c for c in df.columns if keep or c != "text"]
        assert got.columns == [*names, "language", "posterior", "accepted"]
        assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, df.select(*names).collect()))


def test_one_of_each_class(spark):
    df = framed(spark, __node="n", __kept="k", __first=1, __same=2, node="y", label="z", c1="x")
    got = weighted_near_dup.keep_one_of_each_class(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.where("doc_id <> 3").collect()))
