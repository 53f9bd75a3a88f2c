import re
import time

from pyspark.sql import functions as F

from matchloom.operators import suggestion_lists as s

OTHERS = ([], ["led"], "[0-9]{2}|%", [], ", tail.", [])


def judged(spark, texts):
    df = spark.createDataFrame([(texts,)], "b array<string>")
    return df.select(F.explode(s.judged(F.col("b"), *OTHERS)).alias("x")).select("x.*").collect()


def test_sentences_of_odd_texts(spark):
    texts = ["A. B.", "A.", "...", "A.. B", "A.B!", ". A.", "", "A\nb. c?", "..a..b..", "no end"]
    assert [r.sentences for r in judged(spark, texts)] == [len(re.findall("[^.!?]+[.!?]+", x)) > 1 for x in texts]


def test_a_long_open_sentence_takes_no_square(spark):
    """A bullet of 200,000 signs without a stop: its square would be some minutes."""
    judged(spark, ["a b"])
    began = time.time()
    assert [r.sentences for r in judged(spark, ["ab " * 66_000])] == [False]
    assert time.time() - began < 15
