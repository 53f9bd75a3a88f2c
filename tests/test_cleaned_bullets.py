"""Cleaning of bullets against the same rules in Python, and of one with very many words."""

import re
import time

from pyspark.sql import functions as F

from matchloom.operators import rewriting as r


def cleaned(text):
    words = re.sub(r"([.!?,])\1+", r"\1", re.sub(r"\s+", " ", text, flags=re.ASCII)).strip(" ").split(" ")
    out = " ".join(x for i, x in enumerate(words) if i == 0 or x.lower() != words[i - 1].lower())
    out = out[:1].upper() + out[1:]
    return out if out == "" or out[-1] in ".!?" else out + "."


def test_odd_texts(spark):
    texts = ["", " ", "a", "a a A b", "a  b", "a\tb\fb", "a\x0bb\rc", "x.. y!! z??", "x,, ,, y", ". . .", "..", "a. A.", "ßa ßa", "the The\t\tthe end!", "a,.b", "é É"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", r.cleaned_bullet(F.col("x"))).collect()
    assert [x[1] for x in sorted(rows)] == [cleaned(x) for x in texts]


def test_the_words_of_a_bullet_are_parted_once(spark):
    """60,000 words: parted again for each of them, it would be minutes."""
    df = spark.createDataFrame([("ab ab cd " * 20_000,)], "x string").repartition(1)
    began = time.time()
    assert df.select(F.length(r.cleaned_bullet(F.col("x")))).collect()[0][0] == 120_000
    assert time.time() - began < 20


def test_lines_are_made_once_for_bullets(spark, sf_dir):
    from matchloom.plans import registry

    plan = registry.QUERIES["bullet_cleaned"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "split" in x]
