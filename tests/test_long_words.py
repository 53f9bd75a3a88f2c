"""Patterns over texts with very long words, and what parts of a pattern that are looked for first must not change."""

import re
import time

from pyspark.sql import functions as F

from matchloom.functions import text as t
from matchloom.operators import features as f

STEPS = (r"<[^>]*>", r"https?://[^\s]+", r"[^\s@]+@[^\s@]+\.[^\s@]+", r"[a-zA-Z]:[\\/][^\s]*", r"/[a-zA-Z0-9_./\-]*", r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", r"[^a-z0-9\s\-._/]")


def plain(text):
    text = text.lower()
    for step in STEPS:
        text = re.sub(step, " ", text, flags=re.ASCII)
    return re.sub(r"\s+", " ", text, flags=re.ASCII).strip(" ")


def test_markup_of_odd_texts(spark):
    texts = ["", "a b", "<b>x</b> y", "see http://a.b/c d", "a@b.cd@e.f g@h.i", "@a@b.c x@y", "C:\\x y c:z", "1-2-2020 3/4/21 1-2", "x-y 1 - 2", "a/b c", "É ß <", "tab\there  !! x"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.strip_markup(F.col("x"))).collect()
    assert [r[1] for r in sorted(got)] == [plain(x) for x in texts]


def test_a_long_word_is_read_once(spark):
    """An address beside a word of 300,000 signs: its square would be some minutes."""
    df = spark.createDataFrame([("x@y.zz " + "ab" * 150_000,)], "x string").repartition(1)
    began = time.time()
    assert df.select(F.length(t.strip_markup(F.col("x")))).collect()[0][0] == 300_000
    assert time.time() - began < 20


def test_parts_found_first_lose_no_feature(spark):
    whole = ["I know TABLES and a table", "[a](b.PNG) Image: ICON", "™ ★ ✗ a|b|c ***** #", "Profile about", "x Faster 9% increased", "İCON EMOJİ"]
    rows = f.resume_features(spark.createDataFrame([(1, ["Sum", *whole])], "resume_id long, lines array<string>"), ["led"], ["did"]).collect()[0]
    assert (rows.table_word, rows.table_words, rows.icon_words, rows.images, rows.stars, rows.icons, rows.rare_signs) == (True, True, True, True, True, True, 1)
    assert (rows.pipe_pair, rows.table_row, rows.decoration, rows.decoration5, rows.special_signs, rows.heading_summary, rows.heading_skills) == (True, True, True, True, 7, True, False)
    assert (rows.counted_results, rows.metric, rows.digit) == (1, 1, 1)
