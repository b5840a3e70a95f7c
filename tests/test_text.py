import unicodedata

import pytest
from pyspark.sql import functions as F

from scrivane.functions import quality, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("given", "want"),
    [("A &amp; B <b>c</b>", "A B c"), ("a\n\n\n\nb", "a\n\nb"), ("  x\t\ty ", "x y"), (None, ""), (" \n", ""), ("café “x”", "cafe x")],
)
def test_light_clean(spark, given, want):
    assert one(spark, given, text.clean_for_extraction) == want


def test_light_clean_is_idempotent(spark):
    once = one(spark, "Line  one\n\n\n\nLine\ttwo ", text.clean_for_extraction)
    assert one(spark, once, text.clean_for_extraction) == once


def test_fold_equals_decomposition(spark):
    samples = ["naïve", "ﬁne", "½", "Straße", "日本", "", "é"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select(text.fold("t").alias("r")).collect()
    assert [r.r for r in rows] == [unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() for s in samples]


def test_classification_clean(spark):
    given = "<p>I cannot reach jane@x.org or +1 (555) 123-4567, see http://a.b/c?d=1 — Python3, 42 churches!</p>"
    got = one(spark, given, lambda c: text.clean_for_classification(c, ["i", "or", "see", "can"], ["church", "python"]))
    assert got == "not reach emailaddress phonenumber python3 church"


@pytest.mark.parametrize(("word", "want"), [("studies", "study"), ("boxes", "box"), ("leaves", "leaf"), ("women", "woman"), ("status", "status"), ("dishes", "dish"), ("cats", "cat")])
def test_lemma(word, want):
    assert text.base_form(word, {"study", "box", "leaf", "woman", "dish", "cat"}) == want


def test_lexicon_of_a_corpus(spark):
    df = spark.createDataFrame([(["cat", "cats"],), (["cat", "dog", "dog"],), (None,)], "w array<string>")
    assert text.lexicon_from(df, "w") == ["cat"]
    with pytest.raises(ValueError):
        text.lexicon_from(df, "w", least=1, most=1)
    assert [r.l for r in df.select(text.lemmas(F.col("w"), ["cat"]).alias("l")).collect()] == [["cat", "cat"], ["cat", "dog", "dog"], None]


def test_bullets_and_registered_functions(spark):
    assert one(spark, "• one\n  - two – three\n", text.strip_bullets) == "one two – three"
    text.register(spark)
    assert spark.sql("SELECT fold_text('naïve') AS t").first().t == "naive"


@pytest.mark.parametrize(
    ("given", "want"),
    [("manage-\nment", "management"), ("mail me: joe @ site . com", "mail me: joe@site.com"), ("a b​c﻿", "a bc"), ("x    y", "x y"), ("linkedin . com / in / joe", "linkedin.com/in/ joe"), ("a\n\n\n\n\nb", "a\n\n\nb")],
)
def test_clean_extracted(spark, given, want):
    assert one(spark, given, text.clean_extracted) == want


def test_numbers_and_truncation(spark):
    assert one(spark, "call 555 123 4567 89 or room 12 python3", text.mark_numbers) == "call  PHONE  or room  NUMBER  python3"
    assert one(spark, "x" * 301, text.truncate) == "x" * 300 + "..."
    assert one(spark, "short", text.truncate) == "short"


GARBLED = "xk3f9 q2w1e zz9plm 8hty7 jj4kd9 p0o9i8 m2n3b4 ttt5y6 qwe7rt y8u9io zx1cv2 lkj3hg poi4uy mnb5vc xzq6wd"
READABLE = "Jane Doe, software engineer. Contact: jane@doe.org. Experience: built data systems for ten years. Education: degree in computing. Skills: Python and SQL."


@pytest.mark.parametrize(("given", "want"), [(None, True), ("a" * 79, True), ("word " * 11 + "and" + "x" * 60, False), (GARBLED, True), (READABLE, False), ("ab " * 40, True), ("longer words here " * 3 + "x" * 40, True)])
def test_garbled(spark, given, want):
    assert one(spark, given, quality.looks_garbled) is want


def test_gate(spark):
    assert one(spark, None, quality.gate_status) == "blank"
    assert one(spark, " \n", quality.gate_status) == "blank"
    assert one(spark, GARBLED, quality.gate_status) == "low_quality"
    assert one(spark, READABLE, quality.gate_status) == "ok"
    assert one(spark, READABLE, lambda c: quality.gate_status(c, False)) == "no_model"
