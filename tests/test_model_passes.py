import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from scrivane.functions import text
from scrivane.operators import features, models, svm
from scrivane.plans import registry

ODD = [
    None, "", "  ", "cannot gonna Cannot's wanna-be lemme", "a\x00b\x1cc\x0bd e &amp; &#12; &é1_; <b>x</b> <", "call +1 (555) 123-4567 now 12 3a4 007", "x@y.co http://a.b/c?d=1&e z@é.xyz",
    "ﬁne İstanbul Σίσυφος K½ ①②③ 123456789", "don't i'll it's C r not", "1 2 3 4 5 6 7 8 9 0", "<a\nb> <> &nbsp", "１２３ https://ﬁ.com", "__a_b__ x-y z the of",
]


def test_one_pass_cleans_as_the_expressions_do(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "k long, t string")
    stop = text.stop_words(spark)
    rows = df.select(text.clean_for_classification(F.col("t"), stop).alias("want"), text.cleaned_in_batches(F.col("t"), stop).alias("found")).collect()
    assert [r.found for r in rows] == [r.want for r in rows]


@pytest.mark.parametrize("most", [1, 1000])
def test_counts_of_a_task_are_the_document_frequency(spark, most):
    df = spark.createDataFrame([(t,) for t in [*ODD, "b a b a c", "a b a", "c#.net C++"]], "t string").repartition(2)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(features.counted(df, "t", most).collect()) == key(features.document_frequency(df, "t").collect())


def test_models_clean_in_one_pass(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"word{k % 2} common text {k}", ["ab ", "b"][k % 2]) for k in range(40)], "id long, resume_str string, category string")
    monkeypatch.setattr(registry, "resumes", lambda *x: rows)
    made = registry.model_data(spark, "")
    plan = made.data._jdf.queryExecution().optimizedPlan().toString()
    assert "clean(resume_str" in plan and "emailaddress" not in plan  # no scan of the text by an expression
    assert made.data.count() == 40 and made.labels == ["AB", "B"]


def test_svm_reaches_the_minimum(spark):
    """A column that all rows share makes plain gradient steps slow."""
    draw = np.random.default_rng(7)
    x = draw.normal(size=(600, 12)) * np.linspace(0.02, 1, 12)
    x[:, 0] = 20.0
    y = (x[:, 1:] @ draw.normal(size=(11, 3)) + 0.3 * draw.normal(size=(600, 3))).argmax(axis=1)
    rows = spark.createDataFrame([(k, int(y[k]), Vectors.sparse(12, range(12), x[k].tolist())) for k in range(600)], ["doc", "label", "features"]).repartition(3)
    model = svm.fit(rows, 12, 3)
    fold = np.array([r.f for r in rows.select("doc", F.pmod(F.xxhash64(F.lit(42), "doc"), F.lit(3)).cast("int").alias("f")).orderBy("doc").collect()])
    full = np.c_[x, np.ones(600)]

    def loss(w, k, c):
        sign = np.where(y == c, 1.0, -1.0)
        lack = np.maximum(0, 1 - sign * (full @ w)) * (fold != k)
        return (lack**2).sum() + 0.5 * w @ w, full.T @ (-2 * sign * lack) + w, (full * ((lack > 0) * 2.0)[:, None]).T @ full + np.eye(13)

    for k in range(3):
        for c in range(3):
            w = np.zeros(13)
            for _ in range(50):
                _, slope, curve = loss(w, k, c)
                w = w - np.linalg.solve(curve, slope)
            assert loss(model.weights[:, k, c], k, c)[0] <= loss(w, k, c)[0] * 1.02
