import pytest
from pyspark.sql import functions as F

from scrivane.operators import features, metrics, models, recommend, stats

RECORD = "resume_id long, name string, email string, phone string, location string, skills array<string>, degrees array<string>, universities array<string>, job_titles array<string>, experience_entries array<struct<title:string,company:string,period:string>>, category string"


def test_recommendation_by_hand(spark):
    df = spark.createDataFrame([(1, "A B", "a@b.c", "", "", ["python", "sql"], [], [], [], [], "HEALTHCARE")], RECORD)
    r = recommend.of_records(df).first()
    assert (r.ats_score, r.job_match_score) == (20, 22)
    assert r.missing_sections == ["Phone", "Location", "Skills", "Education", "Experience"] and len(r.recommendations) == 4 and len(r.strengths) == 2
    assert r.keyword_gap == recommend.KEYWORDS["HEALTHCARE"][:5]


def test_recommendation_of_nulls_and_of_a_full_record(spark):
    full = (2, "A", "b", "c", "d", ["leadership", "communication", "problem solving", "teamwork", "results", "x"], ["MBA"], None, ["Chef"], None, "IT2")
    df = spark.createDataFrame([(1, *[None] * 10), full], RECORD)
    rows = {r.resume_id: r for r in recommend.of_records(df).collect()}
    assert rows[1].ats_score == 0 and rows[1].job_match_score == 0
    assert rows[2].ats_score == 100 and rows[2].recommendations == [recommend.LOOKS_STRONG] and rows[2].keyword_gap == ["stakeholder management"]


def test_degree_display(spark):
    df = spark.createDataFrame([("BSc at Oak College",), ("NCEA Level 3 — Hill",), ("MBA",)], "d string")
    rows = df.select(recommend.degree_badge(F.col("d")).alias("b"), recommend.degree_parts(F.col("d")).alias("p")).collect()
    assert [(r.b, r.p.title, r.p.institution) for r in rows] == [("Tertiary", "BSc", "Oak College"), ("Secondary", "NCEA Level 3", "Hill"), ("Tertiary", "MBA", "")]


@pytest.mark.parametrize(
    ("pairs", "accuracy", "macro_f1"),
    [([(0, 0), (1, 1)], 1.0, 1.0), ([(0, 0)], 1.0, 1.0), ([(0, 0), (1, 0)], 0.5, 0.333333), ([(0, 2), (0, 0)], 0.5, 0.333333)],
)
def test_metrics(spark, pairs, accuracy, macro_f1):
    df = spark.createDataFrame([("m", *p) for p in [*pairs, (None, 1), (1, None)]], "model string, y_true int, y_pred int")
    r = metrics.summary(df, ["model"]).first()
    assert (r.accuracy, r.macro_f1) == (accuracy, macro_f1)


def test_best_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "model string, weighted_f1 double")
    assert metrics.best(df).first().model == "a"


def test_split_is_a_partition_within_one_of_the_shares(spark):
    df = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(400)], "id long, category string")
    rows = stats.stratified_split(df, "id", "category").collect()
    assert len({r.id for r in rows}) == 400
    for c in "abc":
        n = sum(r.category == c for r in rows)
        got = {s: sum(r.category == c and r.split == s for r in rows) for s in ("train", "validation", "test")}
        assert abs(got["train"] - 0.7 * n) <= 1 and abs(got["validation"] - 0.15 * n) <= 1 and abs(got["test"] - 0.15 * n) <= 1


def test_tfidf_rows_have_unit_norm(spark):
    df = spark.createDataFrame([(k, f"alpha beta gamma w{k % 4} w{k % 3}") for k in range(30)] + [(99, None), (98, "")], "id long, t string")
    vocab = features.fit(df, "t", most_df=1.0)
    sums = features.tfidf(df, "id", "t", vocab).groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert len(sums) == 30 and all(abs(r.s - 1) < 1e-9 for r in sums)
    assert features.weights(df, vocab, "t").where("size(at) = 0").count() == 2


def test_split_ranks_equal_a_plain_window(spark, monkeypatch):
    df = spark.createDataFrame([(k, ["a", "b", None][k % 3]) for k in range(500)], "id long, category string")
    one = stats.stratified_split(df, "id", "category").orderBy("id").collect()
    monkeypatch.setattr(stats, "CELLS", 1)
    assert one == stats.stratified_split(df, "id", "category").orderBy("id").collect() and len(one) == 500


def test_degenerate_statistics(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [tuple(r) for r in stats.histogram(df, F.col("v")).collect()] == [(0, 2)]
    empty = df.where("false")
    assert stats.histogram(empty, F.col("v")).collect() == [] and stats.describe(empty, F.col("v")).first().n == 0
    assert stats.duplicate_count(empty).first().duplicates == 0


@pytest.fixture(scope="module")
def separable(spark):
    words = {"chef": "cook kitchen menu sauce", "coder": "python code deploy server", "nurse": "ward patient care triage"}
    rows = [(k, f"{words[c]} {words[c].split()[k % 4]} filler{k % 5}", c) for k in range(90) for c in [list(words)[k % 3]]]
    return models.prepared(spark.createDataFrame(rows, "id long, clean string, category string"), "id", "clean", "category", 200)


@pytest.mark.parametrize("name", models.MODELS)
def test_models_learn_and_give_probabilities(spark, separable, name):
    model = models.fit(name, separable.data, 3, **({"iterations": 5} | ({"trees": 5, "depth": 4} if name == "random_forest" else {})))
    rows = models.predictions(model, separable.data.where("split = 'test'"), separable.labels).collect()
    assert sum(r.predicted == r.label for r in rows) >= 0.8 * len(rows)
    for r in rows:
        assert abs(r.top_3[0].prob - r.confidence) < 1e-9 and abs(sum(p.prob for p in r.top_3) - 1) < 1e-6 and r.predicted_category == r.top_3[0].label
        assert [x.label for x in r.other_categories] == [x.label for x in r.top_3[1:]]


@pytest.mark.parametrize("name", ["naive_bayes", "linear_svm"])
def test_saved_models_predict_alike(spark, separable, name, tmp_path):
    predictor = models.Predictor(models.fit(name, separable.data, 3, iterations=5), separable.vocabulary, separable.labels)
    texts = spark.createDataFrame([(1, "cook in the kitchen"), (2, "python code"), (3, " "), (4, None)], "id long, t string")
    want = sorted(predictor(texts, "t").select("id", "predicted_category", "confidence", "prediction_error", "top_3").collect())
    assert [(r.predicted_category, r.prediction_error is None) for r in want] == [("chef", True), ("coder", True), ("Unknown", False), ("Unknown", False)]
    assert want[2].confidence == 0.0 and want[2].top_3[0].label == "Unknown"
    with pytest.raises(FileNotFoundError):
        models.load(spark, str(tmp_path / "none"))
    assert models.cached(spark, str(tmp_path / "none")) is None
    models.save(spark, str(tmp_path / "m"), predictor, score=0.5)
    for again in (models.load(spark, str(tmp_path / "m")), models.cached(spark, str(tmp_path / "m"))):
        assert sorted(again(texts, "t").select("id", "predicted_category", "confidence", "prediction_error", "top_3").collect()) == want


def test_notebook_profile_is_sure(spark, separable):
    model = models.fit("linear_svm", separable.data, 3, profile="notebook", iterations=5)
    assert {r.confidence for r in models.predictions(model, separable.data, separable.labels).collect()} == {1.0}


def test_comparison_has_a_row_a_model(spark, separable):
    rows = models.compare(separable, ("naive_bayes", "logistic_regression"), iterations=5).collect()
    assert [r.model for r in rows] == ["naive_bayes", "logistic_regression"] and all(r.accuracy > 0.8 for r in rows)


def test_naive_bayes_by_join_equals_broadcast(spark):
    rows = [(k, ["cook menu sauce the", "python code the", "ward care the", "", None][k % 5] or None, "abc"[k % 3], "train" if k % 4 else "test") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, c string, s string")
    both = [models.relational_naive_bayes(df, "id", "t", "c", "s", limit=n).orderBy("doc").collect() for n in (0, 10**6)]
    assert both[0] == both[1] and len(both[0]) == 36
    assert models.relational_naive_bayes(df.where("false"), "id", "t", "c", "s").collect() == []


def test_unknown_model():
    with pytest.raises(ValueError):
        models.estimator("perceptron", 10)


def test_metadata_round_trip(tmp_path, spark):
    path = str(tmp_path / "deep" / "facts.json")
    assert models.load_metadata(path) == {}
    models.save_metadata(path, model="x", score=0.5)
    assert models.load_metadata(path) == {"model": "x", "score": 0.5} and models.read_metadata(spark, path).first().score == 0.5
