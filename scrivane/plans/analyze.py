"""One plan from raw text to gate, prediction, record and recommendations; it runs unchanged over batch and streaming tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.functions import credentials, experience, extract, quality, text
from scrivane.functions.extract import Recogniser
from scrivane.operators.recommend import recommendations

RECORD = ("name", "email", "phone", "location", "skills", "degrees", "universities", "job_titles", "experience_entries")


def outlined(docs: DataFrame, column: str = "resume_str", *keep: str, skills: Iterable[str] | None = None) -> DataFrame:
    """(kept columns, clean, parts, work): the lightly cleaned text, its sections and its experience, from one Arrow pass."""
    whole = experience.outline(text.remove_html(F.coalesce(F.col(column), F.lit(""))), skills)
    rows = docs.select(*keep, whole.alias("o"))
    return rows.select(*keep, "o.clean", F.col("o").alias("parts"), "o.work")


def records(docs: DataFrame, dictionary: Mapping[str, str], key: str = "id", column: str = "resume_str", keep: tuple[str, ...] = (), recogniser: Recogniser | None = None) -> DataFrame:
    """The record of each document: light cleaning, sections, experience, then every other field as an expression.

    ``recogniser``, if given, names people, places and firms where the rules find none.
    """
    t, parts = F.col("clean"), F.col("parts")
    rows = outlined(docs, column, key, *keep, skills=dictionary)
    blank = t == ""
    firms = F.col("work.organizations")
    if recogniser:
        named = F.filter(F.array(recogniser(F.substring(parts["experience"], 1, 2500), "FIRM")), lambda x: x.isNotNull())
        firms = F.when((F.size(firms) == 0) & (parts["experience"] != ""), named).otherwise(firms)
    rows = rows.withColumn("school", credentials.education(t, parts["education"]))
    return rows.select(
        key, *keep, F.when(~blank, extract.name(t, list(dictionary), recogniser)).alias("name"), F.when(~blank, extract.email(t)).alias("email"), F.when(~blank, extract.phone(t)).alias("phone"),
        F.when(~blank, extract.location(t, recogniser)).alias("location"), extract.links(t).alias("links"), extract.skills(t, dictionary).alias("skills"), "school.degrees", "school.universities", "work.job_titles",
        firms.alias("organizations"), "work.experience_entries", credentials.certifications(t, parts["certifications"]).alias("certifications"), credentials.languages(parts["languages"]).alias("languages"),
        F.when(blank, "Empty resume text provided.").alias("error"),
    )


def analyzed(
    docs: DataFrame, dictionary: Mapping[str, str], key: str = "id", column: str = "resume_str", category: str = "category", source: str | None = None, predict: Callable[[DataFrame, str], DataFrame] | None = None, recogniser: Recogniser | None = None
) -> DataFrame:
    """Gate, prediction, record and recommendations of each document.

    What the gate stops keeps its row, with a null text from there on: no pattern and no model sees it. ``predict`` adds
    (predicted_category, confidence, top_3, other_categories, prediction_error), see ``operators.models.Predictor``; with it the
    predicted category decides the recommendations, without it the ``category`` column does. ``source`` names a column
    that says where a text came from.
    """
    gate = F.col("gate_status")
    gated = docs.withColumn("gate_status", quality.gate_status(F.col(column))).withColumn(column, F.when(gate == "ok", F.col(column)))
    keep = ["gate_status", category, *([source] if source else [])]
    if predict:
        gated = predict(gated, column)
        for c in ("predicted_category", "confidence", "top_3", "other_categories", "prediction_error"):
            gated = gated.withColumn(c, F.when(gate == "ok", F.col(c)))
        keep += ["predicted_category", "confidence", "top_3", "other_categories", "prediction_error"]
    out = records(gated, dictionary, key, column, tuple(keep), recogniser)
    rec = recommendations(*(F.col(c) for c in RECORD), F.col("predicted_category") if predict else F.col(category))
    return out.withColumn("recommendation", F.when(gate == "ok", rec))


PROFILE = ("name", "email", "phone", "location", "links", "skills", "degrees", "universities", "job_titles", "organizations", "experience_entries", "certifications", "languages")


def export(analysis: DataFrame, key: str = "id", source: str = "input_source") -> DataFrame:
    """One JSON document per row: gate, predicted category, confidence (four places), profile, source and recommendations.

    An analysis without a predictor exports its category; what a row lacks is left out.
    """
    has = set(analysis.columns)
    parts = [F.col("gate_status"), F.col("predicted_category" if "predicted_category" in has else "category").alias("predicted_category")]
    if "confidence" in has:
        parts += [F.round("confidence", 4).alias("confidence_score"), F.col("top_3"), F.col("prediction_error")]
    profile = F.when(F.col("gate_status") == "ok", F.struct(*(c for c in PROFILE if c in has)))
    parts += [profile.alias("candidate_profile"), *([F.col(source).alias("input_source")] if source in has else []), F.col("recommendation").alias("recommendations")]
    return analysis.select(key, F.to_json(F.struct(*parts)).alias("json"))
