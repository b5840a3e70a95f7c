"""Named queries over the data folder's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions import credentials, extract, quality, text
from scrivane.operators import features, metrics, models, recommend, stats
from scrivane.plans import analyze
from scrivane.plans import extraction_sql as xs
from scrivane.runtime import spread, table
from scrivane.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pieces of the SQL side -------------------------------------------------------------------------------------------

_S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NS = _S.replace("[", "[^", 1)


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_S}+'), lambda t: t <> '')"


def _words(x: str) -> str:
    return f"len({_tokens(x)})"


def _replace(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


_STRIP = lambda x: _replace(x, f"^{_S}+|{_S}+$", "")
_COLLAPSE = lambda x: f"trim({_replace(x, _S + '+', ' ')})"
_HTML = lambda x: _replace(_replace(x, "<[^>]+>", " "), r"&[a-zA-Z]+;|&#\p{Nd}+;|&[\p{L}\p{N}_]+;", " ")
_RESUME = "(SELECT DISTINCT * FROM resume)"


def resumes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Resumes once each, of the named columns; of rows of one id the first in file order stays.

    Which rows are repeats is found on ids and row numbers alone; the texts are read once and not shuffled while the
    repeats are few enough for a join that the optimizer may broadcast.
    """
    rows = table(spark, folder, "resume")
    if set(columns) <= {"category"}:
        return rows.select("id", *columns).dropDuplicates(["id"])
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    places = rows.select("id", place.alias("place"))
    repeated = places.groupBy("id").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").select("id", "first")
    found = spread(rows.select("id", *columns, place.alias("place")), "id")
    joined = found.join(repeated.withColumnRenamed("id", "again"), (F.col("id") == F.col("again")) & (F.col("place") != F.col("first")), "left_anti")
    return joined.select("id", *columns)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def category() -> F.Column:
    return F.upper(text.strip(F.col("category")))


# --- projections and filters ------------------------------------------------------------------------------------------


@query(f"SELECT id, {_STRIP('resume_str')} AS text, {_STRIP('category')} AS category FROM {_RESUME} WHERE resume_str IS NOT NULL AND category IS NOT NULL")
def labelled_corpus(spark, folder):
    rows = resumes(spark, folder, "resume_str", "category").dropna(subset=["resume_str", "category"])
    return rows.select("id", text.strip(F.col("resume_str")).alias("text"), text.strip(F.col("category")).alias("category"))


@query(f"SELECT id FROM {_RESUME} WHERE {_STRIP('resume_str')} <> ''")
def nonempty_rows(spark, folder):
    return resumes(spark, folder, "resume_str").where(text.strip(F.col("resume_str")) != "").select("id")


@query(f"SELECT id, category FROM {_RESUME} ORDER BY md5('42:' || id), id LIMIT 500")
def sample_500(spark, folder):
    return stats.stable_sample(resumes(spark, folder, "category"), "id")


# --- aggregates -------------------------------------------------------------------------------------------------------

_COLUMNS = ["id", "resume_str", "resume_html", "category"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM resume" for c in _COLUMNS))
def null_counts(spark, folder):
    return stats.null_counts(table(spark, folder, "resume"), _COLUMNS)


@query("SELECT CAST((SELECT count(*) FROM resume) - (SELECT count(*) FROM (SELECT DISTINCT * FROM resume)) AS BIGINT) AS duplicates")
def duplicate_count(spark, folder):
    return stats.duplicate_count(table(spark, folder, "resume"))


@query("SELECT DISTINCT prediction_id, resume_id, model, y_true, y_pred, confidence FROM prediction")
def distinct_predictions(spark, folder):
    return stats.distinct_rows(table(spark, folder, "prediction").select("prediction_id", "resume_id", "model", "y_true", "y_pred", "confidence"))


@query("SELECT count(DISTINCT category) AS categories FROM resume")
def distinct_categories(spark, folder):
    return table(spark, folder, "resume").agg(F.countDistinct("category").alias("categories"))


@query(f"SELECT upper({_STRIP('category')}) AS category, count(*) AS n FROM {_RESUME} GROUP BY 1")
def category_counts(spark, folder):
    return stats.value_counts(resumes(spark, folder, "category"), category(), "category")


@query(f"SELECT upper({_STRIP('category')}) AS category, round(avg({_words('resume_str')}), 6) AS mean_words FROM {_RESUME} GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10")
def mean_words_top10(spark, folder):
    return stats.mean_words(resumes(spark, folder, "resume_str", "category"), category(), "resume_str")


@query(f"WITH w AS (SELECT CAST({_words('resume_str')} AS DOUBLE) AS v FROM {_RESUME} WHERE resume_str IS NOT NULL) SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS least, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS most FROM w")
def word_describe(spark, folder):
    return stats.describe(resumes(spark, folder, "resume_str").where("resume_str is not null"), text.word_count(F.col("resume_str")))


@query(f"WITH w AS (SELECT CAST({_words('resume_str')} AS DOUBLE) AS v FROM {_RESUME} WHERE resume_str IS NOT NULL), s AS (SELECT min(v) AS a, max(v) AS b FROM w) SELECT CAST(least(floor((v - a) / ((b - a) / 50)), 49) AS INT) AS bin, count(*) AS n FROM w, s GROUP BY 1")
def word_histogram_50(spark, folder):
    return stats.histogram(resumes(spark, folder, "resume_str").where("resume_str is not null"), text.word_count(F.col("resume_str")))


@query(f"""WITH w AS (SELECT upper({_STRIP('category')}) AS category, CAST({_words('resume_str')} AS DOUBLE) AS v FROM {_RESUME} WHERE resume_str IS NOT NULL),
    q AS (SELECT category, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM w GROUP BY category)
    SELECT w.category, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
    min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS low_whisker, max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS high_whisker FROM w JOIN q ON w.category IS NOT DISTINCT FROM q.category GROUP BY 1""")
def word_box_by_category(spark, folder):
    return stats.box(resumes(spark, folder, "resume_str", "category").where("resume_str is not null"), category(), text.word_count(F.col("resume_str")))


_STOP_TEXT = "the and for with that this from are was were been have has had not you your but all can will our their they them its also which into than then when where who what how about over under between during"


@query(f"""WITH t AS (SELECT unnest(string_split_regex(lower({_replace(_replace('resume_str', '<[^>]+>', ' '), '[^a-zA-Z]', ' ')}), ' +')) AS word FROM {_RESUME})
    SELECT word, count(*) AS n FROM t WHERE length(word) > 3 AND word NOT IN ({', '.join(f"'{w}'" for w in _STOP_TEXT.split())}) GROUP BY word ORDER BY n DESC, word LIMIT 30""")
def top_words_30(spark, folder):
    return stats.top_words(resumes(spark, folder, "resume_str"), "resume_str", _STOP_TEXT.split())


# --- cleaning ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {{'char_count': CAST(length(text) AS INT), 'word_count': CAST({_words('text')} AS INT), 'line_count': CAST(length(text) - length(replace(text, chr(10), '')) AS INT)}} ELSE {{'char_count': NULL, 'word_count': NULL, 'line_count': NULL}} END AS stats FROM documents")
def text_stats(spark, folder):
    return documents(spark, folder).select("doc_id", text.text_stats(F.col("text")).alias("stats"))


@query(f"SELECT id, {_HTML('resume_html')} AS text FROM {_RESUME} WHERE resume_html IS NOT NULL")
def html_removed(spark, folder):
    return resumes(spark, folder, "resume_html").where("resume_html is not null").select("id", text.remove_html(F.col("resume_html")).alias("text"))


@query(f"SELECT doc_id, {_COLLAPSE('text')} AS text FROM documents")
def whitespace_normalized(spark, folder):
    return documents(spark, folder).select("doc_id", text.normalize_whitespace(F.col("text")).alias("text"))


_URL_SQL = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
_EMAIL_SQL = r"[\p{L}\p{N}_.\-+]+@[\p{L}\p{N}_.\-]+\.[a-zA-Z]{2,}"
_PHONE_SQL = r"\+?\p{Nd}[\p{Nd}" + _S[1:-1] + r"\-()]{7,}\p{Nd}"


@query(f"SELECT doc_id, {_replace('text', _URL_SQL, ' ')} AS text FROM documents")
def urls_removed(spark, folder):
    return documents(spark, folder).select("doc_id", text.remove_urls(F.col("text")).alias("text"))


@query(f"SELECT id, {_replace('resume_str', _EMAIL_SQL, ' emailaddress ')} AS text FROM {_RESUME}")
def emails_marked(spark, folder):
    return resumes(spark, folder, "resume_str").select("id", text.mark_emails(F.col("resume_str")).alias("text"))


@query(f"SELECT id, {_replace('resume_str', _PHONE_SQL, ' phonenumber ')} AS text FROM {_RESUME}")
def phones_marked(spark, folder):
    return resumes(spark, folder, "resume_str").select("id", text.mark_phones(F.col("resume_str")).alias("text"))


@query(f"SELECT doc_id, {_replace('text', '[^a-zA-Z0-9' + _S[1:], ' ')} AS text FROM documents")
def punctuation_removed(spark, folder):
    return documents(spark, folder).select("doc_id", text.remove_punctuation(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, array_to_string(list_filter({_tokens(f"lower({_replace('text', '[^a-zA-Z0-9' + _S[1:], ' ')})")}, lambda t: NOT regexp_full_match(t, '[0-9]+')), ' ') AS text FROM documents WHERE text IS NOT NULL""")
def numbers_removed(spark, folder):
    plain = F.lower(text.remove_punctuation(F.col("text")))
    return documents(spark, folder).where("text is not null").select("doc_id", text.normalize_whitespace(text.remove_numbers(plain)).alias("text"))


@query(xs.numbers_marked)
def numbers_marked(spark, folder):
    return documents(spark, folder).select("doc_id", text.mark_numbers(F.col("text")).alias("text"))


@query(f"SELECT doc_id, array_to_string(list_filter(string_split_regex(lower({_replace(_replace('text', '<[^>]+>', ' '), '[^a-zA-Z]', ' ')}), ' +'), lambda t: length(t) > 3), ' ') AS words FROM documents")
def quick_tokens(spark, folder):
    return documents(spark, folder).select("doc_id", F.array_join(text.quick_tokens(F.col("text")), " ").alias("words"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS text FROM documents")
def truncated(spark, folder):
    return documents(spark, folder).select("doc_id", text.truncate(F.col("text")).alias("text"))


@query(xs.extracted_text_cleaned)
def extracted_text_cleaned(spark, folder):
    return documents(spark, folder).select("doc_id", text.clean_extracted(F.col("text")).alias("text"))


@query(xs.unicode_folded)
def unicode_folded(spark, folder):
    return documents(spark, folder).select("doc_id", text.fold("text").alias("text"))


@query(xs.light_clean)
def light_clean(spark, folder):
    return resumes(spark, folder, "resume_html").select("id", text.clean_for_extraction(F.col("resume_html")).alias("text"))


@query(xs.classification_clean)
def classification_clean(spark, folder):
    return classified_text(spark, folder).select("id", "clean")


def classified_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = resumes(spark, folder, "resume_str", "category")
    return rows.select("id", category().alias("category"), text.clean_for_classification(F.col("resume_str"), text.stop_words(spark)).alias("clean"))


@query(xs.word_tokens)
def word_tokens(spark, folder):
    plain = text.remove_punctuation(F.col("text"))
    return documents(spark, folder).where("text is not null").select("doc_id", F.array_join(text.word_tokens(plain), " ").alias("words"))


@query()
def lemma_clean(spark, folder):
    """Full cleaning with lemmas; the lexicon is what two resumes or more have."""
    rows = resumes(spark, folder, "resume_str").select("id", text.classification_words(F.col("resume_str"), text.stop_words(spark)).alias("words"))
    return rows.select("id", F.array_join(text.lemmas(F.col("words"), text.lexicon_from(rows, "words")), " ").alias("clean"))


@query(xs.bullets_stripped)
def bullets_stripped(spark, folder):
    return documents(spark, folder).select("doc_id", text.strip_bullets(F.col("text")).alias("text"))


# --- quality ----------------------------------------------------------------------------------------------------------

_FLAG = f"""WITH c AS (SELECT doc_id, text, {_COLLAPSE('text')} AS x FROM documents),
    m AS (SELECT *, {_tokens('x')} AS t, CAST(len(regexp_extract_all(x, '[A-Za-z]{{3,}}')) AS DOUBLE) AS runs FROM c),
    k AS (SELECT *, CAST(len(t) AS DOUBLE) AS n, len(list_filter(t, lambda w: length(w) >= 6 AND regexp_matches(w, '\\p{{Nd}}') AND regexp_matches(w, '\\p{{L}}'))) AS mixed,
      regexp_matches(lower(x), '{"|".join(quality.MARKERS)}') OR regexp_matches(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') OR regexp_matches(x, '\\+?\\p{{Nd}}[\\p{{Nd}}{_S[1:-1]}().-]{{7,}}\\p{{Nd}}') AS vouched FROM m),
    f AS (SELECT doc_id, text, n, coalesce(length(x) < 80 OR n < 12 OR runs = 0 OR runs / n < 0.55 OR (NOT vouched AND (mixed / n >= 0.08 OR (runs / n < 0.65 AND runs < 40))), true) AS garbled FROM k)"""


@query(_FLAG + " SELECT doc_id, garbled FROM f")
def quality_flags(spark, folder):
    return documents(spark, folder).select("doc_id", quality.looks_garbled(F.col("text")).alias("garbled"))


@query(_FLAG + f" SELECT doc_id, CASE WHEN text IS NULL OR {_STRIP('text')} = '' THEN 'blank' WHEN garbled THEN 'low_quality' WHEN n < 15 THEN 'too_short' ELSE 'ok' END AS gate_status FROM f")
def gate_status(spark, folder):
    return documents(spark, folder).select("doc_id", quality.gate_status(F.col("text")).alias("gate_status"))


# --- extraction -------------------------------------------------------------------------------------------------------


def outlined(spark: SparkSession, folder: str) -> DataFrame:
    """(id, clean, parts): lightly cleaned resumes and their sections."""
    return analyze.outlined(resumes(spark, folder, "resume_str"), "resume_str", "id")


def clean_resumes(spark: SparkSession, folder: str) -> DataFrame:
    return resumes(spark, folder, "resume_str").select("id", text.clean_for_extraction(F.col("resume_str")).alias("t"))


def skill_dictionary(spark: SparkSession, folder: str) -> dict[str, str]:
    return extract.dictionary_from(table(spark, folder, "extracted_record"))


_ALL_SECTIONS = ("skills", "education", "experience", "certifications", "languages", "soft_skills", "projects", "summary")


@query(xs.section_text)
def section_text(spark, folder):
    pieces = clean_resumes(spark, folder).select("id", extract.headed(F.col("t")).alias("p"))
    return pieces.select("id", *(extract.section_of(F.col("p"), k).alias(k) for k in _ALL_SECTIONS))


@query(xs.section_items)
def section_items(spark, folder):
    return clean_resumes(spark, folder).select("id", extract.split_items(extract.section(F.col("t"), "skills")).alias("items"))


@query(xs.emails)
def emails(spark, folder):
    return clean_resumes(spark, folder).select("id", extract.email(F.col("t")).alias("email"))


@query(xs.phones)
def phones(spark, folder):
    return clean_resumes(spark, folder).select("id", extract.phone(F.col("t")).alias("phone"))


@query(xs.links)
def links(spark, folder):
    return clean_resumes(spark, folder).select("id", extract.links(F.col("t")).alias("links"))


@query(xs.names)
def names(spark, folder):
    return clean_resumes(spark, folder).select("id", extract.name(F.col("t"), list(skill_dictionary(spark, folder))).alias("name"))


@query(xs.locations)
def locations(spark, folder):
    return clean_resumes(spark, folder).select("id", extract.location(F.col("t")).alias("location"))


@query(xs.skills)
def skills(spark, folder):
    return clean_resumes(spark, folder).select("id", extract.skills(F.col("t"), skill_dictionary(spark, folder)).alias("skills"))


@query(xs.education)
def education(spark, folder):
    return outlined(spark, folder).select("id", credentials.education(F.col("clean"), F.col("parts.education")).alias("e")).select("id", "e.*")


@query()
def experience_entries(spark, folder):
    rows = analyze.outlined(resumes(spark, folder, "resume_str"), "resume_str", "id", skills=skill_dictionary(spark, folder))
    return rows.select("id", "work.*")


@query(xs.certifications)
def certifications(spark, folder):
    return outlined(spark, folder).select("id", credentials.certifications(F.col("clean"), F.col("parts.certifications")).alias("certifications"))


@query(xs.languages)
def languages(spark, folder):
    return outlined(spark, folder).select("id", credentials.languages(F.col("parts.languages")).alias("languages"))


@query()
def extract_all(spark, folder):
    return analyze.records(resumes(spark, folder, "resume_str"), skill_dictionary(spark, folder))


@query()
def analyze_all(spark, folder):
    return analyze.analyzed(resumes(spark, folder, "resume_str", "category"), skill_dictionary(spark, folder))


def predictor(spark: SparkSession, folder: str, name: str = "naive_bayes") -> models.Predictor:
    made = model_data(spark, folder)
    return models.Predictor(models.fit(name, made.data, len(made.labels)), made.vocabulary, made.labels)


@query()
def predict_resumes(spark, folder):
    """Every resume's predicted category, confidence, first three and ranks two to five; blank texts are Unknown."""
    return predictor(spark, folder)(resumes(spark, folder, "resume_str"), "resume_str").drop("resume_str")


@query()
def analyze_predicted(spark, folder):
    """The whole analysis as an application shows it: gate, prediction, record, advice for the predicted category."""
    rows = resumes(spark, folder, "resume_str", "category").withColumn("input_source", F.lit("table"))
    return analyze.analyzed(rows, skill_dictionary(spark, folder), source="input_source", predict=predictor(spark, folder))


@query()
def json_export(spark, folder):
    return analyze.export(analyze_predicted(spark, folder))


# --- recommendations --------------------------------------------------------------------------------------------------

_SCORE = """WITH r AS (SELECT DISTINCT * FROM extracted_record),
    p AS (SELECT *, coalesce(len(skills), 0) AS n, coalesce(name <> '', false) AS a, coalesce(email <> '', false) AS b, coalesce(phone <> '', false) AS c, coalesce(location <> '', false) AS d, coalesce(len(skills), 0) >= 6 AS e,
      coalesce(len(degrees), 0) > 0 OR coalesce(len(universities), 0) > 0 AS f, coalesce(len(experience_entries), 0) > 0 OR coalesce(len(job_titles), 0) > 0 AS g, coalesce(category IN ('Unknown', 'HEALTHCARE'), false) AS h FROM r),
    s AS (SELECT *, CAST(greatest(0, 100 - CASE WHEN a THEN 0 ELSE 18 END - CASE WHEN b THEN 0 ELSE 18 END - CASE WHEN c THEN 0 ELSE 14 END - CASE WHEN d THEN 0 ELSE 10 END - CASE WHEN e THEN 0 ELSE 18 END - CASE WHEN f THEN 0 ELSE 10 END
      - CASE WHEN g THEN 0 ELSE 20 END - CASE WHEN h THEN 8 ELSE 0 END) AS INT) AS ats FROM p)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.of_records(stats.distinct_rows(table(spark, folder, "extracted_record")))


@query(_SCORE + " SELECT resume_id, ats AS ats_score, CAST(greatest(0, least(100, floor(CAST(ats AS DOUBLE) * CAST(0.7 AS DOUBLE) + n * 4))) AS INT) AS job_match_score FROM s")
def recommendation_scores(spark, folder):
    return scored(spark, folder).select("resume_id", "ats_score", "job_match_score")


@query(_SCORE + " SELECT resume_id, concat_ws('|', CASE WHEN NOT a THEN 'Name' END, CASE WHEN NOT b THEN 'Email' END, CASE WHEN NOT c THEN 'Phone' END, CASE WHEN NOT d THEN 'Location' END, CASE WHEN NOT e THEN 'Skills' END, CASE WHEN NOT f THEN 'Education' END, CASE WHEN NOT g THEN 'Experience' END) AS missing FROM s")
def missing_sections(spark, folder):
    return scored(spark, folder).select("resume_id", F.array_join("missing_sections", "|").alias("missing"))


_GAP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in recommend.KEYWORDS.items())


@query(f"WITH r AS (SELECT DISTINCT * FROM extracted_record), k AS (SELECT resume_id, lower(coalesce(array_to_string(skills, ' '), '')) AS have, CASE upper(coalesce(category, '')) {_GAP} ELSE {recommend.DEFAULT_KEYWORDS} END AS want FROM r) SELECT resume_id, array_to_string(list_filter(want, lambda w: NOT contains(have, lower(w)))[1:5], '|') AS gap FROM k")
def skill_gap(spark, folder):
    return scored(spark, folder).select("resume_id", F.array_join("keyword_gap", "|").alias("gap"))


@query(xs.recommendations(_SCORE))
def recommendations(spark, folder):
    return scored(spark, folder)


_RECORD_COLUMNS = ["name", "email", "phone", "location", "skills", "degrees", "universities", "job_titles"]


@query(xs.record_text)
def record_text(spark, folder):
    return stats.distinct_rows(table(spark, folder, "extracted_record")).select("resume_id", recommend.formatted(_RECORD_COLUMNS).alias("text"))


@query(xs.degree_display)
def degree_display(spark, folder):
    rows = stats.distinct_rows(table(spark, folder, "extracted_record")).select("resume_id", F.explode("degrees").alias("degree"))
    return rows.select("resume_id", "degree", recommend.degree_badge(F.col("degree")).alias("badge"), recommend.degree_parts(F.col("degree")).alias("parts"))


# --- features ---------------------------------------------------------------------------------------------------------

_TERMS = f"""WITH one AS (SELECT id AS doc, list_filter(regexp_extract_all(lower(resume_str), '{features.TOKEN}'), lambda t: t <> '') AS w FROM {_RESUME} WHERE resume_str IS NOT NULL),
    terms AS (SELECT doc, unnest(w) AS term FROM one UNION ALL SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM one),
    tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM one), v AS (SELECT term, df, total, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT 15000)"""


def written(spark: SparkSession, folder: str) -> DataFrame:
    return resumes(spark, folder, "resume_str").where("resume_str is not null")


@query(_TERMS + " SELECT term, df, total FROM df")
def document_frequency(spark, folder):
    return features.document_frequency(written(spark, folder), "resume_str")


@query(_TERMS + " SELECT term, df, total, round(idf, 6) AS idf FROM v")
def vocab_topk(spark, folder):
    n = resumes(spark, folder, "resume_str").where("resume_str is not null").count()
    return features.vocabulary(document_frequency(spark, folder), n).select("term", "df", "total", F.round("idf", 6).alias("idf"))


@query(_TERMS + " SELECT doc, term, round((1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY doc)), 6) AS weight FROM tf JOIN v USING (term)")
def tfidf_weights(spark, folder):
    rows = written(spark, folder)
    return features.tfidf(rows, "id", "resume_str", features.fit(rows, "resume_str")).withColumn("weight", F.round("weight", 6))


@query(f"SELECT CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS label, category FROM (SELECT DISTINCT upper({_STRIP('category')}) AS category FROM resume WHERE category IS NOT NULL)")
def label_index(spark, folder):
    return stats.labels(table(spark, folder, "resume").select(category().alias("category")), "category")


_SPLIT = f"""WITH r AS (SELECT id, upper({_STRIP('category')}) AS category FROM {_RESUME} WHERE category IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || id), id) AS k, floor(count(*) OVER (PARTITION BY category) * 0.7 + 0.5) AS cut, count(*) OVER (PARTITION BY category) AS n FROM r),
    s AS (SELECT id, category, CASE WHEN k <= cut THEN 'train' WHEN k <= cut + floor((n - cut) * 0.5 + 0.5) THEN 'validation' ELSE 'test' END AS split FROM o)"""


def split(spark: SparkSession, folder: str) -> DataFrame:
    return stats.stratified_split(resumes(spark, folder, "category").where("category is not null").withColumn("category", category()), "id", "category")


@query(_SPLIT + " SELECT * FROM s")
def split_assignment(spark, folder):
    return split(spark, folder)


@query(_SPLIT + " SELECT category, split, count(*) AS n FROM s GROUP BY ALL")
def split_counts(spark, folder):
    return split(spark, folder).groupBy("category", "split").agg(F.count("*").alias("n"))


# --- models -----------------------------------------------------------------------------------------------------------


@query(_SPLIT + f""", d AS (SELECT r.id AS doc, s.category, s.split, string_split_regex(lower(resume_str), '[^a-z]+') AS w FROM {_RESUME} r JOIN s ON r.id = s.id WHERE resume_str IS NOT NULL),
    x AS (SELECT doc, category, split, unnest(list_filter(w, lambda t: length(t) > 2)) AS term FROM d), tf AS (SELECT category, term, count(*) AS n FROM x WHERE split = 'train' GROUP BY ALL),
    v AS (SELECT count(DISTINCT term) AS v FROM tf), tot AS (SELECT category, sum(n) AS t FROM tf GROUP BY category),
    c AS (SELECT d.category, ln(count(*) / sum(count(*)) OVER ()) AS prior, ln(coalesce(any_value(t), 0) + 0.1 * any_value(v)) AS base FROM d LEFT JOIN tot ON d.category = tot.category CROSS JOIN v WHERE split = 'train' GROUP BY d.category),
    k AS (SELECT doc, term, count(*) AS k FROM x WHERE term IN (SELECT term FROM tf) GROUP BY ALL),
    g AS (SELECT doc, category, sum(k * (ln(n + 0.1) - ln(0.1))) AS gain FROM k JOIN tf USING (term) GROUP BY ALL), kn AS (SELECT doc, sum(k) AS known FROM k GROUP BY doc),
    sc AS (SELECT kn.doc, c.category, round(prior + coalesce(gain, 0) - known * base, 6) AS score FROM kn CROSS JOIN c LEFT JOIN g ON g.doc = kn.doc AND g.category = c.category),
    b AS (SELECT doc, category AS predicted, row_number() OVER (PARTITION BY doc ORDER BY score DESC, category) AS r FROM sc)
    SELECT d.doc, d.category, d.split, b.predicted FROM d JOIN b ON d.doc = b.doc WHERE r = 1""")
def nb_predict(spark, folder):
    rows = written(spark, folder).join(split(spark, folder), "id")
    return models.relational_naive_bayes(rows, "id", "resume_str", "category", "split")


def model_data(spark: SparkSession, folder: str, size: int = 15_000) -> models.Prepared:
    rows = resumes(spark, folder, "resume_str", "category")  # first: it ships the package that the cleaning needs
    clean = text.cleaned_in_batches(F.col("resume_str"), text.stop_words(spark))
    rows = rows.select("id", category().alias("category"), clean.alias("clean"))
    return models.prepared(rows, "id", "clean", "category", size)


def modelled(spark: SparkSession, folder: str, name: str) -> DataFrame:
    made = model_data(spark, folder)
    return models.predictions(models.fit(name, made.data, len(made.labels)), made.data, made.labels)


@query()
def logistic_regression(spark, folder):
    return modelled(spark, folder, "logistic_regression")


@query()
def naive_bayes(spark, folder):
    return modelled(spark, folder, "naive_bayes")


@query()
def random_forest(spark, folder):
    """200 trees of depth 30 over 15,000 terms."""
    return modelled(spark, folder, "random_forest")


@query()
def linear_svm(spark, folder):
    return modelled(spark, folder, "linear_svm")


@query()
def model_comparison(spark, folder):
    """All four models on the validation split."""
    return models.compare(model_data(spark, folder))


# --- evaluation -------------------------------------------------------------------------------------------------------

_PAIRS = """WITH p AS (SELECT DISTINCT * FROM prediction WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
    l AS (SELECT DISTINCT model, y_true AS label FROM p UNION SELECT DISTINCT model, y_pred FROM p),
    c AS (SELECT l.model, l.label, count(*) FILTER (y_true = l.label AND y_pred = l.label) AS tp, count(*) FILTER (y_true = l.label) AS support, count(*) FILTER (y_pred = l.label) AS predicted FROM l JOIN p ON p.model = l.model GROUP BY ALL),
    m AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp / support END AS recall FROM c),
    k AS (SELECT *, CASE WHEN support + predicted = 0 THEN 0.0::DOUBLE ELSE CAST(2 * tp AS DOUBLE) / (support + predicted) END AS f1 FROM m)"""
_SUMMARY = _PAIRS + """, z AS (SELECT model, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
    round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM k GROUP BY model)"""


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "prediction").dropDuplicates(["prediction_id"])


@query(_PAIRS + " SELECT model, y_true, y_pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model, y_true), 6) AS share FROM p GROUP BY model, y_true, y_pred")
def confusion_matrix(spark, folder):
    return metrics.confusion(predicted(spark, folder), ["model"])


@query(_SUMMARY + " SELECT * FROM z")
def macro_weighted_metrics(spark, folder):
    return metrics.summary(predicted(spark, folder), ["model"])


@query(_SUMMARY + """ SELECT model, CAST(label AS VARCHAR) AS row, round(precision, 2) AS precision, round(recall, 2) AS recall, round(f1, 2) AS f1, support FROM k
    UNION ALL SELECT model, 'accuracy', NULL, NULL, round(accuracy, 2), n FROM z UNION ALL SELECT model, 'macro avg', round(macro_precision, 2), round(macro_recall, 2), round(macro_f1, 2), n FROM z
    UNION ALL SELECT model, 'weighted avg', round(weighted_precision, 2), round(weighted_recall, 2), round(weighted_f1, 2), n FROM z""")
def class_report(spark, folder):
    return metrics.report(predicted(spark, folder), ["model"])


@query(_SUMMARY + """, w AS (SELECT model, CAST(label AS VARCHAR) AS row, round(precision, 2) AS precision, round(recall, 2) AS recall, round(f1, 2) AS f1, support FROM k
    UNION ALL SELECT model, 'accuracy', NULL, NULL, round(accuracy, 2), n FROM z UNION ALL SELECT model, 'macro avg', round(macro_precision, 2), round(macro_recall, 2), round(macro_f1, 2), n FROM z
    UNION ALL SELECT model, 'weighted avg', round(weighted_precision, 2), round(weighted_recall, 2), round(weighted_f1, 2), n FROM z)
    SELECT model, lpad(row, 24, ' ') || coalesce(printf('%9.2f', precision), repeat(' ', 9)) || coalesce(printf('%9.2f', recall), repeat(' ', 9)) || printf('%9.2f', f1) || printf('%9d', support) AS value FROM w""")
def report_file(spark, folder):
    return metrics.report_text(metrics.report(predicted(spark, folder), ["model"]), ["model"])


@query(_SUMMARY + " SELECT * FROM z ORDER BY weighted_f1 DESC, model LIMIT 1")
def best_model(spark, folder):
    return metrics.best(metrics.summary(predicted(spark, folder), ["model"]))


@query(_SUMMARY.replace(", 6)", ", 15)") + " SELECT printf('%s,%.4f,%.4f,%.4f,%.4f,%.4f,%.4f,%.4f', model, accuracy, macro_precision, macro_recall, macro_f1, weighted_precision, weighted_recall, weighted_f1) AS value FROM z")
def comparison_file(spark, folder):
    return metrics.comparison_text(metrics.summary(predicted(spark, folder), ["model"], digits=None), ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"])


@query("""WITH p AS (SELECT resume_id, y_pred, count(*) AS n FROM (SELECT DISTINCT * FROM prediction) GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY resume_id) AS prob FROM p),
    k AS (SELECT resume_id, category, prob, row_number() OVER (PARTITION BY resume_id ORDER BY prob DESC, category) AS r FROM s JOIN category_label ON label = y_pred)
    SELECT resume_id, string_agg(category || ':' || CAST(round(prob, 4) AS VARCHAR), '|' ORDER BY r) AS top_3 FROM k WHERE r <= 3 GROUP BY resume_id""")
def top3_labels(spark, folder):
    """The labels that the models' votes make most probable, three of each resume."""
    labels = table(spark, folder, "category_label").select(F.col("label").alias("y_pred"), "category")
    votes = predicted(spark, folder).groupBy("resume_id", "y_pred").agg(F.count("*").alias("n")).join(F.broadcast(labels), "y_pred")  # the label table is fixed
    p = votes.groupBy("resume_id").agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("v"), F.sum("n").alias("all"))
    top = metrics.top_labels(F.transform("v", lambda x: x["n"] / F.col("all")), F.transform("v", lambda x: x["category"]))
    return p.select("resume_id", F.array_join(F.transform(top, lambda x: F.concat_ws(":", x["label"], F.round(x["prob"], 4).cast("string"))), "|").alias("top_3"))


# --- sources ----------------------------------------------------------------------------------------------------------


@query()
def files_extracted(spark, folder):
    return files.extracted(table(spark, folder, "resume_file").dropDuplicates(["resume_id", "path"])).select("resume_id", "path", "kind", "text", "status")


@query(xs.text_files)
def text_files(spark, folder):
    """Files that are plain text, decoded and repaired."""
    rows = table(spark, folder, "resume_file").select("resume_id", "path", "content").distinct()
    return files.extracted(rows.where(files.file_kind(F.col("path")) == "text")).select("resume_id", "path", "text", "status")


@query()
def samples_analyzed(spark, folder):
    """The sample texts through the whole analysis, with the dictionary of the data folder."""
    return analyze.analyzed(files.pasted(spark, files.SAMPLES), skill_dictionary(spark, folder), source="input_source")


@query("""SELECT status_kind, kind, count(*) AS n FROM (SELECT DISTINCT resume_id, path, content, CASE WHEN regexp_matches(lower(path), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(path), '\\.docx$') THEN 'docx' WHEN regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp|tiff|bmp)$') THEN 'image' ELSE 'text' END AS kind,
    'any' AS status_kind FROM resume_file) GROUP BY ALL""")
def file_kinds(spark, folder):
    rows = table(spark, folder, "resume_file").select("resume_id", "path", "content").distinct()
    return rows.groupBy(F.lit("any").alias("status_kind"), files.file_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


_PAGE = f"""WITH p AS (SELECT DISTINCT resume_id, page_no, page_w, page_h, blocks FROM pdf_page), i AS (SELECT resume_id, page_no, page_w, page_h, unnest(range(1, len(blocks) + 1)) AS i, blocks FROM p WHERE len(blocks) > 0),
    u AS (SELECT resume_id, page_no, page_w AS w, page_h AS h, i, blocks[i].x0 AS x0, blocks[i].y0 AS y0, blocks[i].x1 AS x1, blocks[i].y1 AS y1, {_STRIP('blocks[i].text')} AS t FROM i WHERE {_STRIP('blocks[i].text')} <> '' AND coalesce(blocks[i].block_type, 0) = 0),
    z AS (SELECT *, CASE WHEN y1 <= h * 0.18 THEN 'h' WHEN y0 >= h * 0.90 THEN 'f' ELSE 'b' END AS zone FROM u),
    c AS (SELECT resume_id, page_no, count(*) FILTER (zone = 'b' AND x1 <= w * 0.52) AS l, count(*) FILTER (zone = 'b' AND x0 >= w * 0.35) AS r, count(*) FILTER (zone = 'b') AS b FROM z GROUP BY ALL),
    d AS (SELECT *, l >= 1 AND r >= 1 AND l + r >= b * 0.85 AS two FROM c), j AS (SELECT z.*, two FROM z JOIN d USING (resume_id, page_no)),
    o AS (SELECT resume_id, page_no, t, 0 AS g, y0 AS k1, x0 AS k2, i FROM j WHERE zone = 'h' UNION ALL SELECT resume_id, page_no, t, 3, y0, x0, i FROM j WHERE zone = 'f' UNION ALL SELECT resume_id, page_no, t, 1, y0, x0, i FROM j WHERE zone = 'b' AND NOT two
      UNION ALL SELECT resume_id, page_no, t, 1, y0, 0, i FROM j WHERE zone = 'b' AND two AND x0 >= w * 0.35 UNION ALL SELECT resume_id, page_no, t, 2, y0, 0, i FROM j WHERE zone = 'b' AND two AND x1 <= w * 0.52)"""


@query(_PAGE + " SELECT p.resume_id, p.page_no, coalesce(x.text, '') AS text FROM p LEFT JOIN (SELECT resume_id, page_no, string_agg(t, chr(10) || chr(10) ORDER BY g, k1, k2, i) AS text FROM o GROUP BY ALL) x ON x.resume_id = p.resume_id AND x.page_no = p.page_no")
def pdf_block_order(spark, folder):
    return files.pages_text(table(spark, folder, "pdf_page"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return analyze_all(spark, folder)
