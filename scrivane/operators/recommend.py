"""Completeness score and keyword gap of an extracted record: one projection, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (section, points lost without it, what it is good for, what to do about it).
CHECKS = (
    ("Name", 18, "Name/contact header is present.", "Add your full name at the top of the CV so recruiters can identify you quickly."),
    ("Email", 18, "Professional email is present.", "Add a professional email address in a consistent format, such as name@domain.com."),
    ("Phone", 14, "Phone number is included.", "Include a contact number so employers can reach you directly."),
    ("Location", 10, "Location is available.", "Add your city or location to make your CV easier to shortlist locally."),
    ("Skills", 18, "Skills section is reasonably detailed.", "Add more job-relevant skills to match the target role and strengthen keyword relevance."),
    ("Education", 10, "Education section appears to be present.", "Include education details, especially your degree, institution, and graduation year."),
    ("Experience", 20, "Work experience is visible.", "Add a clear experience section with company names, roles, and dates."),
)
#: Two more messages, and the tip that goes with a score below 70.
LOOKS_STRONG = "Your CV structure looks strong. Consider adding measurable outcomes and achievements to improve impact."
ROLE_KEYWORDS = "Use role-specific keywords from the target job description to improve category matching and recruiter relevance."
LOW_SCORE = 70
TIP = "Add measurable achievements, stronger skills, and clearer job-role keywords to improve recruiter fit."
#: Keywords of a category; any other takes the default.
KEYWORDS = {
    "HEALTHCARE": ["patient care", "clinical support", "medical terminology", "health records", "HIPAA", "team collaboration"],
    "ENGINEERING": ["system design", "automation", "python", "testing", "requirements analysis", "optimization"],
    "FINANCE": ["financial analysis", "budgeting", "forecasting", "risk analysis", "excel", "reporting"],
    "SALES": ["client acquisition", "pipeline management", "negotiation", "CRM", "business development", "retention"],
    "IT": ["cloud", "sql", "python", "api", "agile", "project delivery"],
    "DENTIST": ["patient care", "dental procedures", "oral health", "treatment planning", "clinical dentistry", "infection control"],
}
#: Keywords of any other category.
DEFAULT_KEYWORDS = ["leadership", "communication", "problem solving", "teamwork", "results", "stakeholder management"]
#: Sentences to write, by category.
SENTENCES = {
    "DENTIST": [
        "Provided comprehensive patient care with a focus on diagnosis, treatment planning, and oral health education.",
        "Maintained infection control standards and delivered high-quality dental procedures in a patient-centered clinic environment.",
        "Improved patient outcomes by combining clinical expertise, communication, and effective treatment coordination.",
    ],
    "ENGINEERING": [
        "Designed and optimized engineering systems to improve performance, quality, and operational efficiency.",
        "Collaborated with cross-functional teams to deliver scalable solutions using automation, testing, and analytical problem solving.",
        "Improved system reliability and workflow efficiency through continuous optimization and structured engineering processes.",
    ],
    "HEALTHCARE": [
        "Delivered patient-focused care while maintaining compliance, documentation accuracy, and service quality standards.",
        "Supported clinical operations through effective communication, teamwork, and continuous quality improvement.",
        "Improved healthcare service delivery by coordinating patient support, documentation, and operational efficiency.",
    ],
}
#: Sentences for any other category.
DEFAULT_SENTENCES = [
    "Improved patient care and clinical support by delivering high-quality service in a fast-paced healthcare setting.",
    "Led cross-functional teamwork to improve service quality, patient satisfaction, and operational efficiency.",
    "Delivered measurable results through strong problem-solving, communication, and stakeholder collaboration.",
    "Developed and optimized workflows to improve reliability, performance, and customer experience.",
    "Managed responsibilities with a focus on quality assurance, compliance, and continuous process improvement.",
]


def _texts(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _by_category(category: Column, table: dict[str, list[str]], default: list[str]) -> Column:
    out = _texts(default)
    for key, values in table.items():
        out = F.when(category == key, _texts(values)).otherwise(out)
    return out


def recommendations(name: Column, email: Column, phone: Column, location: Column, skills: Column, degrees: Column, universities: Column, job_titles: Column, entries: Column, category: Column) -> Column:
    """Struct of scores, messages, keyword gap and sentences. Null lists count as empty, a null category as unnamed."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    given = lambda c: F.coalesce(c != "", F.lit(False))
    n_skills = F.greatest(count(skills), F.lit(0))
    present = [given(name), given(email), given(phone), given(location), n_skills >= 6, (count(degrees) > 0) | (count(universities) > 0), (count(entries) > 0) | (count(job_titles) > 0)]
    score, complete = F.lit(100), F.lit(True)
    missing, strengths, advice = [], [], []
    for (section, points, good, todo), there in zip(CHECKS, present):
        score = score - F.when(there, 0).otherwise(points)
        complete = complete & there
        missing.append(F.when(~there, F.lit(section)))
        strengths.append(F.when(there, F.lit(good)))
        advice.append(F.when(~there, F.lit(todo)))
    vague = F.coalesce(category.isin("Unknown", "HEALTHCARE"), F.lit(False))
    score = score - F.when(vague, 8).otherwise(0)
    advice += [F.when(complete, F.lit(LOOKS_STRONG)), F.when(vague, F.lit(ROLE_KEYWORDS))]
    ats = F.greatest(F.lit(0), F.least(F.lit(100), score))
    match = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(ats.cast("double") * F.lit(0.7) + n_skills * 4).cast("int")))
    key = F.upper(F.coalesce(category, F.lit("DEFAULT")))
    keywords = _by_category(key, KEYWORDS, DEFAULT_KEYWORDS)
    known = F.lower(F.array_join(F.coalesce(skills, F.array().cast("array<string>")), " "))
    gap = F.slice(F.filter(keywords, lambda k: ~F.contains(known, F.lower(k))), 1, 5)
    listed = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.struct(
        category.alias("category"), ats.alias("ats_score"), match.alias("job_match_score"), F.slice(listed(advice), 1, 4).alias("recommendations"), keywords.alias("keywords"), gap.alias("keyword_gap"),
        listed(missing).alias("missing_sections"), listed(strengths).alias("strengths"), _by_category(key, SENTENCES, DEFAULT_SENTENCES).alias("writing_suggestions"),
        F.when(ats < LOW_SCORE, F.lit(TIP)).alias("tip"),
    )


def of_records(records: DataFrame) -> DataFrame:
    """Recommendations of a table of extracted records."""
    r = recommendations(*(F.col(c) for c in ("name", "email", "phone", "location", "skills", "degrees", "universities", "job_titles", "experience_entries", "category")))
    return records.select("resume_id", r.alias("r")).select("resume_id", "r.*")


def degree_badge(degree: Column) -> Column:
    low = F.lower(degree)
    return F.when(F.contains(low, F.lit("ncea")) | F.contains(low, F.lit("school")), "Secondary").otherwise("Tertiary")


def degree_parts(degree: Column) -> Column:
    """(title, institution), cut at the first ' at ', else at the first dash."""
    cut = F.when(F.contains(degree, F.lit(" at ")), F.split(degree, " at ", 2)).otherwise(F.split(degree, " — ", 2))
    return F.struct(F.trim(F.get(cut, F.lit(0))).alias("title"), F.trim(F.coalesce(F.get(cut, F.lit(1)), F.lit(""))).alias("institution"))


def formatted(columns: list[str]) -> Column:
    """A record as labelled lines with bullets, of the columns it has; empty fields leave no line."""
    line = lambda label, c: F.when(F.coalesce(c != "", F.lit(False)), F.concat(F.lit(f"{label}: "), c))

    def block(label: str, c: Column) -> Column:
        bullets = F.array_join(F.transform(c, lambda x: F.concat(F.lit("  • "), x)), "\n")
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(f"{label}:\n"), bullets))

    parts = [line(label, F.col(c)) for label, c in (("Name", "name"), ("Email", "email"), ("Phone", "phone"), ("Location", "location")) if c in columns]
    if "links" in columns:
        parts += [line("LinkedIn", F.col("links.linkedin")), line("GitHub", F.col("links.github"))]
    lists = (
        ("Skills", "skills"), ("Degree(s)", "degrees"), ("University/College", "universities"), ("Job Title(s)", "job_titles"), ("Organization(s)", "organizations"), ("Certifications", "certifications"), ("Languages", "languages"),
    )
    return F.concat_ws("\n", *parts, *(block(label, F.col(c)) for label, c in lists if c in columns))
