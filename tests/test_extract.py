import pytest
from pyspark.sql import functions as F

from scrivane.functions import credentials, experience, extract, lexicon, text
from scrivane.plans import analyze

SKILLS = {s: extract.display_name(s) for s in ("python", "c", "c++", "3d modeling", "e-learning", "sql", "golang", "go", "machine learning", "excel", "self-motivated")}


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("given", "want"),
    [("EXPERIENCE\nbuilt it", "built it"), ("Experience:\nbuilt it", ""), ("Work History\na\nb\nEducation\nc", "a\nb"), ("work experience\n\nmy projects\nx", "")],
)
def test_experience_section(spark, given, want):
    assert one(spark, given, lambda c: extract.section(c, "experience")) == want


def test_header_line_is_left_out(spark):
    assert one(spark, "Skills: Python", lambda c: extract.section(c, "skills")) == ""
    assert one(spark, "Skills\nPython, SQL\nx - y", lambda c: extract.split_items(extract.section(c, "skills"))) == ["Python", "SQL"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("write to Bob@X.com", "bob@x.com"), ("End. bob@x.com", "end.bob@x.com"), ("joe @ mail . org", "joe@mail.org"), ("ann@gmall.com", "ann@gmail.com"), ("joe S yahoo", "joe@gmail.com"), ("nothing", None)],
)
def test_email(spark, given, want):
    assert one(spark, given, extract.email) == want


@pytest.mark.parametrize(("given", "want"), [("9779812345678", "+977 9779812345678"), ("call 9812345678", "+977 9812345678"), ("01 2345678", "01 2345678"), ("011234567", "+011234567"), ("(555) 123-4567", "555) 123-4567"), ("n/a", None)])
def test_phone(spark, given, want):
    assert one(spark, given, extract.phone) == want


def test_links(spark):
    got = one(spark, "see https://a.b/c, www.d.e and LinkedIn.com/in/jo or github.com/jo", extract.links)
    assert got.urls == ["https://a.b/c", "www.d.e"] and got.linkedin == "https://LinkedIn.com/in/jo" and got.github == "https://github.com/jo"


@pytest.mark.parametrize(
    ("given", "want"),
    [("Dr. Sarah Johnson\nx", "Dr. Sarah Johnson"), ("Stella Adams\nJohn Roe", "John Roe"), ("Python Expert\nJane Roe", "Jane Roe"), ("one\ntwo", None), ("** Ann Lee", "Ann Lee")],
)
def test_name(spark, given, want):
    assert one(spark, given, lambda c: extract.name(c, list(SKILLS))) == want


@pytest.mark.parametrize(
    ("given", "want"), [("Address: 12 Hill St, York", "12 Hill St, York"), ("Paris University\nBased near Berlin, Germany", "Berlin, Germany"), ("Katesandu", "Kathmandu"), ("nowhere", None)]
)
def test_location(spark, given, want):
    assert one(spark, given, extract.location) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("C++ developer", ["C"]), ("3D Modeling and e-learning", ["3D Modeling", "E-Learning"]), ("golang, Go", ["Go"]), ("excellent", []), ("Self-motivated; machine learning", ["Machine Learning", "Self-Motivated"])],
)
def test_skills(spark, given, want):
    assert one(spark, given, lambda c: extract.skills(c, SKILLS)) == want


def test_education(spark):
    given = "Education\nB.Sc. in Physics\nBachelor of Arts in History, 2010. Honours\nMBA in Finance, Oakdale University\nNCEA Level 3 with Merit at Hill College\nAvondale Polytechnic, Leeds\nSkills\nx"
    got = one(spark, given, lambda c: credentials.education(c, extract.section(c, "education")))
    assert got.degrees == ["Bachelor of Arts in History, 2010", "MBA in Finance, Oakdale University", "NCEA Level 3 with Merit — Hill College"]
    assert "Avondale Polytechnic, Leeds" in got.universities[-1] and got.education_section.startswith("B.Sc.")


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ("Data Analyst | Acme Works | Jan 2020 - Dec 2021", [("Data Analyst", "Acme Works", "Jan 2020 - Dec 2021")]),
        ("Acme Works | Data Analyst", [("Data Analyst", "Acme Works", "")]),
        ("Software Engineer at Blue Works", [("Software Engineer", "Blue Works", "")]),
        ("Software Engineer at Blue Works\nJan 2019 - Present", [("Software Engineer", "Blue Works", "")]),
        ("Marketing Manager\nRed Hill Group\n2015 - 2018", [("Marketing Manager", "Red Hill Group", "2015 - 2018")]),
        ("Marketing Manager 2015 - 2018\nRed hill Group", [("Marketing Manager", "Red hill Group", "2015 - 2018")]),
        ("Marketing Manager 2015 - 2018\nRed Hill Group", [("Marketing Manager", "", "2015 - 2018")]),
        ("Graphic Designer\nGreen Studio\nsome plain words about nothing much at all here", [("Graphic Designer", "Green Studio", "")]),
        ("Green studio\nGraphic Designer", [("Graphic Designer", "Green studio", "")]),
        ("Green Studio\nGraphic Designer", [("Graphic Designer", "", "")]),
        ("Graphic Designer\nGreen Studio 2016", [("Graphic Designer", "Green Studio 2016", "2016")]),
        ("Chef | Oak House\nchef | oak house", [("Chef", "Oak House", "")]),
    ],
)
def test_experience_layouts(lines, want):
    assert [tuple(e) for e in experience.entries_of(lines, frozenset())] == want


def test_experience_ignores_schools_and_verbs():
    assert experience.entries_of("Managed the Sales Manager\nBachelor of Design Coordinator\nManager, Hill Street 12", frozenset()) == []
    assert experience.entries_of(None, frozenset()) == experience.entries_of(" \n", frozenset()) == []


def test_experience_is_read_from_its_section_or_from_all_but_education(spark):
    f = lambda c: experience.outline(c, ["x"])["work"]
    assert one(spark, "Sales Manager\nWork Experience\nChef | Oak House", f).job_titles == ["Chef"]
    assert one(spark, "Chef | Oak House\nEducation\nTeacher | Hill House\nplain words of school", f).organizations == ["Oak House"]


@pytest.mark.parametrize("given", ["a\nSkills\nx\n\n\n\nEXPERIENCE\ny\tz\nEducation:\n", "Work History\na\nb\nEducation\nc", "Languages\n", "", None, " \n", "my projects\nExperience:\nthe skills"])
def test_both_ways_to_sections_agree(spark, given):
    both = one(spark, given, lambda c: F.struct(experience.outline(F.coalesce(c, F.lit(""))).alias("o"), text.clean_for_extraction(c).alias("t")))
    again = one(spark, both.t, lambda c: F.struct(*(extract.section(c, k).alias(k) for k in experience.SECTIONS)))
    assert both.o.clean == both.t and [both.o[k] for k in experience.SECTIONS] == list(again)


def test_certifications_and_languages(spark):
    certificates = lambda t: one(spark, t, lambda c: credentials.certifications(c, extract.section(c, "certifications")))
    spoken = lambda t: one(spark, t, lambda c: credentials.languages(extract.section(c, "languages")))
    assert certificates("Certifications\nAWS Certified Developer\nfoo\nGoogle Analytics Certification 2019") == ["AWS Certified Developer"]  # the last line reads as a header
    assert spoken("Languages\nEnglish Native, nepal") == ["English", "Nepali"]
    assert spoken("Languages\nKlingon, hindl\nteamwork") == ["Hindi"]
    assert spoken("English") == []


def test_record_of_blank_and_null_text(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "Jane Roe\njane@roe.org\nSkills\nPython and SQL")], "id long, resume_str string")
    rows = {r.id: r for r in analyze.records(df, SKILLS).collect()}
    assert rows[1].error == rows[2].error == "Empty resume text provided." and rows[1].skills == [] and rows[1].name is None
    assert rows[3].error is None and rows[3].skills == ["Python", "SQL"] and rows[3].email == "jane@roe.org"


def test_caps_and_partitions(spark):
    given = "Jane Roe\nLanguages\n" + ", ".join(sorted(list(lexicon.LANGUAGES)[:30]))
    df = spark.createDataFrame([(k, given) for k in range(20)], "id long, resume_str string")
    a = analyze.records(df.repartition(1), SKILLS).orderBy("id").collect()
    b = analyze.records(df.repartition(8), SKILLS).orderBy("id").collect()
    assert a == b and all(len(r.languages) <= 10 for r in a)


def test_a_recogniser_fills_what_rules_leave(spark):
    said = {"PERSON": "Ann Lee", "PLACE": "Leeds", "FIRM": "Acme"}
    recogniser = lambda text, kind: F.when(text != "", F.lit(said[kind]))
    df = spark.createDataFrame([(1, "plain words only\nWork Experience\nsomething was done")], "id long, resume_str string")
    r = analyze.records(df, SKILLS, recogniser=recogniser).first()
    assert (r.name, r.location, r.organizations) == ("Ann Lee", "Leeds", ["Acme"])
    r = analyze.records(df, SKILLS).first()
    assert (r.name, r.location, r.organizations) == (None, None, [])


def test_the_gate_stops_before_extraction(spark):
    good = "Jane Roe\njane@roe.org\nSkills\nPython and data tools for the kitchen manager who has profile and summary experience of many years in teams"
    df = spark.createDataFrame([(1, good, "HR"), (2, "x1 y2 jane@roe.org", "HR"), (3, None, None)], "id long, resume_str string, category string")
    rows = {r.id: r for r in analyze.analyzed(df, SKILLS).collect()}
    assert rows[1].gate_status == "ok" and rows[1].email == "jane@roe.org" and rows[1].recommendation.category == "HR"
    assert rows[2].gate_status == "low_quality" and rows[2].email is None and rows[2].recommendation is None
    assert rows[3].gate_status == "blank"


def test_export_is_one_document_a_row(spark):
    import json

    good = "Jane Roe\njane@roe.org\nSkills\nPython and data tools for the kitchen manager who has profile and summary experience of many years in teams"
    df = spark.createDataFrame([(1, good, "HR", "file"), (2, "x1", "HR", "paste")], "id long, resume_str string, category string, input_source string")

    def predict(docs, column):
        top = F.array(F.struct(F.lit("CHEF").alias("label"), F.lit(0.98765432).alias("prob")))
        return docs.select("*", F.lit("CHEF").alias("predicted_category"), F.lit(0.98765432).alias("confidence"), top.alias("top_3"), top.alias("other_categories"), F.lit(None).cast("string").alias("prediction_error"))

    rows = {r.id: json.loads(r.json) for r in analyze.export(analyze.analyzed(df, SKILLS, source="input_source", predict=predict)).collect()}
    assert (rows[1]["predicted_category"], rows[1]["confidence_score"], rows[1]["input_source"]) == ("CHEF", 0.9877, "file")
    assert rows[1]["candidate_profile"]["email"] == "jane@roe.org" and rows[1]["recommendations"]["category"] == "CHEF"
    assert rows[2] == {"gate_status": "low_quality", "input_source": "paste"}
    plain = {r.id: json.loads(r.json) for r in analyze.export(analyze.analyzed(df, SKILLS)).collect()}
    assert plain[1]["predicted_category"] == "HR" and "input_source" not in plain[1]
