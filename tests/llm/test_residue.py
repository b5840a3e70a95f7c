import pytest

from scrivane.llm import residue

LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."
REAL = "I've known this colleague for 9 years and can speak for their records, deliveries and vehicles. Case {}."


def kinds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.kind for r in residue.residue(df).collect()}


@pytest.mark.parametrize("rows", [1, 5, 13])
def test_filler_in_a_table_of_few_rows(spark, rows):
    assert kinds(spark, [LOREM] + [REAL.format(k) for k in range(rows - 1)]) == {0: "filler"}


def test_filler_that_a_third_of_the_rows_hold(spark):
    assert kinds(spark, [LOREM] * 20 + [REAL.format(k) for k in range(40)]) == dict.fromkeys(range(20), "filler")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Este es un texto de relleno sin sentido. " * 3, "filler"), ("Filler paragraph for layout purposes only. " * 3, "filler"), (REAL + " Filler paragraph for layout purposes only.", "filler"), ("Texte de remplissage.\n" + REAL, "filler"),
        (REAL + "\nType something here\n" + REAL, "filler"), ("Hier steht ein Blindtext. " + REAL, "filler"), ("Profil: texto de ejemplo.\n" + REAL, "filler"), (REAL + " Dummy text.", "filler"),
        (REAL + " Replaced the dummy text of two brochures with copy.", None), ("Sustituí el texto de relleno por el definitivo. " + REAL, None), ("Taught pupils how placeholder text and dummy copy are used. " + REAL, None), ("Remplacé le texte de remplissage. " + REAL, None),
    ],
)
def test_short_filler_wordings(text, want):
    assert residue.label(text, residue.background()) == want


def test_page_that_a_third_of_the_rows_are(spark):
    page = "Skip to content\nError 404 page missing. The profile at this address has moved.\nBack to top"
    assert kinds(spark, [page] * 20 + [REAL.format(k) for k in range(40)]) == dict.fromkeys(range(20), "page")


@pytest.mark.parametrize("text", ["Access denied.", "Something went wrong on our side.\nBack to top", "Accès refusé.", "Zugriff verweigert. Bitte melden Sie sich erneut an.", "Your session has timed out."])
def test_single_page_wordings(text):
    assert residue.label(text, residue.background()) == "page"
    assert residue.label(f"{REAL} {text}", residue.background()) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dear {{ recipient.salutation_line }}, thank you.", "field"), ("Dear [Hiring Manager, insert your company name here and enter the date, the city and the reference number], thank you. " + REAL, "field"),
        ("Signed «Unterschrift» " + REAL, "field"), ("Kind regards from (add your phone here). " + REAL, "field"), (REAL + " [see appendix for the list of projects]", None), (REAL + " (position of the valves)", None), (REAL + " <b>bold</b>", None),
    ],
)
def test_fields_are_found_by_retrieved_exemplars(text, want):
    assert residue.label(text, residue.background()) == want


#: Wordings that are no exemplars.
HELD_OUT = {
    "page": [
        "404. That's an error. The requested URL /jobs was not found on this server. That's all we know.", "Page not found. The page you requested does not exist or has been moved.", "500 Internal Server Error. An error occurred, please try again later.",
        "503 Service Unavailable. The server is temporarily unavailable, please try again later.", "You need to enable JavaScript to view this page.", "This website requires JavaScript. Please enable JavaScript in your browser and reload the page.",
        "Access denied. You do not have permission to view this page.", "Your session has expired. Please sign in again.", "403 Forbidden. You don't have permission to access this page on this server.", "Error 502 Bad gateway",
        "Seite nicht gefunden. Die Seite existiert nicht mehr.", "La page demandée n'existe plus.", "Acceso denegado. No tiene permiso.", "Whoops, looks like something broke at our end.", "Hmm, nothing lives at this web address any more.",
    ],
    "field": ["Dear {{contact.given}},", "Hello ${user.displayName},", "Dear [Company Name],", "at <<employer>>", "to %%X%% ##ROLE##", "Dear *|FNAME|*,", "Yours, [Insert Name]"],
    "filler": ["Lorem ipsum dolor sit amet, sed do eiusmod tempor.", "Insert your text here.", "This is placeholder text.", "Dies ist ein Blindtext.", "Quack quack quack quack quack quack."],
}


def test_recall_on_wordings_held_out():
    """What is found of wordings that are not listed; README names the shares."""
    index = residue.background()
    found = {want: sum(residue.label(t, index) == want for t in texts) for want, texts in HELD_OUT.items()}
    print(found)
    assert found["page"] >= 10 and found["field"] == 7 and found["filler"] >= 3
