import pytest

from scrivane.llm import pii


def of(text, is_html=False):
    return {(kind, pii.value_of(item)) for _, _, kind, item in pii.items(text, is_html)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Email: jo.doe+x@my-mail.test", {("email", "jodoexmymailtest")}),
        ("jo_doe [at] inbox [dot] example [dot] org", {("email", "jodoeinboxexampleorg")}),
        ("mail jo AT post DOT test", {("email", "jopost" + "test")}),
        ("jo(at)post(dot)test", {("email", "joposttest")}),
        ("jo @ post.test and jo©mail.example", {("email", "joposttest"), ("email", "jomailexample")}),
        ("Grew orders @ 20% and ran the info@ mailbox", set()),
        ("Posted as @brookhaven; installed @wyck/forms v6.7", set()),
        ("Tel: +44 (0)7700 900 329 ext. 12", {("phone", "4407700900329")}),
        ("cell 691.697.0249 | Milton", {("phone", "6916970249")}),
        ("Phone 1 - 893 - 593 - 1591", {("phone", "18935931591")}),
        ("(691) 682-3485", {("phone", "6916823485")}),
        ("Cleared order 892-468-6116 and voucher 695.849.2490", set()),
        ("Closed purchase order 6761-246-8965 and batch no. 0444 942 5043", set()),
        ("Handled accounts 2011 - 2019 worth 9 229 737 per year", set()),
        ("Release 2.3.796.3162 shipped with part B66509", set()),
        ("SS# 965-86-6502, clean driving record", {("id_number", "965866502")}),
        ("My NINO is QQ 94 34 90 A and can be shown", {("id_number", "qq943490a")}),
        ("Passport: XQ4600272", {("id_number", "xq4600272")}),
        ("Driving licence no. K616-7553-5086", {("id_number", "k61675535086")}),
        ("Citizenship certificate 21-03-75-02212", {("id_number", "21037502212")}),
        ("Date of birth 21/8/1995, ID card number: 5919 4318 5678", {("id_number", "591943185678")}),
        ("Tracked 07192352 units under item code 242-51-1490X", set()),
        ("Logged asset tag 975-12-3815 and kit 9111 8951 7423", set()),
        ("Address: Flat 29, 1706 Beacon Dr., Lakethorpe KS 00041", {("address", "1706beacondr")}),
        ("3232 E. Weir Rd, Westmere", {("address", "3232eweirrd")}),
        ("131B Beacon Terrace", {("address", "131bbeaconterrace")}),
        ("4625 County Road 32", {("address", "4625countyroad32")}),
        ("Calle Almendra 136, Westcorran", {("address", "callealmendra136")}),
        ("Lindenhofweg 48", {("address", "lindenhofweg48")}),
        ("Supervised 13 Road crews and 15 Court filings a week", set()),
        ("2013 Summer Lane Studios - Recruiter", set()),
        ("covering 37 locations", set()),
        ("Name: Rudnell, Rosa", {("name", "rudnellrosa")}),
        ("Dr. P. Vennvane", {("name", "pvennvane")}),
        ("Resume of Karim Thornuiak", {("name", "karimthornuiak")}),
        ("Reported to Will de Orraquist until the merger.", {("name", "willdeorraquist")}),
        ("Victor El Zelington", {("name", "victorelzelington")}),
        ("MILAN ORRANELL", {("name", "milanorranell")}),
        ("Gostwick, Hassan, PR Executive, Brightfold Group", {("name", "gostwickhassan")}),
        ("Elena R. Mundadi-Vane, Sous Chef, Orvale", {("name", "elenarmundadivane")}),
        ("Grace Period Letters, Chase Collections", set()),
        ("Faith Outreach", set()),
        ("Sales Lead at Grant Valley Clinic", set()),
        ("Company Name Jan 2020", set()),
        (None, set()),
        ("  \n", set()),
    ],
)
def test_items(text, want):
    assert of(text) == want


def test_html_reads_attributes_comments_entities_and_split_items():
    html = '<p><b>Sunita</b> <span>Kwame Haskenko</span>, Communications Manager</p><a href="mailto:a@b.example">write</a><!-- converted for z@y.test --><p>mail c&#64;d.example&nbsp;</p>'
    assert of(html, True) == {("name", "sunitakwamehaskenko"), ("email", "abexample"), ("email", "zytest"), ("email", "cdexample")}


def test_redaction_keeps_the_rest():
    assert pii.redact("Tel: 691-697-0249, ask Dr. Rosa Vane", False) == "Tel: [PHONE], ask Dr. [NAME]"
    assert pii.redact('<a href="mailto:a@b.example"><b>a@</b>b.example</a> x', True) == '<a href="mailto:[EMAIL]"><b>[EMAIL]</b></a> x'
    assert pii.redact(None, False) is None and pii.redact("", True) == ""


def test_mark_up_within_items_stays():
    assert pii.redact("<p>Rosa <i>Vane</i>, <b>Sales</b> Manager &#97;@b.example</p>", True) == "<p>[NAME]<i></i>, <b>Sales</b> Manager [EMAIL]</p>"
    assert pii.redact('<input value="a@b.c">', True) == '<input value="a@b.co">'.replace("a@b.co", "a@b.c") and pii.redact('<input value="a@b.co">', True) == '<input value="[EMAIL]">'


def test_letter_case_is_judged_by_part_and_over_whole_texts():
    plain = "Kept the ledgers of two sites in order and ran weekly reviews. " * 9
    assert ("name", "johnsmith") in of(plain + "\nnAME: jOHN sMITH\nsALES mANAGER\n" + plain)
    assert ("name", "johnsmith") in of("nAME: jOHN sMITH\n" + plain)
    shouted = "KEPT THE LEDGERS OF TWO SITES IN ORDER. " * 9
    assert of(shouted + plain * 9 + "Reported to Thandi Mokoena until the merger.") == {("name", "thandimokoena")}


def test_an_account_holds_no_other_item():
    assert of("Pay to DE89 3704 0044 0532 0130 00, tel. 691-697-0249") == {("phone", "6916970249")}


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.redact("card 4111 1111 1111 1111", False) == "card [CARD]" and pii.redact("to GB82 WEST 1234 5698 7654 32.", False) == "to [BANK_ACCOUNT]."


def test_tables(spark):
    kind = "id long, resume_str string, resume_html string, category string, field string, value string, kind string"
    rows = [(1, "a@b.example a@b.example", None, "X", "f", "v", "k"), (1, "a@b.example a@b.example", None, "X", "f", "v", "k"), (2, None, "<p>a@b.example</p>", None, "f", "v", "k"), (None, "c@d.example", "", "X", "f", "v", "k"), (3, "x " * 200_000 + "e@f.example", "", "", "", "", "")]
    df = spark.createDataFrame(rows, kind)
    got = sorted(tuple(r) for r in pii.found(df).collect())
    assert got == [(1, "resume_str", "email", "abexample"), (2, "resume_html", "email", "abexample"), (3, "resume_str", "email", "efexample")]
    done = pii.redacted(df)
    assert done.schema == df.schema and done.count() == 5 and done.where("id = 1").first().resume_str == "[EMAIL] [EMAIL]"
    assert pii.found(df.where("false")).collect() == []
