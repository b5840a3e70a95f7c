import pytest

from scrivane.llm import pii

REST = " Kept the ledgers of two sites in order, ran weekly reviews and trained new colleagues."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Reported to Thandi Mokoena until the merger." + REST, ["Thandi Mokoena"]), ("My supervisor Lwazi Dube signed the plan." + REST, ["Lwazi Dube"]), ("Reference: Sipho van der Nkosi." + REST, ["Sipho van der Nkosi"]),
        ("For details contact Naledi Khumalo." + REST, ["Naledi Khumalo"]), ("Thandi Mokoena\nSales Manager\n" + REST, ["Thandi Mokoena"]), ("Thandi Mokoena | +44 7700 900329\n" + REST, ["Thandi Mokoena"]),
        ("REFERENCES\nLwazi Dube, Head of Logistics\n" + REST, ["Lwazi Dube"]),
        ("Reported to Regional Manager." + REST, []), ("Contact Human Resources." + REST, []), ("Supervisor Customer Service." + REST, []), ("Reported to Ledgers Reviews." + REST, []), ("Port Thorpe\nSales Manager\n" + REST, []),
        ("Key Skills:\nContract Review, Lead Generation, Negotiation\n" + REST, []), ("Reports to Brightfold Group." + REST, []),
    ],
)
def test_unlisted_names_after_cues_and_at_line_heads(text, want):
    assert [item for _, _, kind, item in pii.items(text, False) if kind == "name"] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Deputised for Thandiwe Lwazi Drayolini during parental leave." + REST, ["Thandiwe Lwazi Drayolini"]), ("Worked closely with Oisin Kessaldo and the finance desk." + REST, ["Oisin Kessaldo"]),
        ("Reported to Linduadi, Eilidh until the merger." + REST, ["Linduadi, Eilidh"]), ("REFEREES\nFarruvane, Oisin, Audit Associate, Vantor Holdings\n" + REST, ["Farruvane, Oisin"]),
        ("Name: Tariq E. Marbovane\nSYSTEMS ADMINISTRATOR\n" + REST, ["Tariq E. Marbovane"]), ("TARIQ LORRIAK\nPROCESS CONSULTANT\n" + REST, ["TARIQ LORRIAK"]), ("Resume of Nkechi Eilidh Mundovic\nBuyer\n" + REST, ["Nkechi Eilidh Mundovic"]),
        ("Nkechi Yarrberg, Mechanical Engineer, Northlight Motors, nkechi.yarrberg+jobs@post.test\n" + REST, ["Nkechi Yarrberg"]),
        ("Training\nFirst Aid Certificate (2018)\n" + REST, []), ("Key Skills\nExcel, CRM, Lead Generation\n" + REST, []), ("Worked with suppliers and Brightfold Group on plans." + REST, []), ("Reported to Night Ledgers until 2019." + REST, []),
    ],
)
def test_names_by_context(text, want):
    assert [item for _, _, kind, item in pii.items(text, False) if kind == "name"] == want
