import pytest

from scrivane.llm import pii


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(212) 555-0100 / (212) 555-0199", [("phone", "2125550100"), ("phone", "2125550199")]),
        ("+44 7700 900329 / +44 7700 900330", [("phone", "447700900329"), ("phone", "447700900330")]),
        ("SSN 965-86-6502 (212) 555-0100", [("id_number", "965866502"), ("phone", "2125550100")]),
        ("SSN 965-86-6502 / 965-86-6503", [("id_number", "965866502"), ("id_number", "965866503")]),
        ("Tel: 212-555-0100 212-555-0199 212-555-0177", [("phone", "2125550100"), ("phone", "2125550199"), ("phone", "2125550177")]),
        ("Phone +44 7700 900329 212-555-0100", [("phone", "447700900329"), ("phone", "2125550100")]),
    ],
)
def test_all_numbers_of_a_run(text, want):
    assert [(kind, pii.value_of(item)) for _, _, kind, item in pii.items(text, False)] == want


def test_all_numbers_of_a_run_are_redacted():
    assert pii.redact("SSN 965-86-6502 (212) 555-0100 / (212) 555-0199.", False) == "SSN [ID_NUMBER] [PHONE] / [PHONE]."
