"""Work experience: lines are read once into what they can serve as, then layouts are laid over them in turn.

A line can serve as a title, as a company or as a period. A ``Layout`` says which of these an anchor line must show and
at which distances from it the other parts may stand. A line serves one entry only, so the order of layouts and lines
matters; that is why this one field is an Arrow-batched function and no expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivane.functions import lexicon as lx
from scrivane.functions.extract import header
from scrivane.functions.text import lightly_cleaned

KIND = "struct<experience_entries:array<struct<title:string,company:string,period:string>>,job_titles:array<string>,organizations:array<string>>"
MOST = 8

_PERIOD = re.compile(lx.PERIOD, re.I)
_YEAR = re.compile(lx.YEAR)
_TITLE = re.compile(lx.JOB_TITLE, re.I)
_AT = re.compile(lx.AT_COMPANY, re.I)
_LETTERS = re.compile(r"\b[a-zA-Z]+\b")
_LEAD = re.compile(r"^[\s•\-*+>◆▪►●\d.)]+")
_LONE_LETTER = re.compile(r"[\s,|-]+[a-zA-Z]$")
_EDGES = "|-–, ()[]"
_UNREADABLE = re.compile("|".join(lx.SCAN_NOISE), re.I)
_FRAGMENT = re.compile("^" + lx.FRAGMENT_STARTS, re.I)
_DATED_NAME = re.compile(r"^\w[\w\s]+ \d{4}\s*[-–]\s*\d{4}$")

#: What makes a line unfit for any part of an entry; each is one pattern over the line, or over it without its lead.
_UNFIT_START = re.compile(r"[+\-*•–—>▪►■]")
_UNFIT = re.compile(r"@|\b(?:http|www|\.com|\.org|\.net)\b|^\+?\d[\d\s\-()]{7,}\d$|^(?:" + "|".join(lx.ACTION_VERBS) + r")\b", re.I)


def without_lead(text: str) -> str:
    return " ".join(_LEAD.sub("", text).split())


def academic(text: str) -> bool:
    """About school rather than work: by its first word, or by any of the strong ones."""
    first = text.split(None, 1)[:1]
    return bool(first) and (first[0].lower() in lx.ACADEMIC_WORDS or not lx.STRONG_ACADEMIC_WORDS.isdisjoint(_LETTERS.findall(text.lower())))


class Piece:
    """A line, or a part of one, and what it can serve as."""

    def __init__(self, text: str, skills: frozenset[str]):
        self.text = text.strip()
        self.clean = without_lead(self.text)
        self.skills = skills

    @cached_property
    def fit(self) -> bool:
        if len(self.text) < 2 or _UNFIT_START.match(self.text) or _UNFIT.search(self.clean):
            return False
        low = self.clean.lower()
        if low in lx.SECTION_WORDS or low in self.skills or academic(self.clean) or academic(self.text):
            return False
        return not (any(map(str.isdecimal, low)) and not lx.ADDRESS_WORDS.isdisjoint(_LETTERS.findall(low)))

    @cached_property
    def period(self) -> str:
        m = _PERIOD.search(self.text)
        return m.group(1).strip() if m else ""

    @cached_property
    def title(self) -> str:
        """The job title in it: all of it, if it has four words at most."""
        again = Piece(self.clean, self.skills)
        m = _TITLE.search(self.clean) if again.clean and again.fit else None
        named = (again.clean if len(again.clean.split()) <= 4 else m.group(0).strip()) if m else ""
        return "" if not m or academic(m.group(0)) or academic(named) else named

    def company(self, most_words: int | None = None) -> str:
        ok = len(self.clean) >= 3 and Piece(self.clean, self.skills).fit
        return self.clean if ok and (most_words is None or len(self.clean.split()) <= most_words) else ""

    def undated(self, lead_first: bool) -> "Piece":
        """The piece without its period; its lead goes before or after, which differs where the period leads."""
        text = self.clean if lead_first else self.text
        return Piece(_PERIOD.sub("", text).strip(_EDGES), self.skills)


class Entry(NamedTuple):
    title: str
    company: str
    period: str


def split_line(line: Piece) -> Entry | None:
    """Title | company | period."""
    parts = [Piece(without_lead(p), line.skills) for p in re.split(r"[|•·]", line.text) if p.strip()]
    if len(parts) < 2:
        return None
    periods = [p.period for p in parts if p.period]
    rest = [p.undated(True) if p.period else p for p in parts]
    at = next((k for k, p in enumerate(rest) if p.title), None)
    if at is None:
        return None
    firms = (p.text for k, p in enumerate(rest) if k != at and len(p.text) >= 3 and p.fit)
    return Entry(rest[at].title, next(firms, ""), periods[-1] if periods else "")


def title_at_company(line: Piece) -> Entry | None:
    """Title at company, perhaps with a date behind."""
    m = _AT.match(line.text)
    if not m:
        return None
    title, company = Piece(m.group(1), line.skills).title, Piece(m.group(2), line.skills)
    if not title or not company.fit:
        return None
    behind = m.group(3) or ""
    dated = _PERIOD.search(behind) or _YEAR.search(behind)
    return Entry(title, company.text, line.period or (dated.group(0).strip() if dated else ""))


class Layout(NamedTuple):
    """Where the parts of an entry may stand, as distances from an anchor line, in order of preference."""

    anchor: str
    title: tuple[int, ...]
    company: tuple[int, ...]
    period: tuple[int, ...]


AROUND_PERIOD = Layout("period", (0, -3, -2, -1, 1, 2), (0, -3, -2, -1, 1, 2), (0,))
AROUND_TITLE = Layout("title", (0,), (1, -1, 2), (-3, -2, -1, 0, 1, 2, 3))


class Sheet:
    """The lines of one resume's experience and the entries read from them."""

    def __init__(self, text: str, skills: frozenset[str]):
        self.lines = [Piece(x, skills) for x in text.split("\n") if x.strip()]
        self.free = {k for k, line in enumerate(self.lines) if line.fit}
        self.entries: list[Entry] = []

    def near(self, k: int, distances: Iterable[int]) -> Iterator[int]:
        return (k + d for d in distances if k + d in self.free)

    def take(self, entry: Entry, lines: Iterable[int]) -> None:
        self.entries.append(entry)
        self.free.difference_update(lines)

    def inline(self, form) -> None:
        for k in sorted(self.free):
            entry = form(self.lines[k])
            if entry:
                self.take(entry, [k])

    def around_period(self, layout: Layout) -> None:
        for k in range(len(self.lines)):
            if k not in self.free or not self.lines[k].period:
                continue
            own = self.lines[k].undated(False)
            pieces = [(j, own if j == k else self.lines[j]) for j in self.near(k, layout.title) if j != k or own.company()]
            titled = next(((j, p.title) for j, p in pieces if p.title), None)
            if titled:
                firm = next(((j, p.company(6)) for j, p in pieces if j != titled[0] and p.company(6)), (k, ""))
                self.take(Entry(titled[1], firm[1], self.lines[k].period), {k, titled[0], firm[0]})

    def around_title(self, layout: Layout) -> None:
        for k in range(len(self.lines)):
            if k not in self.free or not self.lines[k].title:
                continue
            company, at, period = self.neighbour_company(k, layout)
            taken = {k, at}
            if not period:
                dated = next(((j, d) for j in self.near(k, layout.period) if (d := self.date(self.lines[j].text))), None)
                taken, period = (taken | {dated[0]}, dated[1]) if dated else (taken, "")
            self.take(Entry(self.lines[k].title, _LONE_LETTER.sub("", company).strip().rstrip(" ,|-"), period), taken)

    @staticmethod
    def date(text: str) -> str:
        m = _PERIOD.search(text) or _YEAR.search(text)
        return m.group(0).strip() if m else ""

    def neighbour_company(self, k: int, layout: Layout) -> tuple[str, int, str]:
        """(company, its line, a date met on the way): the first neighbour that is no title itself."""
        period = ""
        for j in self.near(k, layout.company):
            name = self.lines[j].clean
            if not period and (period := self.date(name)):
                name = _PERIOD.sub("", name).strip(_EDGES)
            if len(name) >= 3 and len(name.split()) <= 6 and not Piece(name, self.lines[j].skills).title:
                return name, j, period
        return "", k, period

    def read(self) -> list[Entry]:
        for form in (split_line, title_at_company):
            self.inline(form)
        self.around_period(AROUND_PERIOD)
        self.around_title(AROUND_TITLE)
        return self.entries


def readable(title: str) -> bool:
    """No scanning noise, no fragment of a sentence, nothing about school."""
    parts = title.split()
    if not parts or sum(map(str.isalpha, title)) < 0.45 * len(title) or max(map(len, parts)) <= 2:
        return False
    small = len(parts) == 1 and len(title) < 10 and not title[0].isupper()
    return not (small or _UNREADABLE.search(title) or _FRAGMENT.match(title) or academic(title))


def candidate(source: str) -> str:
    """The first of five lines that could be the person's own name, in capitals."""
    for line in source.split("\n")[:5]:
        parts = line.split()
        if 2 <= len(parts) <= 4 and all(p[0].isupper() for p in parts if p[0].isalpha()):
            return line.strip().upper()
    return ""


def entries_of(source: str | None, skills: frozenset[str]) -> list[Entry]:
    """Entries of an experience section (or of the text that stands for it), each title and company once."""
    if not source or not source.strip():
        return []
    person = candidate(source)
    out: dict[tuple[str, str], Entry] = {}
    for e in Sheet(source, skills).read():
        company = _LONE_LETTER.sub("", e.company.strip()).strip("|-–, ")
        key = (e.title.lower(), company.lower())  # of the company before it may be emptied
        if readable(e.title) and key not in out:
            own = (person and company.upper() == person) or _DATED_NAME.match(company)
            out[key] = Entry(e.title, "" if own else company, e.period)
    return list(out.values())


# --- one Arrow pass a text ----------------------------------------------------------------------------------------------

SECTIONS = ("education", "experience", "certifications", "languages")
_HEADED = re.compile("(?i)\n(?=" + header(lx.SECTION_HEADERS).replace(r"\z", r"\Z") + ")")
_OWN = {k: re.compile("(?i)" + header([k]).replace(r"\z", r"\Z")) for k in SECTIONS}


def sections_of(clean: str) -> dict[str, str]:
    """The sections that fields read, as ``extract.section_of`` has them."""
    pieces = _HEADED.split("\n" + clean)[1:]
    first = {k: next((p for p in pieces if own.match(p)), "") for k, own in _OWN.items()}
    return {k: p.partition("\n")[2].strip() for k, p in first.items()}


def source_of(clean: str, parts: dict[str, str]) -> str:
    """The experience section; without one the text less its education section, if that is longer than ten signs."""
    return parts["experience"] or (clean.replace(parts["education"], "") if len(parts["education"]) > 10 else clean)


def outline(text: Column, skills: Iterable[str] | None = None) -> Column:
    """Struct (clean, the sections, work) of a text without mark-up: light cleaning, sections and experience in one pass.

    The folding needs Python anyway, and Spark would evaluate whatever lies between two Python functions once for every
    use; so all that must be done there is done at once. Without ``skills`` experience is left out.
    """
    known = None if skills is None else frozenset(s.lower() for s in skills)
    kind = "struct<clean:string," + "".join(f"{k}:string," for k in SECTIONS) + f"work:{KIND}>"

    @F.pandas_udf(kind)
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            clean = lightly_cleaned(text or "")
            parts = sections_of(clean)
            found = [] if known is None else entries_of(source_of(clean, parts), known)
            work = {"experience_entries": [e._asdict() for e in found[:MOST]], "job_titles": [e.title for e in found if e.title][:MOST], "organizations": [e.company for e in found if e.company][:MOST]}
            rows.append((clean, *(parts[k] for k in SECTIONS), work))
        return pd.DataFrame(rows, columns=["clean", *SECTIONS, "work"])

    return read(text)
