"""Problem 1: personal items in free text and HTML, found and replaced by typed placeholders.

Method. Regular expressions propose spans, anchored at the few signs that can begin an item (at-signs and their disguises,
digits, runs of capitalised words after cues and labels or at the head of a line). Checksum validators decide about
numbers: a bank account that checks (mod-97) holds no other item, a number that checks as a payment card (Luhn) is no phone. Words near a span adjust its score: labels raise it, words of
trade (order, invoice, batch, part ...) and of firms, schools and streets lower it; a span is kept from ``KEEP`` on.

HTML is read as its text - tags dropped, entities decoded - plus attribute values and comments; every span keeps its
place in the original, so that replacing it leaves the mark-up as it was.

Defined cases: null fields have no items and stay null; blank texts have none; null ids take no part in ``found``;
repeated rows and repeated items of a field give one row; texts are read whole at any length; other columns are
ignored by ``found`` and kept by ``redacted``.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.runtime import ship, spread

KEEP = 1.0

# --- readable views with places -------------------------------------------------------------------------------------

_MARK = re.compile(r"<!--(.*?)-->|<(?:style|script)\b[^>]*>.*?</(?:style|script)\s*>|<(/?[A-Za-z!][\w:-]*)([^<>]*)>|&#?\w{1,31};", re.S | re.I)
_ATTRIBUTE = re.compile(r"=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_INLINE = {"b", "i", "u", "a", "em", "strong", "span", "font", "small", "big", "code", "mark", "abbr", "tt", "sub", "sup", "wbr", "s", "q", "cite", "label"}
_DROPPED = re.compile("[​‌‍⁠﻿­]+")
_DROPPED_OR_DOUBLE = re.compile(r"(?<=\S)[ \xa0](?=[ \xa0][^\s])|" + _DROPPED.pattern)
_ALIKE = {c: " " for c in "\xa0\u2002\u2003\u2007\u2008\u2009\u200a\u202f\u3000\t"} | {"’": "'", "ʼ": "'", "＠": "@"}


class View:
    """A readable text and, for each of its pieces, where it stands in the original."""

    def __init__(self):
        self.parts: list[str] = []
        self.at: list[int] = []
        self.origin: list[tuple[int, bool]] = []
        self.width: list[int] = []
        self.length = 0
        self.text = ""

    def add(self, text: str, origin: int, verbatim: bool = True, width: int = 0) -> None:
        """``width``: signs that an entity takes in the original; a break that stands for a tag has none."""
        if text:
            self.width.append(width)
            self.at.append(self.length)
            self.origin.append((origin, verbatim))
            self.parts.append(text)
            self.length += len(text)

    def close(self) -> "View":
        self.text = "".join(self.parts)
        for sign, plain in _ALIKE.items():
            if sign in self.text:
                self.text = self.text.replace(sign, plain)
        return self

    def place(self, position: int) -> int:
        k = bisect.bisect_right(self.at, position) - 1
        origin, verbatim = self.origin[k]
        return origin + (position - self.at[k] if verbatim else 0)


    def pieces(self, start: int, end: int) -> list[tuple[int, int]]:
        """Where the readable text from start to end stands in the original: one run of signs, or one entity, each."""
        out: list[tuple[int, int]] = []
        k = bisect.bisect_right(self.at, start) - 1
        while k < len(self.at) and self.at[k] < end:
            low, high = max(start, self.at[k]), min(end, self.at[k + 1] if k + 1 < len(self.at) else self.length)
            origin, verbatim = self.origin[k]
            at = (origin + low - self.at[k], origin + high - self.at[k]) if verbatim else (origin, origin + self.width[k])
            if at[1] > at[0]:
                if out and out[-1][1] == at[0]:
                    out[-1] = (out[-1][0], at[1])
                else:
                    out.append(at)
            k += 1
        return out


def view_of(text: str, is_html: bool) -> View:
    view = View()
    if not is_html:
        last = 0
        # texts set with two spaces between words, or with signs of no width, are read without them
        for m in (_DROPPED_OR_DOUBLE if 3 * text.count("  ") > text.count(" ") else _DROPPED).finditer(text):
            view.add(text[last : m.start()], last)
            last = m.end()
        view.add(text[last:], last)
        return view.close()
    aside: list[tuple[str, int]] = []
    last = length = 0
    parts, places, origin, width = view.parts, view.at, view.origin, view.width
    for m in _MARK.finditer(text):
        start, end = m.span()
        if start > last:
            parts.append(text[last:start])
            places.append(length)
            origin.append((last, True))
            width.append(0)
            length += start - last
        last = end
        name = m.group(2)
        if name is not None:
            if name not in _INLINE and name.strip("/").lower() not in _INLINE:
                parts.append("\n")
                places.append(length)
                origin.append((start, False))
                width.append(0)
                length += 1
            inside = m.group(3)
            if "=" in inside:
                for a in _ATTRIBUTE.finditer(inside):
                    k = a.lastindex
                    value = a.group(k) if k else ""
                    if len(value) > 6 or "@" in value or " " in value or value.isdigit():  # no shorter value can hold an item
                        aside.append((value, m.start(3) + a.start(k)))
        elif m.group(1) is not None:
            aside.append((m.group(1), m.start(1)))
        elif text[start] == "&":
            view.length = length
            view.add(html.unescape(m.group(0)), start, False, end - start)
            length = view.length
        else:
            aside.append((m.group(0), start))
    view.length = length
    view.add(text[last:], last)
    for piece, at in aside:
        view.add("\n\n", at, False)
        start = 0
        for m in re.finditer(r"&#?\w{1,31};", piece):
            view.add(piece[start : m.start()], at + start)
            view.add(html.unescape(m.group(0)), at + m.start(), False, len(m.group(0)))
            start = m.end()
        view.add(piece[start:], at + start)
    return view.close()


# --- validators -------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved.upper())) % 97 == 1


_CARD = re.compile(r"\d(?:[ -]?\d){12,18}")
_IBAN_DIGITS = re.compile(r"\d\d(?<=[A-Za-z]{2}\d\d)(?= ?[A-Za-z0-9]{4})")
_IBAN = re.compile(r"\b[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,4})?\b")

# --- e-mail -----------------------------------------------------------------------------------------------------------

_SIGN = re.compile(r"[@©®]")
_SPELT = re.compile(r"[\[({<]\s?(?:at|@)\s?[\])}>]| at (?=[\w-]+ ?dot )", re.I)
_USER = re.compile(r"[\w.+%'-]*[\w+]\s?$")
_HOST = re.compile(r"\s?([A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?)((?:(?:\.|\s?[\[({]\s?(?:dot|DOT|Dot|\.)\s?[\])}]\s?| \. | (?:dot|DOT|Dot|dOT) )[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?)+)")
_DOT = re.compile(r"\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?| dot ", re.I)


def emails(text: str) -> Iterator[tuple[int, int, str, str]]:
    signs = list(_SPELT.finditer(text)) if "dot" in text or "DOT" in text or "Dot" in text or "@]" in text else []
    for m in [*_SIGN.finditer(text), *signs]:
        begin = max(0, m.start() - 80)
        user = _USER.search(text[begin : m.start()])
        host = _HOST.match(text, m.end())
        if not user or not host:
            continue
        labels = [x for x in _DOT.split(host.group(2)) if x]
        if not re.fullmatch(r"[A-Za-z]{2,}", labels[-1]):
            continue
        name = user.group(0).strip()
        value = name + host.group(1) + "".join(labels)
        yield begin + user.start(), host.end(), "email", value


# --- numbers ----------------------------------------------------------------------------------------------------------

_RUN = re.compile(r"[+(0-9][0-9+() .\-/]{4,}[0-9]")
_PHONE = re.compile(
    r"\+\d{1,3}(?:[ .-]{0,3}\(?\d{1,12}\)?){1,6}|1(?: - |[ .-])\(?\d{3}\)?(?: - |[ .-])\d{3}(?: - |[ .-])\d{4}|\(\d{3}\)(?: - |[ .-]|)\d{3}(?: - |[ .-])\d{4}"
    r"|\d{3}(?: - |[ .-])\d{3}(?: - |[ .-])\d{4}|0\d(?:[ .-]\d\d){4}|0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}|\d{10}"
)
_ID = re.compile(
    r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d](?!\w)|[A-Za-z]{0,2}\d{3}-\d{4}-\d{4}|[A-Za-z]{1,2}\d{6,9}|\d{2}-\d{2}-\d{2}-\d{4,6}|\d{4}[ -]?\d{4}[ -]?\d{4}|\d{3}[ -]?\d{2}[ -]?\d{4}|\d{6,12}"
)
_PHONE_LABEL = re.compile(r"(?<![^\W_])(?:tel|phone|telephone|cell|mobile|mob|fax|call|ph|m|t|c|p|handy|telefon|tél|contact)\b\.?(?: no\b\.?| number\b| nr\b\.?)?[\s:.\-#]*(?:(?<=[\s:])[a-z-]+ )?$", re.I)
_ID_LABEL = re.compile(
    r"(?:\bssn|\bss ?#|\bss\b|\bsoc(?:ial)?\.? sec(?:urity)?\b\.?|\bnino\b|\bnational insurance\b|\bni (?:number|no)\b|\bpassport\b|\bdriv(?:er|ing)'?s?'? licen[cs]e|\bdl\b|\bcitizenship\b|\bnational id(?:entity)?\b|\bid card\b|\bidentity (?:card|number|no)\b|\bpersonal id\b|\bpersonalausweis\w*|\breisepass\w*|\bpasaporte\b|\bpasseport\b)"
    r"(?:[\s:.#-]|\bno\b|\bnumber\b|\bnum\b|\bnr\b|\bcertificate\b|\bcard\b|\bid\b|\bis\b|\bwas\b)*(?:[a-z-]+ )?$",
    re.I,
)
_TRADE = re.compile(
    r"(?<![^\W_])(?:order|invoice|voucher|batch|ref|reference|parcel|meter|kit|pallet|shipment|claim|part|release|units?|code|tag|worth|accounts?|purchase|certificate|serial|ticket|model|sku|item|lot|case|job|version|budget|policy|asset|fault|permit|licence plate|vat|iso|isbn|patent|contract|no|nos|number|id)\b\.?\s?[:#]?\s?(?:[a-z-]+ )?$",
    re.I,
)
_SEPARATOR = re.compile(r"(?:^|[\n|,;•·/:(\[“\"–—-]|\s{2,})\s*$")
_DATES = re.compile(r"\(?(?:19|20)\d\d ?[-–/] ?(?:(?:19|20)\d\d)?\)?|\d{1,2}[/.]\d{1,2}[/.](?:19|20)?\d\d|\d{1,2}/(?:19|20)\d\d")


def _phones(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Where phones may stand between two places; a match too long for one number ends where the rest is another."""
    while p := _PHONE.search(text, start, end):
        stop = p.end()
        if sum(c.isdigit() for c in p.group(0)) > 15:
            for gap in re.finditer(r"[ .-]+(?=[\d(])", p.group(0)):
                at = p.start() + gap.end()
                rest = _PHONE.match(text, at, end)
                if rest and all(9 <= sum(c.isdigit() for c in x) <= 15 for x in (text[p.start() : at], rest.group(0))):
                    stop = p.start() + gap.start()
                    break
        yield p.start(), stop
        start = stop


def _shape(item: str) -> str:
    return re.sub(r"\d", "0", item)


def numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _RUN.finditer(text):
        run = m.group(0)
        digits = sum(c.isdigit() for c in run)
        start = m.start()
        letters = 0
        if start and text[start - 1].isalnum():
            head = re.search(r"(?<!\w)[A-Za-z]{1,2} ?$", text[max(0, start - 4) : start])
            if not head:
                continue
            letters = len(head.group(0))
        elif re.search(r"(?<!\w)[A-Za-z]{2} $", text[max(0, start - 4) : start]) and digits == 6:
            letters = 3
        if digits + (4 if letters else 0) < 7:
            continue
        before = text[max(0, start - letters - 48) : start - letters]
        before = before[before.rfind("\n") + 1 :]
        if _ID_LABEL.search(before):
            found = _ID.match(text, start - letters)
            if found and not text[found.end() : found.end() + 1].isalnum():
                shape = _shape(found.group(0))
                while found and _shape(found.group(0)) == shape and not text[found.end() : found.end() + 1].isalnum():
                    yield found.start(), found.end(), "id_number", found.group(0)
                    start, letters = found.end(), 0
                    found = _ID.match(text, re.compile("[ /]*").match(text, start).end())
                digits = sum(c.isdigit() for c in text[start : m.end()])
        if letters or digits < 9:
            continue
        last = -9
        for begin, end in _phones(text, start, m.end()):
            number = text[begin:end]
            count = sum(c.isdigit() for c in number)
            if not 9 <= count <= 15 or _DATES.fullmatch(number):
                continue
            left, after = text[begin - 1 : begin] if begin else "", text[end : end + 2]
            if left.isalnum() or left in ("+", "#", "@") or after[:1].isalnum() or re.match(r"[-.]\d", after):
                continue
            near = text[max(0, begin - 30) : begin]
            near = near[near.rfind("\n") + 1 :]
            score = 0.0
            if _PHONE_LABEL.search(near):
                score += 2
            elif _TRADE.search(near):
                score -= 2
            if _SEPARATOR.search(text[max(0, begin - 4) : begin]):
                score += 1
            if number[0] in "+(":
                score += 1
            elif re.search(r"[A-Za-z]{2,} $", near) and score < 2:
                score -= 0.5 if near.rstrip()[-1:].isalpha() and not near.islower() and not re.search(r"\b[a-z]+ $", near) else 1.5
                score += 0.5 if "-" in number or "." in number else 0
            if begin - last <= 4:
                score += 1  # the next of a list
            if "@" in near:
                score += 1
            if count >= 13 and luhn(re.sub(r"\D", "", number)) and number[0] != "+":
                score -= 2  # a payment card
            if score >= KEEP:
                yield begin, end, "phone", number
                last = end


# --- addresses --------------------------------------------------------------------------------------------------------

_KINDS = (
    "street st road rd avenue ave boulevard blvd lane ln drive dr court ct way place pl terrace ter parade pde crescent cres close square sq highway hwy parkway pkwy "
    "circle cir row walk mews grove gardens rise trail trl loop alley path quay hill green view wharf"
).split()
_KIND = "(?:" + "|".join(sorted(_KINDS, key=len, reverse=True)) + ")"
_SIDE = r"(?:n|s|e|w|ne|nw|se|sw|north|south|east|west)"
_ADDRESS = re.compile(
    rf"(\d{{1,5}}[A-Za-z]?(?:-\d{{1,4}}[A-Za-z]?)?(?: 1/2)?,? (?:{_SIDE}\.? )?(?:(?:county|state|farm) (?:road|rd|route|highway|hwy) \d{{1,4}}|(?:[^\W\d_][\w'.-]* ){{1,3}}?{_KIND}\b\.?(?: {_SIDE}\b(?!\w))?))".replace(" ", " {1,2}"),
    re.I,
)
_ADDRESS_ABROAD = re.compile(
    r"(?:calle|rue|via|viale|avenida|av\.|avda\.|plaza|paseo|rua|corso|piazza|allée|chemin|impasse|camino|carrera)(?: (?:de|del|de la|de los|des|du|la|le|les|di|della|da|do))? (?:[^\W\d_][\w'.-]* ?){1,3},? \d{1,5}(?: ?[a-z](?!\w))?(?!\w| ?%)"
    r"|\d{1,5} ?(?:bis|ter)?,? (?:rue|avenue|boulevard|allée|place|impasse|chemin|quai|cours)(?: (?:de la|de l'|des|du|de|d'|la|le|les))? ?(?:[^\W\d_][\w'-]*)(?: [A-ZÀ-Ý][\w'-]*)?"
    r"|[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|steig) \d{1,4}(?: ?[a-z](?!\w))?(?!\w)",
    re.I,
)
_HOUSE = re.compile(r"\d(?<![\w.,/:#-]\d)\d{0,4}[A-Za-z]?(?:-\d{1,4}[A-Za-z]?)?(?: 1/2)?,? [^\W\d_]")
_FIRM = set(
    "inc gmbh ltd llp llc plc ag sa group bank banks studios studio motors services systems partners holdings trust works clinic hotel stores foods farms builders airways media academy logistics college university institute school "
    "hospital company corp corporation association society ministry council crews filings solutions industries consulting church museum club shop market park station".split()
)
_AFTER = re.compile(r" ?(&|[^\W\d_]+)")


def addresses(text: str) -> Iterator[tuple[int, int, str, str]]:
    low = text.lower()
    present = set(low.split())
    abroad = not present.isdisjoint(_ABROAD_FIRST) or any(w.endswith(_ABROAD_LAST) for w in present)
    if not abroad and _STREETS.isdisjoint(w.strip(".,;:()[]|<>\"'") for w in present):
        return
    capital: bool | None = None
    for h in _HOUSE.finditer(text):
        m = _ADDRESS.match(text, h.start())
        if not m:
            m = _ADDRESS_ABROAD.match(text, h.start())
            if m and (m.group(0)[0].isdigit()):
                yield m.start(), m.end(), "address", m.group(0)
            continue
        value = m.group(1)
        body = value.split(" ", 1)[1]
        if "\n" in value:
            continue
        words = [w for w in re.findall(r"[^\W\d_][\w'.-]*", body)]
        if capital is None:
            capital = text.islower() or mostly_capital(text)
        if not capital and any(w[0].islower() and w.lower() not in ("of", "the", "la", "de") for w in words):
            continue
        if any(w.lower().strip(".") in _STOP for w in words[:-1]):
            continue
        nxt = _AFTER.match(text, m.end())
        if nxt and (nxt.group(1).lower() in _FIRM or nxt.group(1) == "&") and not text[m.end() : m.end() + 1] == "\n":
            continue
        if nxt and nxt.group(1).lower() in _KINDS and text[m.end() : m.end() + 1] == " ":
            longer = re.compile(rf" {nxt.group(1)}\b\.?", re.I).match(text, m.end())
            yield m.start(), longer.end(), "address", value + longer.group(0)
            continue
        number = int(re.match(r"\d+", value).group(0))
        before = text[max(0, m.start() - 14) : m.start()]
        if 1950 <= number <= 2035 and re.search(r"(?:[-–—]|to|in|\d|[a-z]{3}\.?) ?\Z", before, re.I) and not re.search(r"(?:address|home|addr)\W*$", before, re.I):
            continue
        if capital and re.search(r"[^\W\d_]{2,} $", before) and not re.search(r"(?:address|home|addr|at)\W*$", before, re.I) and words[-1].lower().strip(".") in ("court", "view", "hill", "green", "place", "way", "close", "row", "walk", "rise", "path", "drive", "square"):
            continue
        yield m.start(), m.end(1), "address", value
    if not abroad:
        return
    starts = set()
    for word in _ABROAD_WORDS:
        at = low.find(word)
        while at >= 0:
            starts.add(at)
            at = low.find(word, at + 1)
    for start in sorted(starts):
        while start and text[start - 1].isalpha():
            start -= 1
        a = _ADDRESS_ABROAD.match(text, start)
        if a and not a.group(0)[0].isdigit() and "\n" not in a.group(0):
            yield a.start(), a.end(), "address", a.group(0)


_ABROAD_FIRST = set("calle rue via viale avenida av. avda. plaza paseo rua corso piazza allée chemin impasse camino carrera".split())
_STREETS = {*_KINDS, "route"}
_ABROAD_LAST = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "damm", "steig", *_ABROAD_FIRST)
_ABROAD_WORDS = [f"{w} " for w in _ABROAD_LAST]

# --- names ------------------------------------------------------------------------------------------------------------

#: Common given names.
GIVEN = set(
    "amara anita bipin bruno carmen chloe dana declan dinesh elena ernest esther faith felix fiona françois francois gavin gita grace grant hari hassan hugo ingrid irene jonas joy karim kwame leila lucía lucia mark marla milan nadia noor "
    "nora omar oscar paula priya quentin rafael rosa sofia stefan summer sunita tara tobias ursula victor wendy will xavier yasmin yuki zoran zoë zoe derek james john robert michael william david richard joseph thomas charles mary patricia "
    "jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa daniel matthew anthony donald steven paul andrew joshua kenneth kevin brian george edward emily emma olivia sophia isabella mia anna maria laura julia peter martin "
    "hans klaus jürgen claire marie jean pierre luc camille luis carlos josé jose juan miguel pedro ana ahmed ali mohammed fatima aisha chen wei ming hiroshi kenji raj amit deepak sanjay ravi anil sita ram krishna bishal nisha".split()
)
_PARTICLE = {"van", "der", "den", "de", "la", "von", "el", "al", "da", "di", "du", "bin", "ibn", "le", "del", "dos", "st", "zu", "ter"}
_STOP = set(
    "until during in and at of for with on by or to from the a an as is was who that this which while when where since before after per via inc near under over than into onto our my your their his her its not no but if so "
    "i we you he she it they led used date phone email mail tel name address profile summary objective skills experience education languages interests references referees".split()
)
#: Second words that make a given name an everyday phrase, not a person.
_PHRASE = set(
    "lane valley rota outreach period book drafting proposals proposal writing collections reports direction payable letters upkeep point hill haven brook street road avenue court park house office centre center team funding application "
    "applications management research days day season time notes note division amounts awards award money report planning training camp school sheet sheets scheme statement period programme program language power wood stone river bridge".split()
)
_JOB = re.compile(
    r"(?:manager|engineer|analyst|officer|associate|assistant|administrator|designer|director|developer|technician|teacher|tutor|consultant|accountant|nurse|chef|cook|supervisor|coordinator|specialist|executive|lead|editor|producer|recruiter|"
    r"foreman|curator|coach|trainer|instructor|advisor|adviser|buyer|estimator|liaison|dispatcher|partner|advocate|worker|maker|teller|planner|clerk|agent|mechanic|pilot|lawyer|attorney|solicitor|paralegal|president|owner|head|scientist|architect|"
    r"programmer|controller|auditor|cashier|secretary|operator|driver|inspector|librarian|lecturer|professor|strategist|writer|artist|photographer|merchandiser|stylist|agronomist|grower|counsel|representative|steward|attendant)\b",
    re.I,
)
_LABELS = ("name:", "name :", "name -", "nombre:", "nom:", "candidate:", "applicant:", "resume of ", "resume for ", "résumé of ", "cv of ", "curriculum vitae of ", "dr. ", "mr. ", "mrs. ", "ms. ", "prof. ", "dr ", "mr ", "mrs ", "ms ", "miss ")
_LABEL_WORDS = {label.split()[0].strip(".:") for label in _LABELS}
_LEFT_CUE = re.compile(r"(?:^|[\s(])(?:for|to|by|from|with|under|of|and|contact|supervisor|referee|reference)\s$", re.I)
_LINE_START = re.compile(r"(?:(?:^|[\n|•·;/\"“”>]|\s{2})[ *+\-–—‣▪>#\r]*)(?:(?:references?|referees?|contact(?: details)?|personal (?:details|information))\s?:? *)?$", re.I)
_INITIAL = re.compile(r"\.(?= [^\W\d_])(?<=[^\W\d_]\.)(?<![\w.'][^\W\d_]\.)")
#: Cues after which any capitalised word may begin a name.
_NAME_CUE = re.compile(
    r"(?<![^\W_])(?i:report(?:ed|ing|s)(?: directly)? to|(?:supervised|managed|mentored|referred|trained|hired|led) by|supervisor|line manager|referees?|references?|contact|deputi[sz]ed for|(?:took over|(?:took )?handover) from"
    r"|work(?:ed|ing|s)? (?:closely )?with|alongside|on behalf of|assistant to)(?: is| was)?(?::|,)?\s+(?:(?i:dr|mr|mrs|ms|prof)\.? )?(?=[^\W\d_])"
)
#: Words that a cue may begin with.
_CUE_WORDS = set(
    "report reported reporting reports supervised supervisor line managed mentored referred trained hired led referee referees reference references contact deputised deputized took handover work worked working works alongside on assistant".split()
)
#: Cues that name a person even where letter case tells nothing; what follows the name then decides.
_FIRM_CUE = re.compile(r"(?i:report(?:ed|ing|s)(?: directly)? to|(?:mentored|supervised) by|referees?|references?|deputi[sz]ed for|(?:took )?handover from)")
#: Two capitalised words, the second perhaps after a particle, at the head of a line or of a part of one.
_TWO = r"(?=[^\W\d_a-zß-ÿ][\w'’.-]*,? (?:[^\W\d_a-zß-ÿ]|(?:van|der|den|de|la|von|el|al|da|di|du|bin|ibn|le|del|dos|st|zu|ter) ))"
_MARKS = r"[ *+\-–—‣▪>#\r•·|]*"
_FIRST = re.compile(_MARKS + _TWO)
_HEAD = re.compile(r"[\n|•· \t](?:(?<=[\n|•·])|(?<=[ \t])\s)" + _MARKS + _TWO)
#: Words after a name that go on with a sentence.
_GOES_ON = re.compile(r" (?:until|during|in|and|for|at|on|from|as|while|before|after|to|since|through|with)\b", re.I)
#: Capitalised words that begin or end names of offices, teams and places, not of persons.
_OFFICE = set(
    "human resources customer client service services sales marketing finance financial accounting accounts senior junior regional general executive chief vice board department division managing assistant national international global corporate "
    "business public relations quality assurance health safety new north south east west old information technology software data project product process operations production plant store head office staff support technical legal medical "
    "nursing clinical administrative administration training development education art arts creative digital media web graphic network system systems security property facilities retail account key care patient social community youth "
    "program programme area district state city county federal government us uk united states american english french spanish german microsoft adobe google work experience professional personal career summary additional core areas available upon "
    "academic background employment history education qualifications qualification certifications licenses licences volunteer achievements highlights objective profile details fluent basic native intermediate conversational advanced arabic hindi "
    "first aid certificate certified diploma award licence license training method level prize foundation course request company name current present port upper lower cross glen mount mail e-mail email write fort lake saint san santa contract review analysis design writing engineering january february march april june july september october november december monday tuesday wednesday thursday friday saturday sunday skills languages member members team teams".split()
)
_WORD = re.compile(r"[^\W\d_][\w']*(?:-[^\W\d_][\w']*)*\.?")


@lru_cache(maxsize=2)
def mostly_capital(text: str) -> bool:
    """Whether letter case carries no information in a text: of its words of four signs or more nearly all begin large."""
    begin = [w[0] for w in text.split() if len(w) > 3]
    letters = sum(map(str.isalpha, begin))
    return letters > 0 and sum(map(str.isupper, begin)) > 0.85 * letters


def parse_name(text: str, start: int, trusted: bool, any_case: bool = False) -> tuple[int, bool] | None:
    """End of a name that begins here, and whether it begins with a known given name or an initial.

    Given names and initials, then particles, then one surname; after a trusted cue an unknown first word may lead.
    """
    at, known, given, particles = start, False, 0, 0
    last_end, surname = start, None
    while True:
        m = _WORD.match(text, at)
        if not m:
            break
        word = m.group(0)
        bare = word.rstrip(".").lower()
        initial = len(bare) == 1 and not (bare in "ai" and word.islower())
        if bare in _STOP and not initial:
            break
        if not any_case and word[0].islower() and bare not in _PARTICLE:
            break
        if initial:
            given += 1
            known |= given == 1 and word.endswith(".")
        elif bare in GIVEN:
            given += 1
            known = True
            last_end, surname = m.start() + len(word.rstrip(".")), word
        elif bare in _PARTICLE and given and text[m.end() : m.end() + 1] == " ":
            particles += 1
        else:
            if given == 0:
                if not trusted or len(bare) < 2:
                    return None
                given = 1
            else:
                if len(bare) < 3 or bare in _PHRASE or bare in _FIRM or _JOB.fullmatch(bare):
                    return None
                end = m.start() + len(word.rstrip("."))
                return end, known
        if given + particles > 5 or (word.endswith(".") and not initial):
            break
        if text[m.end() : m.end() + 1] != " ":
            break
        at = m.end() + 1
    if surname is not None and given >= 2 and last_end > start and " " in text[start:last_end]:
        return last_end, known
    return None


def firm_follows(text: str, end: int) -> bool:
    m = _AFTER.match(text, end)
    return bool(m) and (m.group(1) == "&" or m.group(1).lower() in _FIRM or m.group(1).lower() in ("lane", "road", "street"))


_REVERSED = re.compile(r"([^\W\d_][\w'-]{2,}), ([^\W\d_][\w']*(?: (?:[^\W\d_]\.|[^\W\d_][\w']+))?)(?=\s*(?:[,|•\n]|\Z)|\s{2}| (?:until|during|in|and)\b)", re.I)


def _reversed(text: str, start: int) -> int | None:
    """End of a name written surname first."""
    m = _REVERSED.match(text, start)
    if not m or m.group(1).lower() in _PHRASE or m.group(1).lower() in _FIRM or m.group(1).lower() in _STOP:
        return None
    given = m.group(2).split()
    if given[0].lower() in GIVEN and given[-1].lower() not in _PHRASE and not _JOB.fullmatch(given[-1]):
        return m.end()
    if len(given) == 2 and given[0].lower() in GIVEN:
        return m.start(2) + len(given[0]) if _STOP & {given[1].lower()} else None
    return None


_CONTACT = re.compile(r"(?:cell|tel|phone|mobile|m:|e-?mail|mail -|[\w.+-]+ ?[@©]|\+\d|\(?\d{3})", re.I)
_ROLE = re.compile(r",\s(?:[^\W\d_][\w&]* ){0,2}" + _JOB.pattern, re.I)


def names(text: str) -> Iterator[tuple[int, int, str, str]]:
    any_case = text.islower()
    low = text.lower()
    if len(low) != len(text):
        low = text
    present = {t.strip(".,:;()[]|•*\"“”–—-") for t in set(low.replace(":", " ").split())}
    for label in _LABELS if not present.isdisjoint(_LABEL_WORDS) else ():
        at = low.find(label)
        while at >= 0:
            if not (at and low[at - 1].isalnum()):
                yield from _labelled(text, low, label, at, any_case)
            at = low.find(label, at + 1)
    starts = {m.start() - 1 for m in _INITIAL.finditer(text)}
    for given in GIVEN.intersection(present):
        at = low.find(given)
        while at >= 0:
            end = at + len(given)
            if not (at and (low[at - 1].isalnum() or low[at - 1] in ".@_-+")) and not low[end : end + 1].isalnum():
                starts.add(at)
            at = low.find(given, end)
    for start in sorted(starts):
        yield from _unlabelled(text, start, any_case)
    yield from _Names(text).find(low, present)


_PART = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
_NAME_RUN = re.compile(rf"(?:[^\W\d_]\.|{_PART})(?: (?:[^\W\d_]\.|{_PART})){{1,5}}")
_TURNED = re.compile(rf"({_PART}), ({_PART}(?: (?:[^\W\d_]\.|{_PART}))?)")


def _blocked(word: str) -> bool:
    bare = word.strip(".").lower()
    return bare in _OFFICE or bare in _FIRM or bare in _PHRASE or bare in _KINDS or bare in _STOP or bool(_JOB.fullmatch(bare))


def _contact(text: str) -> bool:
    """Whether contact details begin here; a year is none."""
    return bool(_CONTACT.match(text)) and not re.match(r"\(?(?:19|20)\d\d\b|\d{3,5}[A-Za-z]? [^\W\d_]", text)


def _role(text: str, end: int) -> bool:
    """Whether a comma and a role follow, and no further word of the same phrase."""
    m = _ROLE.match(text, end)
    return bool(m) and not re.match(r" (?!(?:at|of|for|with|from|and|in)\b)[^\W\d_]", text[m.end() : m.end() + 5], re.I)


class _Names:
    """Names that a cue, a label or the head of a line shows, whatever their words are.

    A candidate is a run of two to five words that letter case tells apart. Its score adds what speaks for a person - the
    cue, a role, a contact or the rest of a sentence behind, an initial within - and takes off what speaks against: words of
    offices, firms, streets and trades, words that the text also writes small, more words than names have.
    """

    def __init__(self, text: str):
        self.text = text
        self.flat = text.islower() or mostly_capital(text)
        self.small: set[str] | None = None

    def ordinary(self, words: list[str]) -> bool:
        """Whether the text also writes one of the words small, other than inside an address."""
        if self.small is None:
            self.small = set(re.findall(r"(?<![^\s(\"'/])[a-zà-ÿ]{3,}(?=[,.;:)!?\"']*(?:\s|$))", self.text)) if not self.flat else set()
        return any(w.strip(".").lower() in self.small and w.lower() not in _PARTICLE for w in words)

    def run(self, start: int, stop_at_break: bool = True) -> tuple[int, list[str]] | None:
        """End and words of the capitalised run that begins here; in flat texts of the words up to a stop word."""
        m = _NAME_RUN.match(self.text, start)
        if not m:
            return None
        words: list[str] = []
        for word in m.group(0).split(" "):
            bare = word.strip(".").lower()
            if bare in _STOP or (not self.flat and word[0].islower() and bare not in _PARTICLE):
                break
            words.append(word)
        while words and words[-1].lower() in _PARTICLE:
            words.pop()
        return (start + len(" ".join(words)), words) if 2 <= len(words) <= 5 else None

    def score(self, end: int, words: list[str], cue: bool, head: bool) -> float:
        text = self.text
        if any(map(_blocked, words)) or self.ordinary(words) or len(words[-1].strip(".")) < 2 or firm_follows(text, end):
            return -1.0
        if not self.flat and any(w.isupper() and len(w) > 2 for w in words) and not all(w.isupper() or w.lower() in _PARTICLE for w in words):
            return -1.0
        tail = text[end : end + 160]
        line = re.split(r"\n|  |[|•·;]", tail, maxsplit=1)[0]
        behind = tail[len(line) :].lstrip(" \n\r\t|•·;-–—")[:60].split("\n")[0]
        rest = line.strip(" ,–—-:")
        score = 0.0
        if _role(text, end) or _contact(rest) or (line[:1] in tuple(",–—-(:") and ("@" in rest or sum(c.isdigit() for c in rest) >= 7)):
            score += 1.0
        elif not line.strip(" ,.") and cue:
            score += 0.5
        if not line.strip():
            score += 1.0 if head and _contact(behind) else 0.0
        if cue:
            score += 0.5 + 0.5 * bool(_GOES_ON.match(tail) or (not self.flat and re.match(r" [a-zà-ÿ]", tail)) or not tail.strip() or tail[0] in ".,;\n|")
        if any(len(w.strip(".")) == 1 for w in words[1:-1]):
            score += 0.5
        return score - 0.25 * max(0, sum(w.lower() not in _PARTICLE for w in words) - 3)

    def turned(self, start: int, cue: bool) -> int | None:
        """End of "Surname, Given" that a role, a contact, the end of the line or a sentence follows."""
        m = _TURNED.match(self.text, start)
        if not m:
            return None
        words = [m.group(1), *m.group(2).split()]
        end = m.end()
        if not self.flat and any(w[0].islower() for w in words):
            if len(words) != 3 or words[0][0].islower() or words[1][0].islower():
                return None
            words, end = words[:2], m.start(2) + len(words[1])
        if self.flat and len(words) == 3 and words[2].lower() in _STOP:
            words, end = words[:2], m.start(2) + len(words[1])
        if any(map(_blocked, words)) or self.ordinary(words) or any(len(w.strip(".")) < 2 for w in words[:2]):
            return None
        tail = self.text[end : end + 60]
        evident = _role(self.text, end) or (cue and (_GOES_ON.match(tail) or not tail.strip() or tail[0] == "\n" or tail[:2] == "  "))
        return end if evident else None

    def find(self, low: str, present: set[str]) -> Iterator[tuple[int, int, str, str]]:
        """``low``: the text in small letters; ``present``: its words."""
        text = self.text
        ends: set[int] = set()
        for word in _CUE_WORDS & present:
            at = low.find(word)
            while at >= 0:
                m = _NAME_CUE.match(text, at)
                if m and m.end() not in ends and not (self.flat and not _FIRM_CUE.match(m.group(0))):
                    ends.add(m.end())
                    yield from self.at(m.end(), True, False, need=1.0)
                at = low.find(word, at + 1)
        if self.flat:
            return
        first = len(text) - len(text.lstrip())
        for m in filter(None, (_FIRST.match(text), *_HEAD.finditer(text))):
            yield from self.at(m.end(), False, True, need=1.0, top=m.start() <= first)

    def at(self, start: int, cue: bool, head: bool, need: float, top: bool = False) -> Iterator[tuple[int, int, str, str]]:
        end = self.turned(start, cue)
        if end:
            yield start, end, "name", self.text[start:end]
            return
        got = self.run(start)
        if not got:
            return
        end, words = got
        score = self.score(end, words, cue, head)
        if top and score >= 0:
            tail = self.text[end : end + 80]
            alone = re.match(r"\s*?(?:\n|  |[|•·])", tail)
            score += 1.0 if alone and _JOB.search(tail.strip()[:60].split("\n")[0]) else 0.0
        if score >= need:
            yield start, end, "name", self.text[start:end]


def _labelled(text: str, low: str, label: str, at: int, any_case: bool) -> Iterator[tuple[int, int, str, str]]:
    start = at + len(label)
    while text[start : start + 1] == " ":
        start += 1
    if label in ("dr. ", "dr ") and re.search(r"\d[A-Za-z]? (?:[^\W\d_]+\.? ){1,3}$", text[max(0, at - 40) : at]):
        return  # the Drive of an address
    if label.startswith("name") and re.search(r"(?:company|firm|user|file|employer|school|brand|product) $", low[max(0, at - 10) : at]):
        return
    back = _reversed(text, start)
    if back:
        yield start, back, "name", text[start:back]
        return
    if label.startswith(("name", "nombre", "nom", "candidate", "applicant", "resume", "résumé", "cv", "curriculum")) and not any_case:
        found = _Names(text)
        turned = _TURNED.match(text, start)
        if turned and not any(map(_blocked, [turned.group(1), *turned.group(2).split()])) and re.match(r"\s*(?:\n|  |[|•·;,]|$)", text[turned.end() : turned.end() + 4]) and turned.group(2)[0].isupper():
            yield start, turned.end(), "name", turned.group(0)
            return
        run = found.run(start)
        if run and not any(map(_blocked, run[1])) and not firm_follows(text, run[0]):
            yield start, run[0], "name", text[start : run[0]]
            return
    title = re.match(r"(?:dr|mr|mrs|ms|prof)\.? ", text[start : start + 6], re.I)
    start += title.end() if title else 0
    got = parse_name(text, start, True, any_case)
    if got and not firm_follows(text, got[0]):
        yield start, got[0], "name", text[start : got[0]]


def _unlabelled(text: str, start: int, any_case: bool) -> Iterator[tuple[int, int, str, str]]:
    """A known given name or an initial: kept after a cue, before a role, or at the head of a line."""
    left = text[max(0, start - 44) : start]
    left = left[left.rfind("\n") + 1 :]
    surname = re.search(r"([^\W\d_][\w'-]{2,}), $", left)
    if surname:
        begin = start - len(surname.group(0))
        end = _reversed(text, begin)
        if end:
            before = left[: surname.start()]
            rest = text[end : end + 60].split("\n")[0]
            if _LEFT_CUE.search(before) or (_LINE_START.search(before) and (_JOB.search(rest) or not rest.strip(" ,|") or rest[:2] == "  " or rest[:1] not in ", " or _CONTACT.match(rest.strip(" ,|•")))):
                yield begin, end, "name", text[begin:end]
                return
    got = parse_name(text, start, False, any_case)
    if not got or firm_follows(text, got[0]):
        return
    item = start, got[0], "name", text[start : got[0]]
    if _ROLE.match(text, got[0]) or _LEFT_CUE.search(left):
        yield item
        return
    if not _LINE_START.search(left):
        return
    tail = text[got[0] : got[0] + 120].split("\n")[0]
    rest = re.split(r"  |[|•·;/\"“”]", tail)[0].strip()
    if (
        not rest
        or (rest[0] in ",–—-(:" and (_JOB.search(rest[:60]) or "@" in rest or sum(c.isdigit() for c in rest) >= 7))
        or (rest[0].isupper() and _JOB.search(" ".join(rest.split(None, 3)[:3])))
        or (any_case and _JOB.search(" ".join(rest.split(None, 3)[:3])))
        or _CONTACT.match(rest)
    ):
        yield item


# --- all kinds --------------------------------------------------------------------------------------------------------

_SWAPPED = re.compile(r"(?<![^\W_])[a-zà-ÿ][A-ZÀ-Ý]{2,}")
_TURN = re.compile(r"[A-ZÀ-Ý](?<=[a-zà-ÿ][A-ZÀ-Ý])[A-ZÀ-Ý]")
_NORMAL = re.compile(r"(?<![^\W_])[A-ZÀ-Ý][a-zà-ÿ]{2,}")
_CHUNK = re.compile(r"[^\n|•·]+?(?=[\n|•·]|\s{2}|(?<=[.!?;:]) |\Z)")


def unswapped(text: str) -> str:
    """The text with the case of those parts turned round in which words begin small and go on in capitals."""
    if not _TURN.search(text) or not _SWAPPED.search(text):
        return text

    parts = list(_CHUNK.finditer(text))
    odd = [len(_SWAPPED.findall(m.group(0))) - len(_NORMAL.findall(m.group(0))) for m in parts]
    # a part without either kind of word goes with the one before it, at the beginning with the one after
    last = next((x > 0 for x in odd if x), False)
    out, at = [], 0
    for m, x in zip(parts, odd):
        last = x > 0 if x else last
        turned = m.group(0).swapcase()
        out += [text[at : m.start()], turned if last and len(turned) == len(m.group(0)) else m.group(0)]
        at = m.end()
    return "".join([*out, text[at:]])


def accounts(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Bank accounts that check: no other item is read within them."""
    for m in filter(None, (_IBAN.match(text, at.start() - 2) for at in _IBAN_DIGITS.finditer(text))):
        if 15 <= len(value_of(m.group(0))) <= 34 and mod97(m.group(0).replace(" ", "")):
            yield m.start(), m.end(), "account", m.group(0)


RANK = {"account": -1, "email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}


def readable_items(text: str | None, is_html: bool) -> tuple[View | None, list[tuple[int, int, str, str]]]:
    """The readable view and (start, end, kind, item) of every item in it, without overlaps."""
    if not text or not text.strip():
        return None, []
    view = view_of(text, is_html)
    read = unswapped(view.text)
    found = [*accounts(read), *emails(read), *numbers(read), *addresses(read), *names(read)]
    starts: list[int] = []
    taken: list[tuple[int, int, str, str]] = []
    for item in sorted(found, key=lambda x: (RANK[x[2]], x[0] - x[1])):
        at = bisect.bisect_right(starts, item[0])
        if (at == 0 or taken[at - 1][1] <= item[0]) and (at == len(taken) or item[1] <= taken[at][0]):
            starts.insert(at, item[0])
            taken.insert(at, item)
    return view, taken


def items(text: str | None, is_html: bool) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, item) of every personal item, by place in the original, without overlaps."""
    view, found = readable_items(text, is_html)
    return [(view.place(s), view.place(e - 1) + 1, kind, item) for s, e, kind, item in found if kind != "account"]


def value_of(item: str) -> str:
    return "".join(c for c in item.lower() if c.isalnum())


PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]", "account": "[BANK_ACCOUNT]"}


def redact(text: str | None, is_html: bool) -> str | None:
    """The text with every item replaced by the placeholder of its type, and cards and bank accounts that check.

    Of an item that mark-up interrupts, the first piece of text becomes the placeholder, the others go, the mark-up stays.
    """
    if text is None:
        return None
    view, found = readable_items(text, is_html)
    cuts: list[tuple[int, int, str]] = []
    for start, end, kind, _ in found:
        put = PLACEHOLDER[kind]
        for at, stop in view.pieces(start, end):
            cuts.append((at, stop, put))
            put = ""
    out, last = [], 0
    for at, stop, put in sorted(cuts):
        if at >= last:
            out += [text[last:at], put]
            last = stop
    out.append(text[last:])
    return _CARD.sub(lambda m: "[CARD]" if luhn(re.sub(r"\D", "", m.group(0))) and 13 <= sum(c.isdigit() for c in m.group(0)) <= 19 else m.group(0), "".join(out))


def found(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("resume_str", "resume_html")) -> DataFrame:
    """(resume_id, field, kind, value): one row per distinct item of a record's field."""
    ship(df.sparkSession)
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), *(F.col(f) for f in fields)).where("id is not null"), "id")

    def part(batches):
        for batch in batches:
            out: list[tuple] = []
            for field in fields:
                is_html = field.endswith("html")
                for i, text in zip(batch.column("id").to_pylist(), batch.column(field).to_pylist()):
                    seen = {(kind, value_of(item)) for _, _, kind, item in items(text, is_html)}
                    out += [(i, field, kind, value) for kind, value in seen]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c) for c in columns[1:])], ["resume_id", "field", "kind", "value"])

    return rows.mapInArrow(part, "resume_id long, field string, kind string, value string").distinct()


def redacted(df: DataFrame, fields: tuple[str, ...] = ("resume_str", "resume_html")) -> DataFrame:
    """The table with its text fields redacted; every other column passes through untouched."""
    ship(df.sparkSession)
    schema = df.schema

    def part(batches):
        for batch in batches:
            for field in fields:
                k = batch.schema.get_field_index(field)
                text = pa.array([redact(t, field.endswith("html")) for t in batch.column(k).to_pylist()], batch.schema.field(k).type)
                batch = batch.set_column(k, field, text)
            yield batch

    return df.mapInArrow(part, schema)
