"""SQL of the text and extraction queries, written from their rules for an engine without look-around.

Light cleaning keeps ASCII only, so that classes like ``\\w`` mean the same everywhere. Folding is spelt out: accents by the
engine, the signs that decompose otherwise by name.
"""

from __future__ import annotations

from scrivane.functions import lexicon as lx
from scrivane.functions import text as tx
from scrivane.operators import recommend as rc

S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Signs whose decomposition is no accented letter: spaces, raised digits and what becomes several signs.
_SPACES = "            　"
_DIGITS = {"¹": "1", "²": "2", "³": "3"}
_LONGER = {"½": "12", "¼": "14", "¾": "34", "…": "...", "™": "TM", "ﬁ": "fi", "ﬂ": "fl"}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{S}+|{S}+$", "")


def fold(x: str) -> str:
    x = f"translate({x}, '{_SPACES}{''.join(_DIGITS)}', '{' ' * len(_SPACES)}{''.join(_DIGITS.values())}')"
    for sign, plain in _LONGER.items():
        x = f"replace({x}, '{sign}', '{plain}')"
    return sub(f"strip_accents({x})", r"[^\x00-\x7F]", "")


def without_html(x: str) -> str:
    return sub(sub(x, "<[^>]+>", " "), r"&[a-zA-Z]+;|&#\p{Nd}+;|&[\p{L}\p{N}_]+;", " ")


def light(x: str) -> str:
    return strip(sub(sub(fold(without_html(f"coalesce({x}, '')")), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{S}+'), lambda t: t <> '')"


def first(x: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({x}, {quoted(pattern)}, {group}), '')"


def unique(x: str) -> str:
    """Items without later ones that are equal but for case."""
    return f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i)"


RESUME = "(SELECT DISTINCT * FROM resume)"
CLEAN = f"WITH c AS (SELECT id, {light('resume_str')} AS t FROM {RESUME})"


# --- cleaning -----------------------------------------------------------------------------------------------------------

_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
_PHONE = r"\+?\p{Nd}[\p{Nd}" + S[1:-1] + r"\-()]{7,}\p{Nd}"
_W = r"[\p{L}\p{N}_"

light_clean = f"SELECT id, {light('resume_html')} AS text FROM {RESUME}"
unicode_folded = f"SELECT doc_id, {fold('text')} AS text FROM documents"
numbers_marked = (
    f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all({sub('text', _PHONE, ' PHONE ')}, '[{_WORD}]+|[^{_WORD}]+'), "
    r"lambda w: CASE WHEN regexp_full_match(w, '\p{Nd}+') THEN ' NUMBER ' ELSE w END), '') AS text FROM documents"
)


def _clean_extracted() -> str:
    x = "text"
    for sign, plain in ((" ", " "), ("​", ""), ("﻿", "")):
        x = f"replace({x}, '{sign}', '{plain}')"
    x = sub(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    x = sub(x, rf"(\b[a-zA-Z]{{2,}})-{S}*\n{S}*([a-zA-Z]{{2,}}\b)", r"\1\2")
    x = sub(x, rf"({_W}.\-+]+){S}*[@©®]{S}*({_W}.\-]+){S}*\.{S}*([a-zA-Z]{{2,}})", r"\1@\2.\3")
    x = sub(x, rf"(https?://[^{S[1:]}+){S}+([^{S[1:]}+)", r"\1\2")
    x = sub(x, rf"(?i)linkedin{S}*\.{S}*com{S}*/{S}*in{S}*/", "linkedin.com/in/")
    x = sub(x, rf"(?i)github{S}*\.{S}*com{S}*/", "github.com/")
    return strip(sub(sub(x, r"[ \t]{3,}", " "), r"\n{4,}", "\n\n\n"))


#: Bytes as UTF-8 if they are, else one sign a byte.
_DECODED = "coalesce(TRY(decode(content)), array_to_string(list_transform(range(1, octet_length(content) + 1), lambda i: chr(CAST('0x' || hex(content[i:i]) AS INT))), ''))"
text_files = f"""WITH f AS (SELECT DISTINCT resume_id, path, content FROM resume_file WHERE NOT regexp_matches(lower(path), '\\.(pdf|docx|jpg|jpeg|png|webp|tiff|bmp)$')),
    d AS (SELECT resume_id, path, coalesce({_DECODED}, '') AS text FROM f), t AS (SELECT resume_id, path, {_clean_extracted()} AS text FROM d)
    SELECT resume_id, path, text, CASE WHEN text <> '' THEN 'ok' ELSE 'empty: File is empty.' END AS status FROM t"""
extracted_text_cleaned = f"SELECT doc_id, {_clean_extracted()} AS text FROM documents"


def _contracted(x: str) -> str:
    for whole, parts in tx.CONTRACTIONS.items():
        x = sub(x, rf"\b{whole}\b", parts)
    return x


def _classification() -> str:
    x = fold(without_html("coalesce(resume_str, '')"))
    x = sub(x, tx.URL, " ")
    x = sub(x, r"[\p{L}\p{N}_.\-+]+@[\p{L}\p{N}_.\-]+\.[a-zA-Z]{2,}", " emailaddress ")
    x = sub(sub(x, _PHONE, " phonenumber "), "[^a-zA-Z0-9" + S[1:], " ")
    return f"list_filter({tokens(_contracted(sub(f'lower({x})', chr(92) + 'b[0-9]+' + chr(92) + 'b', ' ')))}, lambda w: length(w) > 1 AND NOT list_contains({array(tx.ENGLISH_STOP_WORDS)}, w))"


classification_clean = f"SELECT id, array_to_string({_classification()}, ' ') AS clean FROM {RESUME}"
word_tokens = f"SELECT doc_id, array_to_string({tokens(_contracted('lower(' + sub('text', '[^a-zA-Z0-9' + S[1:], ' ') + ')'))}, ' ') AS words FROM documents WHERE text IS NOT NULL"
bullets_stripped = f"SELECT doc_id, trim({sub(sub('text', '(?m)^[' + tx.BULLETS + r'\x{0b}]+', ''), S + '+', ' ')}) AS text FROM documents"

# --- sections -----------------------------------------------------------------------------------------------------------


def _header(keys) -> str:
    parts = [rf"(?:{lx.SECTION_HEADERS[k]})\b" for k in keys]
    if "experience" in keys:
        parts.append(r"^\s*experience$")
    return "(?i)" + "|".join(parts)


def _with_sections(keys) -> str:
    """c(id, t), then s with a column of each section's text."""
    at = ", ".join(f"list_filter(hs, lambda i: regexp_matches(l[i], {quoted(_header([k]))}))[1] AS at_{k}" for k in keys)
    body = ", ".join(f"CASE WHEN at_{k} IS NULL THEN '' ELSE {strip(f'array_to_string(l[at_{k} + 1 : coalesce(list_filter(hs, lambda i: i > at_{k})[1], len(l) + 1) - 1], chr(10))')} END AS {k}" for k in keys)
    return (
        f"{CLEAN}, l AS (SELECT id, t, string_split(t, chr(10)) AS l FROM c), h AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], {quoted(_header(list(lx.SECTION_HEADERS)))})) AS hs FROM l), "
        f"p AS (SELECT *, {at} FROM h), s AS (SELECT id, t, {body} FROM p)"
    )


_ALL = ("skills", "education", "experience", "certifications", "languages", "soft_skills", "projects", "summary")
section_text = f"{_with_sections(_ALL)} SELECT id, {', '.join(_ALL)} FROM s"


def _items(x: str) -> str:
    t = sub(sub(x, r"[\s•*●▪◆►]+", ","), r"\s+[\-–—]\s+", ",")
    each = f"list_transform(string_split_regex({t}, '[,|;\\n]'), lambda v: {strip(sub(strip('v'), '^:+|:+$', ''))})"
    return f"list_filter({each}, lambda v: length(v) > 1 AND length(v) < 60)"


section_items = f"{_with_sections(['skills'])} SELECT id, {_items('skills')} AS items FROM s"

# --- single fields ------------------------------------------------------------------------------------------------------


def _email() -> str:
    closed = sub(sub("t", lx.EMAIL_GAPS, r"\1@\2"), r"\s*\.\s*", ".")
    found = sub(sub(f"lower({first(closed, lx.EMAIL)})", lx.MISREAD_HOST + r"\.(?:com|con)", "@gmail.com"), lx.MISREAD_HOST + "$", "@gmail.com")
    user, host = (f"lower({strip(f'regexp_extract(t, {quoted(lx.NOISY_EMAIL)}, {k})')})" for k in (1, 2))
    return f"coalesce({found}, CASE WHEN {user} = '' THEN NULL WHEN regexp_matches({host}, '{lx.KNOWN_HOSTS}') THEN {user} || '@gmail.com' WHEN contains({host}, '.') THEN {user} || '@' || {host} END)"


emails = f"{CLEAN} SELECT id, {_email()} AS email FROM c"
_NATIONAL = strip(first("t", lx.NATIONAL_PHONE))
_ANY = f"list_filter(regexp_extract_all(t, {quoted(lx.ANY_PHONE)}), lambda m: length({sub('m', '[^0-9]', '')}) >= 7)[1]"
phones = (
    f"{CLEAN}, n AS (SELECT id, {_NATIONAL} AS home, {sub(strip(_ANY), '^[^0-9+]+', '')} AS other FROM c) "
    "SELECT id, CASE WHEN home IS NULL THEN other WHEN starts_with(home, '98') OR starts_with(home, '97') THEN '+977 ' || home WHEN NOT starts_with(home, '+') THEN '+' || home ELSE home END AS phone FROM n"
)
links = f"{CLEAN} SELECT id, {{'urls': regexp_extract_all(t, {quoted(lx.LINK)}), 'linkedin': 'https://' || {first('t', lx.LINKEDIN)}, 'github': 'https://' || {first('t', lx.GITHUB)}}} AS links FROM c"

_KNOWN = f"known AS (SELECT list(DISTINCT s) AS known FROM (SELECT lower({strip('unnest(skills)')}) AS s FROM extracted_record) WHERE s <> '')"
_NAME = (
    f"NOT regexp_matches(lower(x), {quoted('|'.join(lx.NOT_IN_NAMES))}) AND NOT regexp_matches(x, '[@|/\\\\0-9]') AND len({tokens('x')}) BETWEEN 2 AND 4 "
    f"AND len(list_filter({tokens('x')}, lambda w: regexp_matches(w, '^[a-z]'))) = 0 AND NOT list_has_any(list_transform({tokens('x')}, lambda w: lower(w)), known)"
)
names = f"""{CLEAN}, {_KNOWN}, l AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: {strip('x')} <> '')[1:8] AS l FROM c),
    u AS (SELECT id, unnest(list_transform(l, lambda x: {strip(sub('x', '^[^a-zA-Z]+', ''))})) AS x, unnest(range(1, len(l) + 1)) AS i FROM l),
    v AS (SELECT id, min_by(x, CASE WHEN i <= 5 THEN i ELSE 100 + i END) AS name FROM u, known WHERE (i <= 5 OR length(x) >= 4) AND {_NAME} GROUP BY id)
    SELECT c.id, v.name FROM c LEFT JOIN v ON c.id = v.id"""


def _repaired(x: str) -> str:
    x = sub(strip(x), r"^[^\w]+", "")
    for pattern, to in lx.LOCATION_SPELLINGS:
        x = sub(x, pattern, to)
    return x


_TOWNS = f"list_filter(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip('x')}), lambda x: x <> '' AND NOT list_has_any(list_transform({array(lx.NOT_IN_LOCATION_LINES)}, lambda w: contains(lower(x), w)), [true])), lambda x: {_repaired(f'regexp_extract(x, {quoted(lx.CITY_LINE)})')}), lambda x: length(x) >= 4)[1]"
locations = f"{CLEAN} SELECT id, coalesce({strip(first('t', lx.LOCATION_LABEL, 1))}, {_TOWNS}) AS location FROM c"

_TITLED = "array_to_string(list_transform(regexp_extract_all(s, '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"
_SHOWN = "CASE s " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in lx.CANONICAL_SKILLS.items()) + f" ELSE CASE WHEN length(s) <= 3 AND NOT contains(s, ' ') THEN upper(s) ELSE {_TITLED} END END"
skills = f"""{CLEAN}, {_KNOWN}, e AS (SELECT s, {_SHOWN} AS shown, '\\b' || regexp_escape(s) || '\\b' AS pattern FROM (SELECT unnest(known) AS s FROM known)),
    f AS (SELECT DISTINCT c.id, e.shown FROM c JOIN e ON contains(lower(c.t), e.s) AND regexp_matches(lower(c.t), e.pattern)),
    g AS (SELECT id, list_sort(list(shown))[1:35] AS skills FROM f GROUP BY id) SELECT c.id, coalesce(g.skills, []) AS skills FROM c LEFT JOIN g ON c.id = g.id"""

# --- education ------------------------------------------------------------------------------------------------------------


def _cut(x: str, rules, flags: str = "") -> str:
    for pattern, to in rules:
        x = strip(sub(x, flags + pattern, to))
    return x


def _spelt(x: str) -> str:
    x = strip(f"substr({sub(_cut(strip(x), lx.UNIVERSITY_TRIMS), S + '+', ' ')}, 1, 100)")
    for pattern, to in lx.UNIVERSITY_SPELLINGS:
        x = sub(x, pattern, to)
    return x


_CLAUSE = _cut(f"substr({sub(strip("string_split_regex(x, '[.;]')[1]"), S + '+', ' ')}, 1, 100)", lx.DEGREE_TRIMS, "(?i)")
_GENERIC = array(lx.GENERIC_SCHOOLS)
education = f"""{_with_sections(['education'])},
    a AS (SELECT id, education, CASE WHEN education <> '' THEN education ELSE substr(t, 1, 2000) END AS src FROM s),
    b AS (SELECT *, list_transform(regexp_extract_all(src, {quoted('(?i)' + '|'.join(lx.DEGREES))}), lambda x: {strip('x')}) AS d FROM a),
    e AS (SELECT *, list_filter(list_transform(list_filter(d, lambda x: regexp_matches(x, {quoted('(?i)' + lx.DEGREE_ANCHORS)}) AND NOT list_has_any(list_transform({array(lx.NOT_IN_DEGREES)}, lambda w: contains(lower(x), w)), [true])), lambda x: {_CLAUSE}), lambda x: length(x) > 8) AS f FROM b),
    g AS (SELECT *, {unique('f')} AS u FROM e), n AS (SELECT *, list_filter(u, lambda x: contains(lower(x), 'ncea')) AS own FROM g),
    m AS (SELECT *, list_filter(list_transform(own, lambda x: {strip('regexp_extract(x, ' + quoted('(?i)' + lx.NCEA_SCHOOL) + ', 1)')}), lambda x: x <> '')[1] AS school, lower(array_to_string(own, chr(10))) AS low FROM n),
    k AS (SELECT *, CASE WHEN len(own) = 0 THEN u ELSE list_append(list_filter(u, lambda x: NOT contains(lower(x), 'ncea')), 'NCEA Level 3' || CASE WHEN contains(low, 'excellence') THEN ' with Excellence' WHEN contains(low, 'merit') THEN ' with Merit' ELSE '' END || coalesce(' — ' || school, '')) END AS degrees FROM m),
    v AS (SELECT *, list_transform(regexp_extract_all(src, {quoted('(?i)' + lx.UNIVERSITY)}), lambda x: {_spelt('x')}) AS w FROM k),
    y AS (SELECT *, list_filter(w, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '@|[0-9]{{4}}') AND NOT list_contains({_GENERIC}, {strip('lower(x)')}) AND NOT list_contains({_GENERIC}, {strip("string_split(lower(x), ',')[1]")})
      AND NOT list_has_any(list_transform(degrees, lambda q: contains(lower(q), lower(x))), [true])) AS z FROM v)
    SELECT id, degrees[1:5] AS degrees, {unique('z')}[1:5] AS universities, substr(education, 1, 500) AS education_section FROM y"""

# --- certificates and languages -------------------------------------------------------------------------------------------

_LETTERS = f"lower({sub('x', '[^a-zA-Z]', '')})"
_SPOKEN = "regexp_extract_all(lower(x), '[a-z]+')"
_CERTIFICATE = (
    f"length({strip(sub('x', '^[^a-zA-Z]+', ''))}) >= 8 AND len({tokens('x')}) >= 2 AND NOT regexp_matches(x, '[@~]|[0-9]{{7}}') AND NOT regexp_matches(x, {quoted('(?i)' + lx.NOT_IN_CERTIFICATES)}) "
    f"AND NOT list_has_any({_SPOKEN}, {array(sorted(lx.CERTIFICATE_NOISE))}) AND list_has_any({_SPOKEN}, {array(sorted(lx.CERTIFICATE_ANCHORS))}) "
    f"AND len(list_filter({tokens('x')}, lambda p: length(p) <= 2)) <= 0.35::DOUBLE * len({tokens('x')}) AND (length({_LETTERS}) < 8 OR length({sub(_LETTERS, '[^aeiou]', '')}) >= 0.25::DOUBLE * length({_LETTERS}))"
)
_NAMED = f"list_transform(regexp_extract_all(CASE WHEN certifications <> '' THEN certifications ELSE t END, {quoted('(?i)' + '|'.join(lx.CERTIFICATES))}), lambda x: {strip(sub(strip('x'), '^[' + chr(92) + '-*+' + chr(92) + 's©®™•▪►◆]+', ''))})"
_LINES = f"list_transform(string_split(certifications, chr(10)), lambda x: {strip(sub(strip('x'), '^[©®™•' + chr(92) + '-*+' + chr(92) + 's]+', ''))})"
certifications = f"""{_with_sections(['certifications'])}, n AS (SELECT id, list_filter({_NAMED}, lambda x: {_CERTIFICATE}) AS a, list_filter({_LINES}, lambda x: {_CERTIFICATE}) AS b FROM s)
    SELECT id, CASE WHEN len(a) > 0 THEN {unique('a')} ELSE {unique('b')} END[1:10] AS certifications FROM n"""


def _trimmed(x: str) -> str:
    for pattern, to in lx.LANGUAGE_TRIMS:
        x = strip(sub(x, pattern, to))
    return x


_SPELT = "CASE lower(x) " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in lx.MISSPELT_LANGUAGES.items()) + " WHEN 'nepal' THEN 'Nepali' ELSE x END"
_LANGUAGE = f"x <> 'Native' AND NOT list_contains({array(sorted(lx.LANGUAGE_NOISE))}, lower(x)) AND NOT regexp_matches(lower(x), '{'|'.join(lx.LANGUAGE_NOISE_STEMS)}') AND list_contains({array(sorted(lx.LANGUAGES))}, string_split(lower(x), ' ')[1])"
languages = f"""{_with_sections(['languages'])}, n AS (SELECT id, list_filter(list_transform(list_transform({_items('languages')}, lambda x: {_trimmed('x')}), lambda x: {_SPELT}), lambda x: {_LANGUAGE}) AS a FROM s)
    SELECT id, list_filter(a, lambda v, i: list_position(a, v) = i)[1:10] AS languages FROM n"""

# --- records ------------------------------------------------------------------------------------------------------------

_RECORDS = "WITH r AS (SELECT DISTINCT * FROM extracted_record)"
degree_display = f"""{_RECORDS}, d AS (SELECT resume_id, unnest(degrees) AS degree FROM r)
    SELECT resume_id, degree, CASE WHEN contains(lower(degree), 'ncea') OR contains(lower(degree), 'school') THEN 'Secondary' ELSE 'Tertiary' END AS badge,
      {{'title': trim(string_split(degree, CASE WHEN contains(degree, ' at ') THEN ' at ' ELSE ' — ' END)[1]), 'institution': trim(CASE WHEN contains(degree, ' at ') THEN substr(degree, strpos(degree, ' at ') + 4)
        WHEN contains(degree, ' — ') THEN substr(degree, strpos(degree, ' — ') + 3) ELSE '' END)}} AS parts FROM d"""
_LINE = lambda label, c: f"CASE WHEN {c} <> '' THEN '{label}: ' || {c} END"
_BLOCK = lambda label, c: f"CASE WHEN len({c}) > 0 THEN '{label}:' || chr(10) || array_to_string(list_transform({c}, lambda x: '  • ' || x), chr(10)) END"
record_text = (
    f"{_RECORDS} SELECT resume_id, concat_ws(chr(10), {_LINE('Name', 'name')}, {_LINE('Email', 'email')}, {_LINE('Phone', 'phone')}, {_LINE('Location', 'location')}, "
    f"{_BLOCK('Skills', 'skills')}, {_BLOCK('Degree(s)', 'degrees')}, {_BLOCK('University/College', 'universities')}, {_BLOCK('Job Title(s)', 'job_titles')}) AS text FROM r"
)


def recommendations(score: str) -> str:
    """``score``: the common table expression s with the flags a to h (what is there), n and ats of each record."""
    flags = "abcdefg"
    listed = lambda values, on: "list_filter([" + ", ".join(f"CASE WHEN {'' if on else 'NOT '}{f} THEN {quoted(v)} END" for f, v in zip(flags, values)) + "], lambda x: x IS NOT NULL)"
    extra = f"list_filter([CASE WHEN {' AND '.join(flags)} THEN {quoted(rc.LOOKS_STRONG)} END, CASE WHEN h THEN {quoted(rc.ROLE_KEYWORDS)} END], lambda x: x IS NOT NULL)"
    by = lambda table, default: "CASE upper(coalesce(category, 'DEFAULT')) " + " ".join(f"WHEN {quoted(k)} THEN {array(v)}" for k, v in table.items()) + f" ELSE {array(default)} END"
    words = by(rc.KEYWORDS, rc.DEFAULT_KEYWORDS)
    return f"""{score} SELECT resume_id, category, ats AS ats_score, CAST(greatest(0, least(100, floor(CAST(ats AS DOUBLE) * CAST(0.7 AS DOUBLE) + n * 4))) AS INT) AS job_match_score,
      list_concat({listed([c[3] for c in rc.CHECKS], False)}, {extra})[1:4] AS recommendations, {words} AS keywords,
      list_filter({words}, lambda w: NOT contains(lower(coalesce(array_to_string(skills, ' '), '')), lower(w)))[1:5] AS keyword_gap, {listed([c[0] for c in rc.CHECKS], False)} AS missing_sections,
      {listed([c[2] for c in rc.CHECKS], True)} AS strengths, {by(rc.SENTENCES, rc.DEFAULT_SENTENCES)} AS writing_suggestions, CASE WHEN ats < {rc.LOW_SCORE} THEN {quoted(rc.TIP)} END AS tip FROM s"""
