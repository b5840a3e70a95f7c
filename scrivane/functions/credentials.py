"""Education, certificates and languages of a lightly cleaned resume, as Catalyst expressions over its sections."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivane.functions import lexicon as lx
from scrivane.functions.extract import split_items
from scrivane.functions.text import let, strip

#: ``.`` and ``$`` stop at line feeds alone.
_LINES = "(?d)"
MOST_EDUCATION = 5
MOST_LISTED = 10
SHOWN = 500


def words(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in sorted(values)))


def unique(items: Column, key: Callable[[Column], Column] = F.lower) -> Column:
    """Items without later ones of the same key."""
    return let(items, lambda a: let(F.transform(a, key), lambda keys: F.filter(a, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def trimmed(text: Column, rules: Iterable[tuple[str, str]], flags: str = "") -> Column:
    """Rules (pattern, replacement) in order, stripped after each."""
    for pattern, to in rules:
        text = strip(F.regexp_replace(text, _LINES + flags + pattern, to))
    return text


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


# --- education --------------------------------------------------------------------------------------------------------


def degree_lines(source: Column) -> Column:
    """Degrees as they stand: spans that begin like a degree, to their first full stop or semicolon, without tails."""
    spans = F.transform(F.regexp_extract_all(source, F.lit(_LINES + "(?i)" + "|".join(lx.DEGREES)), F.lit(0)), strip)
    unwanted = "|".join(w.replace(".", r"\.") for w in lx.NOT_IN_DEGREES)
    fit = F.filter(spans, lambda x: x.rlike("(?i)" + lx.DEGREE_ANCHORS) & ~F.lower(x).rlike(unwanted))
    clauses = F.transform(fit, lambda x: trimmed(F.substring(collapsed(strip(F.get(F.split(x, "[.;]", 2), F.lit(0)))), 1, 100), lx.DEGREE_TRIMS, "(?i)"))
    return unique(F.filter(clauses, lambda x: F.length(x) > 8))


def merged_levels(degrees: Column) -> Column:
    """All school levels become one entry, last, with the best grade and the first school."""
    level = lambda d: F.contains(F.lower(d), F.lit("ncea"))

    def put(own: Column) -> Column:
        says = lambda word: F.exists(own, lambda d: F.contains(F.lower(d), F.lit(word)))
        grade = F.when(says("excellence"), " with Excellence").when(says("merit"), " with Merit").otherwise("")
        school = F.get(F.filter(F.transform(own, lambda d: strip(F.regexp_extract(d, "(?i)" + lx.NCEA_SCHOOL, 1))), lambda s: s != ""), F.lit(0))
        return F.concat(F.lit("NCEA Level 3"), grade, F.coalesce(F.concat(F.lit(" — "), school), F.lit("")))

    return let(degrees, lambda all_: let(F.filter(all_, level), lambda own: F.when(F.size(own) == 0, all_).otherwise(F.concat(F.filter(all_, lambda d: ~level(d)), F.array(put(own))))))


def schools(source: Column, degrees: Column) -> Column:
    """Schools that are no part of a degree and more than a generic word."""

    def spelt(x: Column) -> Column:
        x = strip(F.substring(collapsed(trimmed(strip(x), lx.UNIVERSITY_TRIMS)), 1, 100))
        for pattern, to in lx.UNIVERSITY_SPELLINGS:
            x = F.regexp_replace(x, pattern, to)
        return x

    def kept(x: Column) -> Column:
        low = F.lower(x)
        generic = strip(low).isin(*lx.GENERIC_SCHOOLS) | strip(F.get(F.split(low, ","), F.lit(0))).isin(*lx.GENERIC_SCHOOLS)
        return (F.length(x) >= 3) & ~x.rlike(r"@|\d{4}") & ~generic & ~F.exists(degrees, lambda d: F.contains(F.lower(d), low))

    return unique(F.filter(F.transform(F.regexp_extract_all(source, F.lit(_LINES + "(?i)" + lx.UNIVERSITY), F.lit(0)), spelt), kept))


def education(text: Column, part: Column) -> Column:
    """Struct (degrees, universities, education_section); without a section the first 2,000 signs are read, a fixed rule."""
    source = F.when(part != "", part).otherwise(F.substring(text, 1, 2000))

    def fields(s: Column) -> Column:
        return let(merged_levels(degree_lines(s)), lambda d: F.struct(F.slice(d, 1, MOST_EDUCATION).alias("degrees"), F.slice(schools(s, d), 1, MOST_EDUCATION).alias("universities"), F.substring(part, 1, SHOWN).alias("education_section")))

    return let(source, fields)


# --- certificates -----------------------------------------------------------------------------------------------------


def is_certificate(x: Column) -> Column:
    """Long enough, no contact detail, mostly of whole and speakable words, and with one word that certificates have."""
    parts = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    spoken = F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))
    letters = F.lower(F.regexp_replace(x, "[^a-zA-Z]", ""))
    vowels = F.length(F.regexp_replace(letters, "[^aeiou]", ""))
    return (
        (F.length(strip(F.regexp_replace(x, "^[^a-zA-Z]+", ""))) >= 8) & (F.size(parts) >= 2) & ~x.rlike(r"[@~]|\d{7}") & ~x.rlike("(?i)" + lx.NOT_IN_CERTIFICATES)
        & ~F.arrays_overlap(spoken, words(lx.CERTIFICATE_NOISE)) & F.arrays_overlap(spoken, words(lx.CERTIFICATE_ANCHORS))
        & (F.size(F.filter(parts, lambda p: F.length(p) <= 2)) <= 0.35 * F.size(parts)) & ((F.length(letters) < 8) | (vowels >= 0.25 * F.length(letters)))
    )


def certifications(text: Column, part: Column) -> Column:
    """Listed patterns in the section, or in the whole text without one; else the section's lines that qualify."""
    source = F.when(part != "", part).otherwise(text)
    named = F.when(source.rlike("(?i)" + lx.CERTIFICATE_SIGNS), F.regexp_extract_all(source, F.lit(_LINES + "(?i)" + "|".join(lx.CERTIFICATES)), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = unique(F.filter(F.transform(named, lambda m: strip(F.regexp_replace(strip(m), r"^[\-*+\s\t©®™•▪►◆]+", ""))), is_certificate))
    lines = F.filter(F.transform(F.split(part, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[©®™•\-*+\s]+", ""))), is_certificate)
    return let(found, lambda f: F.slice(F.when(F.size(f) > 0, f).otherwise(unique(lines)), 1, MOST_LISTED))


# --- languages --------------------------------------------------------------------------------------------------------


def languages(part: Column) -> Column:
    """Items of the section whose first word is a known language, as spelt there; equal ones once."""
    spelt = F.create_map(*(F.lit(x) for pair in sorted(lx.MISSPELT_LANGUAGES.items()) for x in pair))
    items = F.transform(split_items(part), lambda x: trimmed(x, lx.LANGUAGE_TRIMS))
    items = F.transform(items, lambda x: F.coalesce(F.try_element_at(spelt, F.lower(x)), F.when(F.lower(x) == "nepal", "Nepali").otherwise(x)))

    def known(x: Column) -> Column:
        low = F.lower(x)
        noise = low.isin(*sorted(lx.LANGUAGE_NOISE)) | low.rlike("|".join(lx.LANGUAGE_NOISE_STEMS))
        return (x != "Native") & ~noise & F.get(F.split(low, " "), F.lit(0)).isin(*sorted(lx.LANGUAGES))

    return F.slice(F.array_distinct(F.filter(items, known)), 1, MOST_LISTED)
