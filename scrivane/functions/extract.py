"""Fields of a lightly cleaned resume (see ``clean_for_extraction``) as Catalyst expressions.

Education, certificates and languages are in ``scrivane.functions.credentials``. Only experience, whose rules use up lines
in order, needs Python: ``scrivane.functions.experience``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.functions import lexicon
from scrivane.functions.text import SPACE, strip

EMPTY_ARRAY = "array<string>"
#: A statistical recogniser as an optional part: (text, "PERSON", "PLACE" or "FIRM") -> the first such entity, or null.
Recogniser = Callable[[Column, str], Column]
MOST_SKILLS = 35
#: A dictionary is part of the plan as literals, so its size is checked.
DICTIONARY_LIMIT = 20_000


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def header(keys: Iterable[str]) -> str:
    """What follows the start of a line that holds a header of these sections, on that line alone."""
    own = lambda pattern: pattern.replace(r"\s", r"[^\S\n]")
    parts = [rf"[^\n]*?(?:{'|'.join(own(lexicon.SECTION_HEADERS[k]) for k in keys)})\b"]
    if "experience" in keys:
        parts.append(r"[^\S\n]*experience(?:\n|\z)")
    return "(?:" + "|".join(parts) + ")"


def headed(text: Column) -> Column:
    """The text cut before every line that holds a header of any section; what stands before the first is left out.

    No lambda here or in ``section_of`` uses another's variable: Spark does not plan a Python function over one that does.
    """
    pieces = F.split(F.concat(F.lit("\n"), text), f"(?i)\n(?={header(lexicon.SECTION_HEADERS)})")
    return F.slice(pieces, F.lit(2), F.size(pieces))


def section_of(pieces: Column, key: str) -> Column:
    """Lines after the first header of the section up to the next header of any, stripped; empty without one."""
    found = F.get(F.filter(pieces, lambda p: p.rlike(r"(?i)\A" + header([key]))), F.lit(0))
    return F.coalesce(strip(F.regexp_replace(found, r"\A[^\n]*", "")), F.lit(""))


def section(text: Column, key: str) -> Column:
    """One section of a text; for several, compute ``headed`` once."""
    return section_of(headed(text), key)


def split_items(text: Column) -> Column:
    """Items of a list-like text: white space and bullets separate, too."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\s•*●▪◆►]+", ","), r"\s+[\-–—]\s+", ",")
    items = F.transform(F.split(t, r"[,|;\n]"), lambda x: strip(F.regexp_replace(strip(x), r"^:+|:+$", "")))
    return F.filter(items, lambda x: (F.length(x) > 1) & (F.length(x) < 60))


def email(text: Column) -> Column:
    closed = F.when(text.rlike("[@©®]"), F.regexp_replace(text, lexicon.EMAIL_GAPS, "$1@$2")).otherwise(text)  # most of a text's work is saved where it has no sign
    found = F.lower(first_match(F.regexp_replace(closed, r"\s*\.\s*", "."), lexicon.EMAIL))
    found = F.regexp_replace(F.regexp_replace(found, lexicon.MISREAD_HOST + r"\.(?:com|con)", "@gmail.com"), lexicon.MISREAD_HOST + "$", "@gmail.com")
    user, host = (F.lower(strip(F.regexp_extract(text, lexicon.NOISY_EMAIL, k))) for k in (1, 2))
    guess = F.when(~text.rlike("(?i)" + lexicon.NOISY_HOSTS) | (user == ""), None).when(host.rlike(lexicon.KNOWN_HOSTS), F.concat(user, F.lit("@gmail.com"))).when(F.contains(host, F.lit(".")), F.concat(user, F.lit("@"), host))
    return F.coalesce(found, guess)


def phone(text: Column) -> Column:
    national = strip(first_match(text, lexicon.NATIONAL_PHONE))
    home = F.when(national.startswith("98") | national.startswith("97"), F.concat(F.lit("+977 "), national)).when(~national.startswith("+"), F.concat(F.lit("+"), national)).otherwise(national)
    long_enough = F.filter(F.regexp_extract_all(text, F.lit(lexicon.ANY_PHONE), F.lit(0)), lambda m: F.length(F.regexp_replace(m, r"\D", "")) >= 7)
    return F.coalesce(home, F.regexp_replace(strip(F.get(long_enough, F.lit(0))), r"^[^\d+]+", ""))


def links(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(lexicon.LINK), F.lit(0))
    full = lambda pattern: F.concat(F.lit("https://"), first_match(text, pattern))
    return F.struct(found.alias("urls"), full(lexicon.LINKEDIN).alias("linkedin"), full(lexicon.GITHUB).alias("github"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _is_name(line: Column, skills: Sequence[str]) -> Column:
    low = F.lower(line)
    parts = _words(line)
    proper = F.forall(parts, lambda t: ~t.rlike("^[a-zA-Z]") | t.rlike("^[A-Z]"))
    known = F.exists(parts, lambda t: F.lower(t).isin(*skills)) if skills else F.lit(False)  # a hash set, however long the list
    return ~low.rlike("|".join(lexicon.NOT_IN_NAMES)) & ~line.rlike(r"[@|/\\0-9]") & F.size(parts).between(2, 4) & proper & ~known


def name(text: Column, skills: Sequence[str] = (), recogniser: Recogniser | None = None) -> Column:
    """A line that reads like a name among the first five, else a recognised person, else such a line among the first eight.

    The last step wants four signs or more. ``recogniser`` sees the first eight lines, 800 signs at most.
    """
    # the leading lines are cut off first: a text may have many
    leading = F.regexp_extract(text, rf"\A(?:[{SPACE}]*+[^{SPACE}][^\n]*+(?:\n|\z)){{0,8}}", 0)
    head = F.filter(lines_of(leading), lambda x: strip(x) != "")
    lines = F.transform(head, lambda x: strip(F.regexp_replace(x, "^[^a-zA-Z]+", "")))
    valid = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda v: _is_name(v["x"], skills) & ((v["i"] < 5) | (F.length(v["x"]) >= 4)))
    person = recogniser(F.substring(F.array_join(head, "\n"), 1, 800), "PERSON") if recogniser else F.lit(None).cast("string")
    return F.coalesce(F.get(F.filter(valid, lambda y: y["i"] < 5), F.lit(0))["x"], person, F.get(valid, F.lit(0))["x"])


def location(text: Column, recogniser: Recogniser | None = None) -> Column:
    """What follows an address label, else the first listed city with its neighbours, else a recognised place."""
    labelled = strip(first_match(text, lexicon.LOCATION_LABEL, 1))
    schools = "|".join(w.replace(".", "\\.") for w in lexicon.NOT_IN_LOCATION_LINES)
    usable = F.filter(F.transform(lines_of(text), strip), lambda x: x.rlike(lexicon.CITY_LINE) & ~F.lower(x).rlike(schools))

    def repair(x: Column) -> Column:
        x = F.regexp_replace(strip(x), r"^[^\w]+", "")
        for pattern, to in lexicon.LOCATION_SPELLINGS:
            x = F.regexp_replace(x, pattern, to)
        return x

    found = F.filter(F.transform(usable, lambda x: repair(F.regexp_extract(x, lexicon.CITY_LINE, 0))), lambda x: F.length(x) >= 4)
    place = recogniser(F.substring(text, 1, 800), "PLACE") if recogniser else F.lit(None).cast("string")
    return F.coalesce(labelled, F.get(found, F.lit(0)), place)


def display_name(skill: str) -> str:
    """Listed names first; several words in title case, up to three signs in capitals, else title case."""
    s = skill.lower()
    if s in lexicon.CANONICAL_SKILLS:
        return lexicon.CANONICAL_SKILLS[s]
    return s.upper() if len(s) <= 3 and " " not in s else s.title()


def dictionary_from(df: DataFrame, column: str = "skills") -> dict[str, str]:
    """A skill dictionary (lower case -> display name) from an array column of known skills, size checked."""
    words = df.select(F.explode(column).alias("s")).select(F.lower(strip(F.col("s"))).alias("s")).where("s <> ''").distinct()
    rows = words.orderBy("s").limit(DICTIONARY_LIMIT + 1).collect()
    if len(rows) > DICTIONARY_LIMIT:
        raise ValueError(f"the skill dictionary has more than {DICTIONARY_LIMIT} entries")
    return {r.s: display_name(r.s) for r in rows}


def _ruled(word: str) -> str:
    return word.upper() if len(word) <= 3 else word[:1].upper() + word[1:]


def skills(text: Column, dictionary: Mapping[str, str], most: int = MOST_SKILLS) -> Column:
    """Display names of the dictionary's entries that stand in the text as whole words, sorted, at most ``most``.

    Plain words of the text are looked up in a hash set; entries with other signs are searched only where they occur.
    """
    low = F.lower(text)
    plain = sorted(s for s in dictionary if s and all(c.isascii() and (c.isalnum() or c == "_") for c in s))
    found = F.array().cast(EMPTY_ARRAY)
    if plain:
        words = F.filter(F.array_distinct(F.split(low, r"[^a-z0-9_]+")), lambda w: w.isin(*plain))
        rule = lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
        special = [(s, dictionary[s]) for s in plain if dictionary[s] != _ruled(s)]
        if special:  # few: listed display names, read for the words found only
            table = F.create_map(*(F.lit(x) for pair in special for x in pair))
            found = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), rule(w)))
        else:
            found = F.transform(words, rule)
    other = [(s, d) for s, d in sorted(dictionary.items()) if s and s not in set(plain)]
    if other:
        quoted = lambda s: r"\b" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in s) + r"\b"
        hits = [F.when(F.contains(low, F.lit(s)) & low.rlike(quoted(s)), F.lit(d)) for s, d in other]
        found = F.concat(found, F.filter(F.array(*hits), lambda d: d.isNotNull()))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)
