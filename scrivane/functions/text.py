"""Cleaning functions: Column in, Column out, evaluated in the JVM; only folding and lemmas need Arrow batches.

White space, letters and digits are Unicode-wide and spelt out, so that a pattern means the same to every engine.
All functions map null to null unless stated otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Set

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Members of a character class: every sign that counts as white space.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Signs that a line of a list may begin with.
BULLETS = r"\s•\-\*\>◆▪►●"
#: Members of a character class: letters, numbers, underscore.
WORD = r"\p{L}\p{N}_"
EMAIL = rf"[{WORD}.\-+]+@[{WORD}.\-]+\.[a-zA-Z]{{2,}}"
PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}{SPACE}\-()]{{7,}}\p{{Nd}}"
URL = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
#: The English stop words that ship with Spark, less those that carry meaning in a resume
#: (not, no, nor, both, either, neither, c, r).
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "each", "few", "more", "most", "other", "some", "such",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll",
    "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've",
    "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's",
    "what's", "when's", "where's", "who's", "why's", "would",
)
#: Contractions that the tokenizer cuts in two.
CONTRACTIONS = {"cannot": "can not", "gonna": "gon na", "gotta": "got ta", "gimme": "gim me", "lemme": "lem me", "wanna": "wan na"}
#: Noun endings and what they become, tried in order.
NOUN_ENDINGS = (("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def tokens(text: Column) -> Column:
    """Runs of other than white space; a blank text has none."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def remove_html(text: Column) -> Column:
    """Tags and entities become spaces; entities are dropped, not decoded."""
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), rf"&[a-zA-Z]+;|&#\p{{Nd}}+;|&[{WORD}]+;", " ")


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def mark_emails(text: Column, mark: str = " emailaddress ") -> Column:
    return F.regexp_replace(text, EMAIL, mark)


def mark_phones(text: Column, mark: str = " phonenumber ") -> Column:
    return F.regexp_replace(text, PHONE, mark)


def mark_numbers(text: Column, mark: str = " NUMBER ") -> Column:
    """Phones, then numbers that stand alone."""
    return F.regexp_replace(mark_phones(text, " PHONE "), r"(?U)\b\d+\b", mark)


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, rf"[^a-zA-Z0-9{SPACE}]", " ")


def remove_numbers(text: Column) -> Column:
    """Numbers that stand alone; those inside a word stay."""
    return F.regexp_replace(text, r"(?U)\b\d+\b", " ")


def quick_tokens(text: Column) -> Column:
    """Lower-case letter runs of more than three signs, tags left out."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"[^a-zA-Z]", " ")), " +"), lambda t: F.length(t) > 3)


def truncate(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def text_stats(text: Column) -> Column:
    """Signs, words and line breaks."""
    return F.struct(
        F.length(text).alias("char_count"), word_count(text).alias("word_count"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("line_count")
    )


def clean_extracted(text: Column) -> Column:
    """Repair what page layout and scanning broke: control signs, hyphens at line ends, gaps inside addresses."""
    t = F.replace(F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit("")), F.lit("﻿"), F.lit(""))
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, rf"(?U)(\b[a-zA-Z]{{2,}})-[{SPACE}]*\n[{SPACE}]*([a-zA-Z]{{2,}}\b)", "$1$2")
    t = F.regexp_replace(t, rf"([{WORD}.\-+]+)[{SPACE}]*[@©®][{SPACE}]*([{WORD}.\-]+)[{SPACE}]*\.[{SPACE}]*([a-zA-Z]{{2,}})", "$1@$2.$3")
    t = F.regexp_replace(t, rf"(https?://[^{SPACE}]+)[{SPACE}]+([^{SPACE}]+)", "$1$2")
    t = F.regexp_replace(t, rf"(?i)linkedin[{SPACE}]*\.[{SPACE}]*com[{SPACE}]*/[{SPACE}]*in[{SPACE}]*/", "linkedin.com/in/")
    t = F.regexp_replace(t, rf"(?i)github[{SPACE}]*\.[{SPACE}]*com[{SPACE}]*/", "github.com/")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]{3,}", " "), r"\n{4,}", "\n\n\n"))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, then ASCII only: there is no built-in function for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"))


def lightly_cleaned(text: str) -> str:
    """What ``clean_for_extraction`` makes of a text without mark-up, for Arrow passes that do more at once."""
    plain = text if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", plain)).strip()


def clean_for_extraction(text: Column) -> Column:
    """Light cleaning that keeps lines; blank or null gives the empty text."""
    t = fold(remove_html(F.coalesce(text, F.lit(""))))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def stop_words(spark: SparkSession) -> list[str]:
    """The words that full cleaning drops."""
    return list(ENGLISH_STOP_WORDS)


def base_form(word: str, lexicon: Set[str]) -> str:
    """Noun form by detachment rules, accepted if the lexicon has it; else the word itself."""
    if word in lexicon:
        return word
    candidates = (word[: len(word) - len(ending)] + base for ending, base in NOUN_ENDINGS if word.endswith(ending))
    return next((c for c in candidates if c in lexicon), word)


def lemmas(words: Column, lexicon: Iterable[str]) -> Column:
    """Base forms of an array of words, in Arrow batches: the lexicon is a hash set in each worker."""
    known = frozenset(lexicon)

    @F.pandas_udf("array<string>")
    def reduce(lists: pd.Series) -> pd.Series:
        return lists.map(lambda found: None if found is None else [base_form(w, known) for w in found])

    return reduce(words)


def lexicon_from(df: DataFrame, words: str, least: int = 2, most: int = 200_000) -> list[str]:
    """A lexicon of the words that stand in at least ``least`` rows of an array column; its size is checked."""
    rows = df.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").count().where(F.col("count") >= least).select("w").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the lexicon has more than {most} words")
    return [r.w for r in rows]


def word_tokens(text: Column) -> Column:
    """Lower-case words of a text without punctuation, listed contractions in two."""
    heads = (rf"{a}(?={b}\b)" for a, b in (parts.split() for parts in CONTRACTIONS.values()))
    return tokens(F.regexp_replace(F.lower(text), rf"\b({'|'.join(heads)})", "$1 "))


def without_stop_words(words: Column, stop: Iterable[str]) -> Column:
    """Words that are neither in the list, looked up in a hash set, nor single letters."""
    listed = list(stop)
    return F.filter(words, lambda w: ~w.isin(*listed) & (F.length(w) > 1)) if listed else F.filter(words, lambda w: F.length(w) > 1)


def strip_bullets(text: Column) -> Column:
    """Without bullets at the head of lines, runs of white space as one space."""
    return normalize_whitespace(F.regexp_replace(text, rf"(?md)^[{BULLETS}]+", ""))


def classification_words(text: Column, stop: Iterable[str]) -> Column:
    """The words that full cleaning leaves; blank or null gives none."""
    t = fold(remove_html(F.coalesce(text, F.lit(""))))
    t = F.lower(remove_punctuation(mark_phones(mark_emails(remove_urls(t)))))
    return without_stop_words(word_tokens(remove_numbers(t)), stop)


def clean_for_classification(text: Column, stop: Iterable[str], lexicon: Iterable[str] | None = None) -> Column:
    """Full cleaning for a bag of words; blank or null gives the empty text.

    ``lexicon``: the base forms that lemmas may become; without one words stay as they are.
    """
    words = classification_words(text, stop)
    return F.array_join(words if lexicon is None else lemmas(words, lexicon), " ")


_ASCII_URL, _ASCII_EMAIL = re.compile(URL), re.compile(r"[A-Za-z0-9_.\-+]+@[A-Za-z0-9_.\-]+\.[a-zA-Z]{2,}")
_ASCII_PHONE = re.compile(r"\+?[0-9][0-9\s\x1c-\x1f\-()]{7,}[0-9]", re.A)
_TAG, _ENTITY = re.compile(r"<[^>]+>"), regex.compile(r"&[a-zA-Z]+;|&#\p{Nd}+;|&[\p{L}\p{N}_]+;")
#: ASCII letters in lower case, digits and white space as they are, a space for all else.
_PLAIN = "".join(chr(c).lower() if chr(c).isalnum() or chr(c).isspace() else " " for c in range(128))
_CUT = {a + b: (a, b) for a, b in (parts.split() for parts in CONTRACTIONS.values())}


def fully_cleaned(text: str | None, stop: Set[str]) -> str:
    """What ``clean_for_classification`` makes of a text without a lexicon, for Arrow passes: one scan a step, and none
    where the text has nothing that the step looks for."""
    t = text or ""
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "&" in t:
        t = _ENTITY.sub(" ", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
    if "http" in t:
        t = _ASCII_URL.sub(" ", t)
    if "@" in t:
        t = _ASCII_EMAIL.sub(" emailaddress ", t)
    words = _ASCII_PHONE.sub(" phonenumber ", t).translate(_PLAIN).split()
    if not _CUT.keys().isdisjoint(words):
        words = [part for w in words for part in _CUT.get(w, (w,))]
    return " ".join([w for w in words if len(w) > 1 and w not in stop and not w.isdigit()])


def cleaned_in_batches(text: Column, stop: Iterable[str]) -> Column:
    """``clean_for_classification`` without a lexicon, the whole of it in one Arrow pass."""
    listed = frozenset(stop)

    @F.pandas_udf(StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fully_cleaned(t, listed))

    return clean(text)


def register(spark: SparkSession) -> None:
    """Make the functions that no built-in expresses callable from SQL: fold_text(text)."""
    spark.udf.register("fold_text", fold)
