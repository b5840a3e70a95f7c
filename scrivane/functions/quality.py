"""Predicates that keep garbled scans and unusable input away from the costly steps; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivane.functions.text import SPACE, let, normalize_whitespace, strip, tokens, word_count

#: Words that mark a readable resume.
MARKERS = ("experience", "education", "skills", "profile", "summary", "employment", "projects", "contact", "objective", "developer", "engineer", "manager")


def looks_garbled(text: Column) -> Column:
    """Whether a text looks like failed character recognition; null does.

    Too short, too few tokens, or too few runs of three letters a token; or, without any marker word or contact, too many
    long tokens that mix letters and digits.
    """
    return F.coalesce(let(normalize_whitespace(text), lambda c: let(tokens(c), lambda parts: _garbled(c, parts))), F.lit(True))


def _garbled(clean: Column, parts: Column) -> Column:
    total = F.size(parts)

    def judged(runs: Column) -> Column:
        ratio = F.try_divide(runs.cast("double"), total.cast("double"))
        mixed = F.size(F.filter(parts, lambda t: (F.length(t) >= 6) & t.rlike(r"\p{Nd}") & t.rlike(r"\p{L}")))
        marked = F.lower(clean).rlike("|".join(MARKERS))
        contact = clean.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}") | clean.rlike(rf"\+?\p{{Nd}}[\p{{Nd}}{SPACE}().-]{{7,}}\p{{Nd}}")
        poor = (ratio < 0.65) & (runs < 40)
        noisy = F.try_divide(mixed.cast("double"), total.cast("double")) >= 0.08
        return (F.length(clean) < 80) | (total < 12) | (runs == 0) | (ratio < 0.55) | ((poor | noisy) & ~marked & ~contact)

    return let(F.regexp_count(clean, F.lit("[A-Za-z]{3,}")), judged)


def gate_status(text: Column, model_available: bool = True) -> Column:
    """blank, low_quality, too_short, no_model or ok: the first that holds."""
    return (
        F.when(text.isNull() | (strip(text) == ""), "blank")
        .when(looks_garbled(text), "low_quality")
        .when(word_count(text) < 15, "too_short")
        .when(F.lit(not model_available), "no_model")
        .otherwise("ok")
    )
