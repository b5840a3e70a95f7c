"""Problem 8: unfilled template fields, filler text, error pages and scripts-required notices.

Method. Labelled residue exemplars are held in an inverted index (term -> exemplars). Term weights are inverse document
frequencies in ordinary text, counted in all rows of the table. A first pass sets aside the texts that could be residue
under some weights (most could not) and counts the terms of all others, and of those set aside that are no residue under
``BACKGROUND``; so no group of copies of residue moves the weights. ``BACKGROUND`` counts as 1,000 texts more, so that a table
of one row is judged like any other. The texts set aside are then judged under these weights. A document's passages - windows of words, template-like spans with their neighbours,
and the document as a whole - retrieve exemplars through the index and are scored by TF-IDF containment, the share of
a passage's weight that the retrieved exemplars hold:

* filler: some window of ``WINDOW`` words lies almost wholly within one filler exemplar, or an exemplar of at most
  ``WINDOW`` words stands whole in a sentence and holds ``SENTENCE_SHARE`` of its weight - anywhere, if it says where
  the text goes (here, hier, ici, aquí) - unless the words around talk about such texts;
* template field: a delimited span is a passage whose delimiter, where ordinary text never has it, is a term of great
  weight; the field exemplars that it holds whole are retrieved, and they hold ``FIELD_SHARE`` of its weight, unless its
  neighbourhood lies within a counter-exemplar (texts that talk about such fields);
* error page or notice: nearly all of the document's weight lies within the error, notice and site-chrome exemplars,
  and a fair share within those that it holds, at least one of them an error or notice.

Defined cases: null, empty and blank texts are no case; null ids give no row; texts are read whole, at any length;
repeated rows of one id give one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.runtime import cut, ship, spread

WINDOW = 6
FILLER_SHARE = 0.9
#: Share of a page's weight within the words of all page exemplars, and within the exemplars that it holds.
PAGE_SHARE = 0.85
RETRIEVED_SHARE = 0.25
#: Share of a page wording's weight that the document must hold.
WORDING_SHARE = 0.7
#: Share of a sentence's weight that a short filler exemplar holds, so that a phrase in passing is no filler.
SENTENCE_SHARE = 0.5
TOKEN = re.compile(r"[^\W\d_]+|\d+")

EXEMPLARS: dict[str, list[str]] = {
    "filler": [
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum",
        "at vero eos et accusam et justo duo dolores et ea rebum stet clita kasd gubergren no sea takimata sanctus est",
        "bla bla blah blah", "foo bar baz qux", "text goes here", "your text here", "sample paragraph sample text", "add some text",
        "this is placeholder copy and will be replaced later", "this is placeholder text", "dummy text", "test test", "xxx xxx xxx", "asdf asdfgh qwerty qwertz sdfsdf zxcv qweqwe jkl qwe sdf dfg asd",
        "describe your duties here", "describe your achievements here", "bullet point text job title one company name two three city country month year some responsibility another responsibility", "content coming soon", "insert text here", "type something here", "abc abc abc",
        "hier steht ein blindtext", "beispieltext beispieltext", "texte de remplissage", "texte d exemple", "texto de relleno", "texto de ejemplo", "hier text einfügen", "aquí va el texto", "votre texte ici",
        "filler paragraph for layout purposes only", "filler text", "placeholder text", "this is dummy text", "este es un texto de relleno sin sentido", "este es un texto de ejemplo", "ceci est un texte de remplissage", "dies ist ein blindtext", "dies ist ein platzhaltertext", "platzhaltertext einfügen", "your content here", "insert your text here", "enter text here",
    ],
    "field": [
        "first name", "last name", "full name", "your name here", "candidate name", "manager name", "company name", "name of employer", "employer", "company", "department", "job title", "position", "role",
        "date", "start date", "end date", "today s date", "city", "state", "country", "phone number", "email address", "skill", "skills", "insert", "add", "enter", "your", "here", "name", "phone", "email", "address", "number", "title", "signature", "amount", "industry", "project", "language", "certification", "website", "linkedin url", "your name", "recipient name", "hiring manager", "company address", "street address", "zip code", "postal code", "recipient", "school", "university", "degree", "years", "salary", "reference number",
        "ihr name", "ihre", "name des bewerbers", "vorname", "nachname", "anschrift", "straße", "postleitzahl", "unterschrift", "unternehmen", "firmenname", "firma", "stelle", "hier einfügen", "datum", "abteilung", "ansprechpartner", "ort", "telefon",
        "votre nom", "votre", "prénom", "nom", "adresse", "société", "signature", "intitulé du poste", "nom de l entreprise", "entreprise", "poste", "insérer ici", "ville", "téléphone",
        "su nombre", "nombre", "apellido", "apellidos", "dirección", "correo", "firma", "cargo", "nombre de la empresa", "empresa", "puesto", "fecha", "insertar aquí", "ciudad", "teléfono",
    ],
    "mention": [
        "wrote mail merge templates whose fields such as are filled from the staff database",
        "templates with fields such as that are filled in later", "placeholders such as are replaced from the database", "tools in order of use packaging defect rate budget",
    ],
    "error": [
        "http #", "http error #", "error #", "# not found", "# page missing", "# page not found", "the profile at this address does not exist", "the vacancy at this address does not exist", "the page at this address does not exist",
        "the profile at this address was removed", "the vacancy at this address was removed", "the page at this address was removed", "the profile at this address has moved", "the vacancy at this address has moved", "the page at this address has moved",
        "# internal server error", "# bad gateway", "# gateway timeout", "# service unavailable", "# forbidden", "# unauthorized", "apache server at port #",
        "oops something went wrong", "something went wrong on our side", "try reloading the vacancy in a few minutes", "try reloading the page in a few minutes", "something went wrong please try again later",
        "fatal error call to undefined function load cv in srv board view php on line #", "warning undefined variable in php on line #", "uncaught exception stack trace",
        "traceback most recent call last file render py line # in show profile keyerror candidate", "error establishing a database connection",
        "your session has timed out", "please sign in again to continue with your application", "your session has expired", "please log in again",
        "node web # request #", "java lang illegalstateexception", "java lang nullpointerexception", "no template for vacancy #", "at board view page render page java #",
        "this job posting is no longer available", "this page is no longer available", "the page you requested could not be found",
        "we ll be back soon", "the careers portal is down for scheduled maintenance", "this site is under maintenance", "too many requests you have been rate limited for # minutes",
        "access denied", "you do not have permission to view this candidate file", "you don t have permission to access this resource on this server",
        "status # error forbidden", "message token expired", "status # error message", "invalid request",
        "erreur #", "la page demandée est introuvable", "accès refusé", "votre session a expiré", "reconnectez vous", "erreur interne du serveur",
        "fehler #", "seite nicht gefunden", "die gewünschte stellenanzeige existiert nicht mehr", "zugriff verweigert", "ihre sitzung ist abgelaufen", "bitte melden sie sich erneut an", "interner serverfehler",
        "no se encuentra la página solicitada", "acceso denegado", "su sesión ha caducado", "error interno del servidor",
        # messages of common servers and frameworks
        "the requested url was not found on this server", "the resource cannot be found", "the resource you are looking for has been removed had its name changed or is temporarily unavailable", "sorry the page you are looking for could not be found", "the page you are looking for doesn t exist or has been moved",
        "we couldn t find the page you were looking for", "this page could not be found", "this page isn t available", "the link you followed may be broken or the page may have been removed", "file or directory not found", "no input file specified",
        "the server encountered an internal error or misconfiguration and was unable to complete your request", "the server is temporarily unable to service your request due to maintenance downtime or capacity problems please try again later", "an unexpected error has occurred", "an error occurred while processing your request",
        "a client side exception has occurred see the browser console for more information", "application error", "this site can t be reached", "server error in application", "runtime error", "there has been a critical error on this website", "checking if the site connection is secure",
        "you do not have access to this page", "you are not authorized to view this page", "your connection was interrupted", "the request timed out", "bad request", "method not allowed", "the server returned an invalid or incomplete response", "too many redirects",
        "cette page n existe pas", "cette page n existe plus", "une erreur est survenue", "service indisponible", "die seite wurde nicht gefunden", "ein fehler ist aufgetreten", "dienst nicht verfügbar", "página no encontrada", "se ha producido un error", "servicio no disponible",
    ],
    "notice": [
        "please enable javascript to view this profile", "you need to have javascript turned on for this vacancy board to work", "this page relies on scripts that were blocked allow them and reload",
        "noscript scripts are required to load this resume noscript", "sorry this app does not run without js", "javascript is disabled in your browser the application form cannot be shown", "you need to enable javascript to run this app",
        "loading if nothing happens switch on javascript and refresh", "one moment we are checking your browser before you can see the job list scripts and cookies must be allowed",
        "your browser is out of date or has scripting switched off supported browsers are listed in the help pages", "this website requires javascript and cookies",
        "este sitio necesita que los scripts estén permitidos", "active javascript para ver esta oferta", "diese anwendung benötigt aktivierte skripte", "bitte aktivieren sie javascript um das profil zu sehen",
        "please enable javascript to continue", "please enable cookies and reload the page", "javascript is required to view this page", "javascript must be enabled in order to use this site", "your browser does not support javascript", "please turn on javascript in your browser and reload the page", "this page requires javascript",
        "enable javascript and cookies to continue", "bitte aktivieren sie javascript in ihrem browser", "veuillez activer javascript dans votre navigateur", "por favor active javascript en su navegador", "esta página requiere javascript",
        "veuillez activer javascript pour afficher ce profil cette offre", "ce site ne fonctionne pas sans scripts", "cette page nécessite javascript activez les scripts", "ce site ne fonctionne pas sans javascript pour consulter cette offre", "activez javascript pour voir le profil",
    ],
    "chrome": [
        "nginx", "incident #", "reference # #", "return to search results", "follow our job alerts", "menu close", "language en de fr es", "skip to content", "orvale careers all rights reserved", "search vacancies keyword town", "back to top", "privacy notice terms of use cookie settings",
        "home jobs sign in contact", "post a vacancy for employers help", "about us sitemap accessibility", "log in register",
    ],
}

#: Delimiters that ordinary text never has around words, and those that it has; a span is what stands between them.
_STRONG = r"\{\{\s*[\w. -]{1,80}\}\}|\{%\s*[\w. -]{1,80}%\}|\$\{\s*[\w. -]{1,80}\}|\[\[\s*[\w. -]{1,80}\]\]|<<\s*[\w. -]{1,80}>>|@@[\w. -]{1,80}@@|##[A-Z][\w. -]{0,80}##|\*\|[\w. -]{1,80}\|\*|%[A-Z][A-Z_]{2,80}%|(?<![\w_])(?-i:__[A-Z][A-Z_]{1,80}__)(?![\w_])|(?<!\w)INSERT [A-Z][A-Z ]{1,80} HERE(?!\w)"
_WEAK = r"\[[^\[\]\n\r]{2,200}\]|\{[^{}\n\r]{2,200}\}|<[^<>\n\r]{2,200}>|&lt;[^<>&\n\r]{2,200}&gt;|«[^«»\n\r]{2,200}»|_{4,}\s*\([^()\n\r]{2,200}\)|\([^()\n\r]{2,200}\)"
STRONG_SPAN = re.compile(_STRONG, re.I)
WEAK_SPAN = re.compile(_WEAK)
#: The term that a strong delimiter adds to its passage, and its weight: that of so many words unknown to ordinary text.
DELIMITER = "{}"
DELIMITER_WORDS = 25
FIELD_SHARE = 0.8
#: Delimiters that ordinary prose also uses, so the words inside must say that something is to be added.
ASKS = {"insert", "add", "enter", "name of", "einfügen", "insérer", "insertar"}
#: What any match of a strong span contains; most texts have none of it.
_SIGNS = ("{{", "{%", "${", "[[", "<<", "@@", "##", "*|", "__")
_RARE_SIGNS = re.compile(r"%[A-Za-z]|[Ii][Nn][Ss][Ee][Rr][Tt] ")


#: Document frequencies in 1,000 ordinary texts, to which those of the table are added; other terms are in fewer than one.
BACKGROUND = {
    term: docs
    for docs, terms in {
        969: "#", 787: "a", 726: "in", 722: "with", 719: "the", 717: "and", 705: "for to", 701: "at", 688: "is", 611: "of", 578: "about s we", 574: "t", 572: "can this years", 570: "post", 569: "are candidate out", 565: "or",
        387: "on", 383: "first", 330: "an", 324: "last", 317: "required", 287: "two", 260: "staff", 180: "site", 175: "requests", 171: "year", 159: "manager", 154: "under", 141: "line", 137: "budget", 125: "de", 124: "board",
        123: "from", 121: "three", 120: "notice", 119: "all", 118: "full", 117: "before company", 109: "un", 100: "orvale point", 92: "die skills", 87: "und", 86: "ein", 81: "end", 75: "pour", 74: "month", 70: "zu",
        69: "internal", 68: "um", 67: "le poste stelle", 66: "wrote", 59: "para", 57: "scheduled su", 55: "en", 54: "el les puesto rate", 53: "error service", 51: "et", 47: "minutes", 45: "d server y", 44: "los",
        42: "access scripts", 38: "work", 37: "port", 31: "order", 29: "as java", 28: "load", 26: "database", 23: "content", 22: "active", 21: "pages", 19: "job test", 17: "maintenance packaging", 16: "javascript menu",
        14: "alerts", 12: "language web", 11: "incident", 10: "copy", 8: "sample", 6: "defect ipsum lorem py replaced tools use", 5: "call denied disabled dummy expired fields filled form help log mail merge page placeholder session such templates text that unavailable were whose",
        3: "don here ll you", 2: "back name title", 1: "your",
    }.items()
    for term in terms.split()
}
BACKGROUND_TEXTS = 1000


#: Words by which an exemplar says that a text is still to come in this place.
_HERE = {"here", "hier", "ici", "aquí"}
#: Words of sentences that talk about filler: it was replaced, taught, checked for.
_TALK = re.compile(
    r"(?<!\w)(?:replac\w+|remov\w+|delet\w+|swapp\w+|rewr\w+|taught|teach\w*|explain\w+|instead of|used|uses|using|how|where|which|such as|like|says?|said|reads?|called|wrote|check\w*|search\w*|ersetz\w*|entfern\w*|statt|remplac(?!eme)\w+|supprim\w+|au lieu|reemplaz\w+|sustitu\w+|elimin\w+|en lugar)(?!\w)"
)
_BREAK = re.compile(r"[.!?;:|•\n\r]")


class Index:
    """Inverted index of the exemplars, with term weights from document frequencies."""

    def __init__(self, frequencies: dict[str, float], documents: int):
        self.weight = {t: math.log((documents + 1) / (frequencies.get(t, 0) + 1)) + 1 for t in frequencies}
        self.default = math.log(documents + 1) + 1
        self.exemplars: list[tuple[str, frozenset[str], float]] = []
        self.postings: dict[str, list[int]] = defaultdict(list)
        for label, texts in EXEMPLARS.items():
            for text in texts:
                terms = frozenset(tokens(text))
                for t in terms:
                    self.postings[t].append(len(self.exemplars))
                self.exemplars.append((label, terms, sum(self.of(t) for t in terms)))
        self.weight[DELIMITER] = DELIMITER_WORDS * self.default
        self.postings[DELIMITER].append(len(self.exemplars))
        self.exemplars.append(("field", frozenset([DELIMITER]), self.weight[DELIMITER]))
        #: (terms, phrase, whether it says where the text goes) of the filler exemplars that are shorter than a window
        self.phrases = []
        for text in EXEMPLARS["filler"]:
            words = tokens(text)
            if len(words) <= WINDOW and len(set(words)) > 1:
                pattern = re.compile(r"(?<![^\W_])" + r"[^\w.!?;|•\n\r]{1,3}".join(map(re.escape, words)) + r"(?![^\W_])")
                self.phrases.append((frozenset(words), pattern, not _HERE.isdisjoint(words)))
        self.filler_terms = {t for label, terms, _ in self.exemplars if label == "filler" for t in terms}
        self.mention_terms = {t for label, terms, _ in self.exemplars if label == "mention" for t in terms}
        self.page_vocabulary = {t for label, terms, _ in self.exemplars if label in ("error", "notice", "chrome") for t in terms}
        self.page_terms = {t for label, terms, _ in self.exemplars if label in ("error", "notice") for t in terms}

    def of(self, term: str) -> float:
        return self.weight.get(term, self.default)

    def share(self, passage: list[str], terms) -> float:
        """TF-IDF containment of a passage in a set of terms."""
        total = sum(self.of(t) for t in passage)
        return sum(self.of(t) for t in passage if t in terms) / total if total else 0.0

    def retrieved(self, present: frozenset[str], labels: tuple[str, ...], held_share: float) -> tuple[set[str], set[str]]:
        """(terms, labels) of the exemplars that the index finds for a passage and that it holds to this share of their weight."""
        union: set[str] = set()
        found: set[str] = set()
        for e in {e for t in present for e in self.postings.get(t, ())}:
            label, terms, total = self.exemplars[e]
            if label in labels and sum(self.of(t) for t in terms & present) >= held_share * total:
                union |= terms
                found.add(label)
        return union, found

    def best(self, passage: list[str], label: str) -> float:
        held: dict[int, float] = defaultdict(float)
        total = 0.0
        for t in passage:
            w = self.of(t)
            total += w
            for e in self.postings.get(t, ()):
                if self.exemplars[e][0] == label:
                    held[e] += w
        return max(held.values(), default=0.0) / total if total else 0.0


def tokens(text: str) -> list[str]:
    """Words without digits or underscores, lower-cased; a number is one sign."""
    return ["#" if t[0].isdigit() else t for t in TOKEN.findall(text.lower().replace("#", " 0 "))]


def _words(text: str) -> list[str]:
    return ["#" if t[0].isdigit() else t for t in TOKEN.findall(text.lower())]


def _windows(words: list[str], index: Index) -> list[list[str]]:
    """The windows of filler words but for one at most."""
    if len(words) < 2 or index.filler_terms.isdisjoint(words):
        return []
    known = np.fromiter(map(index.filler_terms.__contains__, words), dtype=bool, count=len(words))
    size = min(WINDOW, len(words))
    dense = np.convolve(known, np.ones(size, dtype=int), "valid")
    return [words[at : at + size] for at in np.flatnonzero(dense >= size - 1).tolist()]


def has_filler(words: list[str], index: Index) -> bool:
    for window in _windows(words, index):
        size = len(window)
        if index.best(window, "filler") >= FILLER_SHARE and sum(index.of(w) for w in window) >= 3.0 * size:
            return True
    return False


def has_phrase(text: str, words: list[str], index: Index) -> bool:
    """Whether a short filler exemplar stands whole in a sentence that is little else."""
    present = frozenset(words)
    low = None
    for terms, phrase, here in index.phrases:
        if not terms <= present:
            continue
        low = text.lower() if low is None else low
        for m in phrase.finditer(low):
            start = max((b.end() for b in _BREAK.finditer(low, max(0, m.start() - 300), m.start())), default=max(0, m.start() - 300))
            stop = _BREAK.search(low, m.end(), m.end() + 300)
            end = stop.start() if stop else min(len(low), m.end() + 300)
            if _TALK.search(low[start : m.start()]) or _TALK.search(low[m.end() : end]):
                continue
            if here or index.share(_words(low[start:end]), terms) >= SENTENCE_SHARE:
                return True
    return False


def _spans(text: str) -> Iterator[tuple[re.Match, list[str]]]:
    """Delimited spans that may be fields, and their words."""
    spans = [(m, True) for m in STRONG_SPAN.finditer(text)] if any(x in text for x in _SIGNS) or _RARE_SIGNS.search(text) else []
    spans += [(m, False) for m in WEAK_SPAN.finditer(text)]
    for m, strong in spans:
        span = m.group(0)
        passage = [DELIMITER] * strong + _words(span.replace("_", " ").replace("&lt;", " ").replace("&gt;", " "))
        if strong or (passage and (span[0] not in "(" or any(a in " ".join(passage) for a in ASKS)) and not (span[0] in "<{" and span[1:2] == "/")):
            yield m, passage


def has_field(text: str, index: Index) -> bool:
    def mentioned(start: int, end: int) -> bool:
        around = _words(text[max(0, start - 70) : start])[-7:] + _words(text[end : end + 50])[:5]
        known = {t for t in around if t in index.mention_terms}
        return len(known) >= 4 and index.best(around, "mention") >= 0.6

    for m, passage in _spans(text):
        if index.share(passage, index.retrieved(frozenset(passage), ("field",), 1.0)[0]) >= FIELD_SHARE and not mentioned(m.start(), m.end()):
            return True
    return False


def is_page(words: list[str], index: Index) -> bool:
    present = frozenset(words)
    if not present or index.page_terms.isdisjoint(present):
        return False
    if index.share(words, index.page_vocabulary) < PAGE_SHARE:
        return False
    union, labels = index.retrieved(present, ("error", "notice", "chrome"), WORDING_SHARE)
    return bool(labels & {"error", "notice"}) and index.share(words, union) >= RETRIEVED_SHARE


def possible(text: str, words: list[str], index: Index) -> bool:
    """Whether a text could be residue under some weights.

    Words that no exemplar has weigh most, so a page's share by weight is at most its share by number of words.
    """
    present = frozenset(words)
    if any(terms <= present for terms, _, _ in index.phrases) or next(_spans(text), None) or _windows(words, index):
        return True
    return not index.page_terms.isdisjoint(present) and sum(map(index.page_vocabulary.__contains__, words)) >= (PAGE_SHARE - 1e-9) * len(words)


def label(text: str | None, index: Index) -> str | None:
    """field, filler, page, or null for a real text."""
    if text is None or not text.strip():
        return None
    if has_field(text, index):
        return "field"
    words = _words(text)
    if has_filler(words, index) or has_phrase(text, words, index):
        return "filler"
    return "page" if is_page(words, index) else None


def exemplar_terms() -> list[str]:
    return sorted({t for texts in EXEMPLARS.values() for x in texts for t in tokens(x)})


def background() -> Index:
    """The index under the fixed frequencies of ordinary text."""
    return Index({t: BACKGROUND.get(t, 0) for t in exemplar_terms()}, BACKGROUND_TEXTS)


def counted(frequencies: dict[str, int], documents: int) -> Index:
    """The index under frequencies of the table's ordinary texts and those of ``BACKGROUND``, in 1,000 texts."""
    scale = BACKGROUND_TEXTS / (documents + BACKGROUND_TEXTS)
    return Index({t: (frequencies.get(t, 0) + BACKGROUND.get(t, 0)) * scale for t in exemplar_terms()}, BACKGROUND_TEXTS)


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n): the texts that could be residue, n null; and, id null, each task's counts by term, of all texts under ''."""
    shared = docs.sparkSession.sparkContext.broadcast(background())  # some hundred terms

    def scan(batches):
        index, counts = shared.value, Counter()
        terms = frozenset(exemplar_terms())
        names = ["doc_id", "text", "n"]
        for batch in batches:
            ids, texts = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text.strip():
                    continue
                words = _words(text)
                if possible(text, words, index):
                    ids.append(i)
                    texts.append(text)
                    if label(text, index):
                        continue
                counts[""] += 1
                counts.update(terms.intersection(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.nulls(len(ids), pa.int64())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(counts), pa.int64()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names)

    return docs.mapInArrow(scan, "doc_id long, text string, n long")


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind) of the documents with residue, one row each."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    ship(docs.sparkSession)
    scanned = cut(_scanned(spread(docs, "doc_id")))
    totals = {r.text: r.n for r in scanned.where("n is not null").groupBy("text").agg(F.sum("n").alias("n")).collect()}  # the exemplars' terms
    shared = docs.sparkSession.sparkContext.broadcast(counted(totals, totals.get("", 0)))  # some hundred terms

    def detect(batches):
        for batch in batches:
            ids, kinds = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                kind = label(text, shared.value)
                if kind:
                    ids.append(i)
                    kinds.append(kind)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds)], ["doc_id", "kind"])

    return scanned.where("n is null").select("doc_id", "text").mapInArrow(detect, "doc_id long, kind string").dropDuplicates(["doc_id"])


def without_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table without the documents that are or hold residue; null and blank texts stay."""
    bad = residue(df, id_col, text_col).select(F.col("doc_id").alias("_residue_id"))
    return df.join(bad, df[id_col] == bad["_residue_id"], "left_anti")
