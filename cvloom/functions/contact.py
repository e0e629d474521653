"""E-mail address, phone number and name of a cleaned text. All are Column -> Column and give null where nothing is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cvloom.functions import patterns as P
from cvloom.functions.text import first_match, has_word, letters, lines_of, strip, words_of
from cvloom.functions.vocab import HEADING_WORDS, JOB_WORDS, NAME_WINDOW


def email(text: Column) -> Column:
    """The first e-mail address, in lower case."""
    return F.lower(first_match(text, P.EMAIL))


def phone(text: Column) -> Column:
    """The first phone number as written: at least seven digits, not followed by % or /; a label at a line's start is
    skipped. Runs may go over line ends, and a range of years counts as a number."""
    body = F.array_join(F.transform(lines_of(text), lambda x: strip(F.regexp_replace(x, P.CONTACT_LABEL, ""))), "\n")
    found = F.regexp_extract_all(body, F.lit(P.PHONE + "[%/]?"), F.lit(0))
    good = F.filter(found, lambda x: ~x.rlike("[%/]$") & (F.length(F.regexp_replace(x, r"\D", "")) >= 7))
    return strip(F.get(good, F.lit(0)))


def looks_like_name(line: Column) -> Column:
    """Two to five words, mostly letters, no address, link, label, heading or job word."""
    n = F.size(words_of(line))
    return (
        F.length(line).between(2, 50)
        & ~line.contains("@")
        & ~line.rlike(P.URL_START)
        & ~line.rlike(P.CONTACT_LABEL)
        & n.between(2, 5)
        & ~has_word(line, HEADING_WORDS + JOB_WORDS)
        & (letters(line) / F.length(line) >= 0.6)
    )


def _capitalise(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def title_case(raw: Column) -> Column:
    """Each word capitalised; of a word with hyphens each part, or else of one with apostrophes each part."""

    def parts(w: Column, mark: str) -> Column:
        return F.array_join(F.transform(F.split(w, mark), _capitalise), mark)

    return F.array_join(F.transform(words_of(raw), lambda w: F.when(w.contains("-"), parts(w, "-")).when(w.contains("'"), parts(w, "'")).otherwise(_capitalise(w))), " ")


def name(text: Column) -> Column:
    """The first of the first twelve non-empty lines that looks like a name, in title case."""
    top = F.slice(F.filter(F.transform(lines_of(text), strip), lambda x: x != ""), 1, NAME_WINDOW)
    return title_case(F.get(F.filter(top, looks_like_name), F.lit(0)))


def contact(text: Column) -> Column:
    return F.struct(name(text).alias("name"), email(text).alias("email"), phone(text).alias("phone"))
