"""Text normalisation and line helpers."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = "\u00a0" + "".join(map(chr, range(0x2000, 0x200C))) + "\u202f\u205f\u3000\ufeff"


#: White space of any kind.
_SPACE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(_SPACE))


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Composed form. Spark has no function for it, so this is the one Arrow step of the cleaning."""
    return F.pandas_udf(_nfc, "string")(c)


def clean_text(c: Column) -> Column:
    """Cleaned text: composed, blanks and line ends made alike, control characters gone, lines stripped, runs of blanks and
    of empty lines shortened. Null stays null; blank text gives the empty string. Case, punctuation and repeated lines are
    kept."""
    t = F.translate(nfc(c), "\u2028\u2029" + _BLANKS, "\n\n" + " " * len(_BLANKS))
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, "[ \u1680]*\n[ \u1680]*", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n")


def blank_to_null(c: Column) -> Column:
    """Null instead of text without anything but white space."""
    return F.when(c.rlike(r"(?U)\S"), c)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def letters(c: Column) -> Column:
    """Number of letters."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, null if there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def capitalised_words(c: Column) -> Column:
    """Does every word that begins with a letter begin with a capital?"""
    return ~c.rlike(r"(?:^|\s)(?:\p{Ll}|\p{Lo}|\p{Lm})")


def has_word(c: Column, words: list[str]) -> Column:
    """Is one of the blank-separated words of the text, in lower case, among `words`?"""
    return F.arrays_overlap(words_of(F.lower(c)), constant(words, "array<string>"))


def constant(value, kind: str) -> Column:
    """A list or dict as one literal, which the optimizer folds. A literal per item would take the planner far longer."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(expr: Column, *arrays: str) -> Column:
    """`expr`, with a second reference to array columns that it uses inside lambdas.

    The optimizer puts a column's definition in place of a single reference, even of one inside a lambda, which would then
    be evaluated for every element. Columns with two references are computed once, in a projection of their own.
    """
    ok = F.lit(True)
    for a in arrays:
        ok = ok & (F.coalesce(F.size(a), F.lit(0)) >= 0)
    return F.when(ok, expr)
