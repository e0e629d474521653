"""One consistent form of text that looks the same but is stored in other characters (problem 5).

A compiled transducer goes over the text once, grapheme cluster by grapheme cluster, and replaces the longest source it
knows: letters with the accents that stand apart from them (of a letter with one and with two accents the longer source is
taken), full-width and styled letters, ligatures, blanks of other widths, invisible characters. Look-alike letters of another
alphabet are sources of the same mapping that only count where the word around them is Latin. The mapping is computed from
rules over the Unicode character database and checked for conflicts.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that look like a Latin letter in every usual typeface.
LOOKALIKES = {
    "Cyrillic": dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXYQWaesijopcyxhdqwl")),
    "Greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj")),
    "Armenian": dict(zip("ՕՏԼօսոհց", "OSLounhg")),
    "Cherokee": dict(zip("ᎪᎬᎳᎷᎻᏀᏃᏚᏞᏟᏢᏦᏴ", "AEWMHGZSLCPKB")),
}
#: Letters that pass for a Latin one only inside a word that is Latin otherwise.
NEARLY = {"Greek": dict(zip("αικρυχγη", "aikpuxyn")), "Cyrillic": dict(zip("вгкмнтп", "brkmhtn"))}

_INVISIBLE_RANGES = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
_SCRIPT = {s: regex.compile(rf"\p{{Script={s}}}") for s in (*LOOKALIKES, "Latin")}
_KEEPS_JOINERS = regex.compile(r"[\p{Script=Arabic}\p{Script=Devanagari}\p{Script=Bengali}\p{Script=Tamil}\p{Script=Telugu}\p{Script=Kannada}\p{Script=Malayalam}\p{Script=Sinhala}\p{Script=Syriac}\p{Script=Mongolian}]")
_PICTURE = regex.compile(r"\p{Extended_Pictographic}")
_CLUSTER = regex.compile(r"\X")


def _invisible(cp: int, ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" and not 0x600 <= cp <= 0x605 and cp != 0x6DD or any(a <= cp <= b for a, b in _INVISIBLE_RANGES)


def _skipped(cp: int) -> bool:
    """Surrogates, private use and unassigned planes."""
    return 0xD800 <= cp < 0xF900 or 0x323B0 <= cp < 0xE0000 or cp >= 0xE1000


@lru_cache(maxsize=1)
def build_mapping() -> dict[str, str]:
    """Source (one character or more) -> target, by rule. Raises if two rules disagree or if a target would be mapped again."""
    out: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if source != target and out.setdefault(source, target) != target:
            raise ValueError(f"conflict at {source!r}")

    for cp in range(0x80, 0x110000):
        if _skipped(cp):
            continue
        ch = chr(cp)
        cat, parts = unicodedata.category(ch), unicodedata.decomposition(ch)
        if _invisible(cp, ch):
            put(ch, "")
        elif cat == "Zs":
            put(ch, " ")
        elif parts.startswith("<"):
            kind = parts.partition(">")[0]
            plain = unicodedata.normalize("NFKC", ch)
            if kind in ("<wide", "<narrow", "<font") or kind == "<circle" and len(plain) == 1 and plain.isalnum() or kind == "<compat" and (0xFB00 <= cp <= 0xFB06 or 0xFB13 <= cp <= 0xFB17):
                put(ch, plain)
        elif parts and not 0xAC00 <= cp <= 0xD7A3:
            # composed letters from any mixture of letters and accents in canonical order; Hangul composes by arithmetic
            whole, apart = unicodedata.normalize("NFC", ch), unicodedata.normalize("NFD", ch)
            put(ch, whole)
            put(apart, whole)
    for source, target in out.items():
        if "".join(out.get(c, c) for c in target) != target or target in out and out[target] != target:
            raise ValueError(f"{source!r} goes on to change")
    return out


@lru_cache(maxsize=1)
def look_alike_mapping() -> dict[str, tuple[dict[str, str], dict[str, str]]]:
    """Of each alphabet: look-alikes for whole words, and those inside of words that are Latin otherwise. Part of the mapping,
    and checked with it: no source has another target, and no target is a source of anything."""
    always = build_mapping()
    out = {s: (LOOKALIKES[s], LOOKALIKES[s] | NEARLY.get(s, {})) for s in LOOKALIKES}
    sources = {c for _, near in out.values() for c in near}
    for whole, near in out.values():
        for source, target in near.items():
            if source in always or target in always or target in sources or whole.get(source, target) != target:
                raise ValueError(f"conflict at {source!r}")
    return out


class Transducer:
    """The compiled mapping: a trie over code points with longest match, applied per grapheme cluster."""

    def __init__(self) -> None:
        self.trie: dict = {}
        for source, target in build_mapping().items():
            node = self.trie
            for ch in source:
                node = node.setdefault(ch, {})
            node[""] = target
        self._clusters: dict[str, str] = {}
        tables = look_alike_mapping()
        self.like, self.near = {s: t[0] for s, t in tables.items()}, {s: t[1] for s, t in tables.items()}

    def _longest(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            node, j, best, end = self.trie, i, None, i + 1
            while j < len(text) and text[j] in node:
                node, j = node[text[j]], j + 1
                if "" in node:
                    best, end = node[""], j
            out.append(text[i] if best is None else best)
            i = end
        return "".join(out)

    def cluster(self, c: str) -> str:
        """The consistent form of one grapheme cluster."""
        got = self._clusters.get(c)
        if got is None:
            if len(c) > 1 and _PICTURE.search(c) and not c[0].isascii():
                got = c  # joiners and selectors belong to the picture
            elif len(c) > 1 and _KEEPS_JOINERS.match(c):
                got = unicodedata.normalize("NFC", c)
            else:
                # in canonical order, in which the sources are; what is left apart (Hangul, accents of styled letters) composes after
                got = unicodedata.normalize("NFC", self._longest(unicodedata.normalize("NFD", c)))
            if len(self._clusters) > 100_000:
                self._clusters.clear()
            self._clusters[c] = got
        return got

    def parts(self, text: str) -> list[tuple[str, int]]:
        """(consistent form, position of the first code point) of each cluster that leaves something."""
        out, at = [], 0
        for c in _CLUSTER.findall(text):
            form = c if c.isascii() else self.cluster(c)
            if form:
                out.append((form, at))
            at += len(c)
        # an accent that an invisible character had cut off from its letter
        joined: list[tuple[str, int]] = []
        for form, p in out:
            if joined and unicodedata.combining(form[0]):
                joined[-1] = (joined[-1][0] + form, joined[-1][1])
            else:
                joined.append((form, p))
        if len(joined) < len(out):
            joined = [(form if len(form) == 1 else unicodedata.normalize("NFC", form), p) for form, p in joined]
        self._look_alikes(joined)
        return joined

    def _look_alikes(self, out: list[tuple[str, int]]) -> None:
        words, k = [], 0
        while k < len(out):
            if out[k][0][0].isalpha():
                j = k
                while j < len(out) and out[j][0][0].isalpha():
                    j += 1
                words.append((k, j))
                k = j
            else:
                k += 1
        latin_words, pure, foreign = 0, [], set()
        for a, b in words:
            chars = [out[k][0] for k in range(a, b)]
            scripts = {s for s in LOOKALIKES if any(_SCRIPT[s].match(c) for c in chars)}
            if not scripts:
                latin_words += any(_SCRIPT["Latin"].match(c) for c in chars)
                continue
            if any(_SCRIPT["Latin"].match(c) for c in chars):
                table = {c: t for s in scripts for c, t in self.near[s].items()}
                if all(c in table or not any(_SCRIPT[s].match(c) for s in scripts) for c in chars):
                    latin_words += 1
                    for k in range(a, b):
                        out[k] = (table.get(out[k][0], out[k][0]), out[k][1])
                continue
            table = {c: t for s in scripts for c, t in self.like[s].items()}
            if all(c in table for c in chars):
                pure.append((a, b, table, scripts))
            else:
                foreign |= scripts
        for a, b, table, scripts in pure:
            # a word all of look-alikes is Latin among Latin words, unless the text has real words of its alphabet
            if latin_words and not (scripts & foreign):
                for k in range(a, b):
                    out[k] = (table[out[k][0]], out[k][1])

    def apply(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        return "".join(f for f, _ in self.parts(text))

    def with_positions(self, text: str) -> tuple[str, list[int]]:
        """The consistent form, and for each of its code points the position in `text` that it comes from."""
        if text.isascii():
            return text, list(range(len(text)))
        form, at = [], []
        for f, p in self.parts(text):
            form.append(f)
            at += [p] * len(f)
        return "".join(form), at


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def _batch(texts: pd.Series) -> pd.Series:
    t = transducer()
    known = {x: t.apply(x) for x in texts.dropna().unique()}
    return texts.map(lambda x: known.get(x))


def canonical(col: str | Column) -> Column:
    """The consistent form of a text column, in Arrow batches. Null stays null, empty stays empty."""
    return F.pandas_udf(_batch, "string")(col)


def text_values(candidates: DataFrame, experience: DataFrame) -> DataFrame:
    """(field, row_id, line_no, text): names with line number 0, and description lines numbered from 1 by array position.

    Null names, null arrays and null lines have no text and give no row; repeated rows are kept.
    """
    names = candidates.select(F.lit("name").alias("field"), F.col("cand_id").alias("row_id"), F.lit(0).alias("line_no"), F.col("name").alias("text"))
    lines = experience.select("exp_id", F.posexplode("description").alias("p", "text")).select(F.lit("description").alias("field"), F.col("exp_id").alias("row_id"), (F.col("p") + 1).alias("line_no"), "text")
    return names.unionByName(lines).where("text is not null")


def canonical_values(candidates: DataFrame, experience: DataFrame) -> DataFrame:
    """The values of `text_values` with `canonical` beside `text`. Narrow. Plain ASCII text is its own consistent form, so
    only other text goes through Python."""
    v = text_values(candidates, experience)
    plain = ~F.col("text").rlike(r"[^\x00-\x7F]")
    return v.where(plain).withColumn("canonical", F.col("text")).unionByName(v.where(~plain).withColumn("canonical", canonical("text")))


def inconsistent_values(candidates: DataFrame, experience: DataFrame) -> DataFrame:
    """(field, row_id, line_no) of the values that are not in the consistent form."""
    other = text_values(candidates, experience).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return other.withColumn("canonical", canonical("text")).where("canonical != text").select("field", "row_id", "line_no")
