"""Headings and the sections between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvloom.functions.text import constant, let, lines_of, strip
from cvloom.functions.vocab import MAX_HEADING, SECTION_ALIASES, SENTENCE_WORDS


def live_aliases() -> dict[str, str]:
    """Heading -> section, without headings that hold a sentence word, which are never taken for headings."""
    return {a: s for s, names in SECTION_ALIASES.items() for a in names if not set(a.split()) & set(SENTENCE_WORDS)}


def heading_key(line: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(line), r"[\s:.\-–—|]+$", "")))


def section_of(line: Column) -> Column:
    """The section that a line opens, null if it is no heading."""
    table = constant(live_aliases(), "map<string,string>")
    return F.when(F.length(strip(line)) <= MAX_HEADING, F.try_element_at(table, heading_key(line)))


SECTIONS_TYPE = "array<struct<section:string,body:string>>"


def sections(text: Column) -> Column:
    """The sections of a cleaned text as SECTIONS_TYPE, in order of first appearance.

    Lines before the first heading belong to none. Bodies of one section are joined by an empty line; a heading without
    body gives an empty body. No heading, blank or null text gives an empty array. Narrow.
    """

    def blocks(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, k: F.struct(k.alias("k"), section_of(x).alias("of")))

        def cut(heads: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                end = F.coalesce(F.get(heads, i + 1)["k"], F.size(lines))
                body = F.array_join(F.slice(lines, h["k"] + 2, end - h["k"] - 1), "\n")
                return F.struct(h["of"].alias("section"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))

            return F.transform(heads, one)

        return let(F.filter(marked, lambda m: m["of"].isNotNull()), cut)

    def merged(found: Column) -> Column:
        def one(s: Column) -> Column:
            bodies = F.transform(F.filter(found, lambda b: (b["section"] == s) & (b["body"] != "")), lambda b: b["body"])
            return F.struct(s.alias("section"), F.array_join(bodies, "\n\n").alias("body"))

        return F.transform(F.array_distinct(F.transform(found, lambda b: b["section"])), one)

    return F.coalesce(let(let(lines_of(text), blocks), merged), F.array().cast(SECTIONS_TYPE))


def with_sections(df: DataFrame, text: str = "clean_text", out: str = "sections") -> DataFrame:
    """Adds the sections of a cleaned text."""
    return df.withColumn(out, sections(F.col(text)))


def section_body(sections: str, name: str) -> Column:
    """The body of a section; null if the section is absent or blank."""
    return F.expr(f"nullif(get(filter({sections}, s -> s.section = '{name}'), 0).body, '')")
