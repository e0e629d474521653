"""LinkedIn and GitHub profile links of a text and of the links embedded in its file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cvloom.functions import patterns as P
from cvloom.functions.text import lines_of, strip
from cvloom.functions.vocab import GITHUB_RESERVED, LINKEDIN_RESERVED


def https(url: Column) -> Column:
    """Without sentence punctuation at the end, and with https:// in front."""
    u = F.regexp_replace(strip(url), P.URL_TAIL, "")
    return F.when(u.startswith("http://"), F.concat(F.lit("https://"), F.substring(u, F.lit(8), F.length(u)))).when(u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def _first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def _no_links(extra: Column) -> Column:
    return F.coalesce(extra, F.array().cast("array<string>"))


def linkedin(text: Column, extra: Column) -> Column:
    """An embedded link first, then a labelled link, then the first link of the text; as https address."""

    def good(slug: Column) -> Column:
        return (F.length(slug) >= 2) & ~F.lower(slug).isin(*LINKEDIN_RESERVED)

    embedded = _first(F.filter(_no_links(extra), lambda u: good(F.regexp_extract(u, "^" + P.LINKEDIN_URL, 1))))
    labelled = F.when(F.length(F.regexp_extract(text, P.LINKEDIN_LABELLED, 2)) >= 2, F.regexp_extract(text, P.LINKEDIN_LABELLED, 1))
    plain = _first(F.filter(F.regexp_extract_all(text, F.lit(P.LINKEDIN_URL), F.lit(0)), lambda u: good(F.regexp_extract(u, P.LINKEDIN_URL, 1))))
    return https(F.coalesce(embedded, labelled, plain))


def github(text: Column, extra: Column) -> Column:
    """An embedded link first, then the first link that is no repository, then a labelled line, even of a repository."""

    def good(user: Column) -> Column:
        return (F.length(user) >= 2) & ~F.lower(user).isin(*GITHUB_RESERVED)

    at_start = "^" + P.GITHUB_URL
    embedded = F.filter(
        _no_links(extra), lambda u: good(F.regexp_extract(u, at_start, 1)) & ~F.regexp_replace(F.regexp_replace(u, at_start, ""), "^/+", "").contains("/")
    )
    user0 = F.regexp_extract(_first(embedded), at_start, 1)
    # a link that goes on with a repository is matched together with the first letter of it, and so known
    pattern = F.lit(P.GITHUB_URL + r"(/[ \t]*[a-zA-Z0-9_\-])?")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("user"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("rest"))
    user1 = _first(F.filter(pairs, lambda p: (p["rest"] == "") & good(p["user"])))["user"]
    user2 = _first(F.filter(F.transform(lines_of(text), lambda x: F.regexp_extract(x, P.GITHUB_LABELLED, 1)), good))
    return F.concat(F.lit("https://github.com/"), F.coalesce(F.nullif(user0, F.lit("")), user1, user2))


def profiles(text: Column, extra: Column) -> Column:
    return F.struct(linkedin(text, extra).alias("linkedin"), github(text, extra).alias("github"))
