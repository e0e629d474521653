"""Education and experience records out of the lines of a text.

All is one expression per document, inside the JVM and without a shuffle: lines become structs that say what a line is,
slices of the lines become entries, and the fields of an entry are its first fitting lines. Intermediate arrays are bound
by `let`, so each is computed once. Every step is linear in the lines, but for a sort of the entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvloom.functions import patterns as P
from cvloom.functions.text import blank_to_null, capitalised_words, first_match, has_word, let, letters, lines_of, strip, words_of
from cvloom.functions.vocab import NOT_TITLE_WORDS, TITLE_WORDS

EDUCATION = ["degree", "institution", "dates", "field_of_study", "grade", "location"]
EXPERIENCE = ["job_title", "company", "dates", "location", "description"]
EDUCATION_TYPE = "array<struct<" + ",".join(f"{c}:string" for c in EDUCATION) + ">>"
EXPERIENCE_TYPE = "array<struct<" + ",".join(f"{c}:string" for c in EXPERIENCE[:-1]) + ",description:array<string>>>"


def _lines(text: Column) -> Column:
    return F.transform(lines_of(text), strip)


def _first(items: Column, ok) -> Column:
    """The first item that fulfils the condition, null if there is none."""
    return F.get(F.filter(items, ok), F.lit(0))


def _cut(items: Column, starts: Column) -> Column:
    """`items` in pieces that begin at the positions `starts` (from 1, ascending) and go on to the next one."""
    return F.transform(starts, lambda s, k: F.slice(items, s, F.coalesce(F.get(starts, k + 1), F.size(items) + 1) - s))


def _positions(items: Column, ok) -> Column:
    """Positions (from 1) of the items that fulfil the condition; it gets the item and its position from 0."""
    found = F.filter(F.transform(items, lambda x, k: F.when(ok(x, k), k + 1)), lambda p: p.isNotNull())
    return F.coalesce(found, F.array().cast("array<int>"))


def _is_at(x: Column, other: Column) -> Column:
    """Is this the item `other` (which may be null)?"""
    return x["n"].eqNullSafe(other["n"])


def _numbered(items: Column, fields) -> Column:
    return F.transform(items, lambda x, k: F.struct(k.alias("n"), *fields(x)))


def _once(records: Column, keys: list[str]) -> Column:
    """Of records with equal keys (in lower case, stripped) the first, in the order given."""

    def keyed(x: Column, k: Column) -> Column:
        return F.struct(F.struct(*[F.lower(strip(F.coalesce(x[c], F.lit("")))).alias(c) for c in keys]).alias("key"), k.alias("n"))

    def firsts(s: Column) -> Column:
        kept = F.filter(s, lambda x, k: (k == 0) | (x["key"] != F.get(s, k - 1)["key"]))
        return F.array_sort(F.transform(kept, lambda x: x["n"]))

    return let(records, lambda r: F.transform(let(F.array_sort(F.transform(r, keyed)), firsts), lambda n: F.get(r, n)))


def _choose(lines: Column, short: int, grouped: Column, inline) -> Column:
    """Entries of several lines or of single ones: a short text gives the latter if it has any, and any text that has none
    of the former. Single lines are looked at only then."""

    def pick(g: Column) -> Column:
        alone = F.size(g) == 0
        return F.when(alone | (F.size(lines) <= short), let(inline, lambda i: F.when(alone | (F.size(i) > 0), i).otherwise(g))).otherwise(g)

    return let(grouped, pick)


# ---- education --------------------------------------------------------------------------------------


def _dates_edu(c: Column) -> Column:
    return F.coalesce(strip(first_match(c, P.EDU_DATES)), first_match(c, P.EDU_YEAR))


def _is_institution(c: Column) -> Column:
    return F.length(c).between(3, 120) & ~c.rlike(P.EDU_SKIP) & ~c.rlike(P.GRADE) & ~c.rlike(P.EDU_DATE_ONLY) & ~c.rlike(P.DEGREE) & (F.size(words_of(c)) <= 8) & (letters(c) / F.length(c) >= 0.45)


def _field(c: Column, token: Column) -> Column:
    """The field of study of a text with the degree `token`: what follows it, or else what follows the word `in`."""

    def tidy(x: Column) -> Column:
        return F.regexp_replace(strip(x), r"\)+$", "")

    after = F.substring(c, F.regexp_instr(c, F.lit(P.DEGREE)) + F.length(token), F.length(c))
    return let(tidy(first_match(after, P.FIELD_AFTER, 1)), lambda near: F.when(F.length(near) > 1, near).otherwise(tidy(first_match(c, P.FIELD_ANYWHERE, 1))))


def _edu_fields(c: Column) -> list[Column]:
    token = first_match(c, P.DEGREE)
    named = let(token, lambda t: F.when(t.isNotNull(), let(_field(c, t), lambda f: F.struct(F.concat(strip(t), F.coalesce(F.concat(F.lit(" in "), f), F.lit(""))).alias("degree"), f.alias("field")))))
    return [c.alias("line"), named.alias("d"), strip(first_match(c, P.GRADE)).alias("grade"), _dates_edu(c).alias("dates")]


def _edu_struct(degree: Column, institution: Column, dates: Column, field: Column, grade: Column) -> Column:
    return F.struct(degree.alias("degree"), institution.alias("institution"), dates.alias("dates"), field.alias("field_of_study"), grade.alias("grade"), F.lit(None).cast("string").alias("location"))


def _edu_entry(e: Column) -> Column:
    """The record of the lines of one entry."""

    def found(graded: Column) -> Column:
        def plain(x: Column) -> Column:
            return ~_is_at(x, graded) & ~(x["only_date"] & x["dates"].isNotNull())

        named = _first(e, lambda x: plain(x) & x["d"].isNotNull())["d"]
        places = F.transform(F.filter(e, lambda x: plain(x) & x["d"].isNull() & x["inst"]), lambda x: F.struct(x["conf"].alias("conf"), (-x["n"]).alias("n"), x["line"].alias("line")))
        dates = _first(e, lambda x: ~_is_at(x, graded) & x["dates"].isNotNull())["dates"]
        return let(named, lambda d: _edu_struct(d["degree"], F.array_max(places)["line"], dates, d["field"], graded["grade"]))

    return let(_first(e, lambda x: x["grade"].isNotNull()), found)


def _edu_grouped(lines: Column) -> Column:
    def fields(c: Column) -> list[Column]:
        conf = F.when(c.rlike(P.INSTITUTION), 3).otherwise(0) + F.when(capitalised_words(c), 1).otherwise(0)
        return [*_edu_fields(c), c.rlike(P.EDU_DATE_ONLY).alias("only_date"), _is_institution(c).alias("inst"), conf.alias("conf")]

    # an entry begins at each line with a degree but the first, which belongs to the lines before it
    def entries(x: Column) -> Column:
        starts = let(_positions(x, lambda y, k: y["d"].isNotNull()), lambda s: F.concat(F.array(F.lit(1)), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))))
        return F.transform(let(starts, lambda s: _cut(x, s)), _edu_entry)

    return F.filter(let(_numbered(lines, fields), entries), lambda r: F.length(r["degree"]) >= 3)


def _edu_inline(lines: Column) -> Column:
    """Records of single lines that hold a whole entry between separators."""

    def one(p: Column) -> Column:
        def record(d: Column) -> Column:
            def with_grade(g: Column) -> Column:
                def with_dates(t: Column) -> Column:
                    place = _first(p, lambda x: x["inst"] & ~_is_at(x, d) & ~_is_at(x, g) & ~_is_at(x, t))["line"]
                    return _edu_struct(d["d"]["degree"], place, t["dates"], d["d"]["field"], g["grade"])

                return let(_first(p, lambda x: x["dates"].isNotNull() & ~_is_at(x, d) & ~_is_at(x, g)), with_dates)

            return let(_first(p, lambda x: x["grade"].isNotNull() & ~_is_at(x, d)), with_grade)

        return let(_first(p, lambda x: x["d"].isNotNull()), record)

    parts = F.transform(F.filter(lines, lambda c: c.rlike(P.DEGREE)), lambda c: F.filter(F.transform(F.split(c, P.EDU_SEPARATOR), strip), lambda x: x != ""))
    several = F.filter(parts, lambda p: F.size(p) >= 2)
    records = F.transform(several, lambda p: let(_numbered(p, lambda c: [*_edu_fields(c), _is_institution(c).alias("inst")]), one))
    return F.filter(records, lambda r: F.length(r["degree"]) >= 3)


def education(text: Column) -> Column:
    """The education records of a text, as EDUCATION_TYPE.

    Texts of at most three lines that hold whole entries in single lines give only those; otherwise a new entry begins at
    each line with a degree once the entry before has one; if no entry has a degree, single lines are tried. Of records
    with equal degree and institution the first counts. `location` is never known. Null and blank texts give no records.
    """

    def records(lines: Column) -> Column:
        return _once(_choose(lines, 3, _edu_grouped(lines), _edu_inline(lines)), ["degree", "institution"])

    found = let(F.filter(_lines(blank_to_null(text)), lambda x: x != ""), lambda lines: F.when(lines.isNotNull(), records(lines)))
    return F.coalesce(found, F.array()).cast(EDUCATION_TYPE)


# ---- experience -------------------------------------------------------------------------------------


def _not_record(c: Column) -> Column:
    return c.rlike(P.EXP_DATE_ONLY) | c.rlike(P.BULLET) | c.rlike(P.DEGREE_GUARD)


def _few_marks(c: Column) -> Column:
    return (F.length(F.regexp_replace(c, "[^,]", "")) <= 2) & (F.length(F.regexp_replace(c, "[^|]", "")) <= 2) & (F.size(words_of(c)) <= 7)


def is_job_title(c: Column) -> Column:
    spaced = F.length(F.regexp_replace(c, r"[^\p{L} ]", ""))
    return F.length(c).between(3, 80) & ~_not_record(c) & _few_marks(c) & has_word(c, TITLE_WORDS) & ~has_word(c, NOT_TITLE_WORDS) & (spaced / F.length(c) >= 0.55)


def is_company(c: Column) -> Column:
    return F.length(c).between(2, 80) & ~_not_record(c) & _few_marks(c) & (letters(c) / F.length(c) >= 0.45) & (c.rlike(P.COMPANY) | capitalised_words(c))


def is_location(c: Column) -> Column:
    return F.length(c).between(1, 60) & ~_not_record(c) & c.rlike(P.LOCATION)


def _dates_exp(c: Column) -> Column:
    return strip(first_match(c, P.EXP_DATES))


def _exp_struct(title: Column, company: Column, dates: Column, location: Column, description: Column) -> Column:
    return F.struct(title.alias("job_title"), company.alias("company"), dates.alias("dates"), location.alias("location"), description.alias("description"))


def _valid(records: Column) -> Column:
    return F.filter(records, lambda r: r["job_title"].isNotNull() | r["company"].isNotNull() & r["dates"].isNotNull())


def _exp_entry(e: Column) -> Column:
    """The record of the lines of one entry."""

    def remainder(x: Column) -> Column:
        """What is left of a line without its dates, and what that is."""
        plain = ~x["bullet"] & ~x["only_date"]
        cut = F.regexp_replace(F.regexp_replace(x["line"], P.EXP_DATES, ""), r"^[ |—–\-,]+|[ |—–\-,]+$", "")
        rest = F.when(plain & x["dates"].isNotNull(), F.nullif(cut, F.lit(""))).when(plain & ~x["title"], x["line"])
        return let(rest, lambda r: F.when(r.isNotNull(), F.struct(x["n"].alias("n"), r.alias("text"), is_job_title(r).alias("title"), is_company(r).alias("comp"), is_location(r).alias("loc"))))

    def found(rests: Column) -> Column:
        def placed(place: Column) -> Column:
            titled = _first(e, lambda x: x["title"] & ~x["bullet"] & ~x["only_date"] & x["dates"].isNull())["line"]
            title = F.coalesce(titled, _first(rests, lambda r: r["title"] & ~_is_at(r, place))["text"])
            company = _first(rests, lambda r: r["comp"] & ~r["title"] & ~_is_at(r, place))["text"]
            dated = _first(e, lambda x: ~x["bullet"] & (x["only_date"] | x["dates"].isNotNull()))
            bullets = F.filter(F.transform(F.filter(e, lambda x: x["bullet"]), lambda x: F.regexp_replace(x["line"], P.BULLET, "")), lambda t: t != "")

            def filled(b: Column) -> Column:
                # with neither, the first remainder counts, even if it was taken for the place
                first = F.when(b["t"].isNull() & b["c"].isNull(), F.get(rests, F.lit(0)))
                return let(
                    first,
                    lambda f: _exp_struct(
                        F.when(f["title"], f["text"]).otherwise(b["t"]), F.when(f["comp"] & ~f["title"], f["text"]).otherwise(b["c"]), let(dated, lambda x: F.coalesce(x["dates"], F.when(x["only_date"], x["line"]))), place["text"], bullets
                    ),
                )

            return let(F.struct(title.alias("t"), company.alias("c")), filled)

        return let(_first(rests, lambda r: r["loc"]), placed)

    return let(F.filter(F.transform(e, remainder), lambda r: r.isNotNull()), found)


def _exp_grouped(lines: Column) -> Column:
    def fields(c: Column) -> list[Column]:
        return [c.alias("line"), c.rlike(P.BULLET).alias("bullet"), c.rlike(P.EXP_DATE_ONLY).alias("only_date"), is_job_title(c).alias("title"), _dates_exp(c).alias("dates")]

    def blocks(x: Column) -> Column:
        """Runs of lines between empty ones."""
        starts = _positions(x, lambda y, k: (y["line"] != "") & ((k == 0) | (F.get(x, k - 1)["line"] == "")))
        return F.transform(let(starts, lambda s: _cut(x, s)), lambda b: F.filter(b, lambda y: y["line"] != ""))

    def entries(b: Column) -> Column:
        """A block in entries: a new one begins at a title that follows a date, other lines between them apart."""
        label = _numbered(b, lambda y: [F.when(y["bullet"], None).when(y["only_date"], "date").when(y["title"], "title").alias("is")])

        def starts(lab: Column) -> Column:
            after = F.filter(lab, lambda y, k: (k > 0) & (y["is"] == "title") & (F.get(lab, k - 1)["is"] == "date"))
            return F.array_distinct(F.concat(F.array(F.lit(1)), F.transform(after, lambda y: y["n"] + 1)))

        return let(let(F.filter(label, lambda y: y["is"].isNotNull()), starts), lambda s: _cut(b, s))

    groups = F.flatten(F.transform(let(_numbered(lines, fields), blocks), entries))
    return _valid(F.transform(groups, _exp_entry))


def _exp_inline(lines: Column) -> Column:
    def one(p: Column) -> Column:
        def with_dates(t: Column) -> Column:
            def with_title(j: Column) -> Column:
                def with_place(q: Column) -> Column:
                    company = _first(p, lambda x: x["comp"] & ~_is_at(x, t) & ~_is_at(x, j) & ~_is_at(x, q))["line"]
                    return _exp_struct(j["line"], company, t["dates"], q["line"], F.array().cast("array<string>"))

                return let(_first(p, lambda x: x["loc"] & ~_is_at(x, t) & ~_is_at(x, j)), with_place)

            return let(_first(p, lambda x: x["title"] & ~_is_at(x, t)), with_title)

        return let(_first(p, lambda x: x["dates"].isNotNull()), with_dates)

    parts = F.transform(F.filter(lines, lambda c: c.rlike("[|—–]")), lambda c: F.filter(F.transform(F.split(c, P.EXP_SEPARATOR), strip), lambda x: x != ""))
    several = F.filter(parts, lambda p: F.size(p) >= 2)
    fields = lambda c: [c.alias("line"), _dates_exp(c).alias("dates"), is_job_title(c).alias("title"), is_location(c).alias("loc"), is_company(c).alias("comp")]
    return _valid(F.transform(several, lambda p: let(_numbered(p, fields), one)))


def experience(text: Column) -> Column:
    """The experience records of a text, as EXPERIENCE_TYPE.

    Texts of at most two lines that hold whole entries in single lines give only those; otherwise entries are separated by
    empty lines and by a title after a date; if no entry is valid (a title, or company and dates), single lines are tried.
    Bullet lines are the description. Of records with equal title, company and dates the first counts. Null and blank
    texts give no records.
    """

    def records(lines: Column) -> Column:
        filled = F.filter(lines, lambda x: x != "")
        return _once(let(filled, lambda own: _choose(own, 2, _exp_grouped(lines), _exp_inline(own))), ["job_title", "company", "dates"])

    found = let(_lines(blank_to_null(text)), lambda lines: F.when(lines.isNotNull(), records(lines)))
    return F.coalesce(found, F.array()).cast(EXPERIENCE_TYPE)


# ---- tables -----------------------------------------------------------------------------------------


def _table(df: DataFrame, key: str, records: Column) -> DataFrame:
    """One row per record, numbered from 1. The filter stands behind the generator, or it would be pushed down with the
    whole definition of the records in it, and so would the one that a plain explosion implies."""
    d = df.select(F.col(key), F.posexplode_outer(records).alias("p", "r")).where("p is not null")
    return d.select(key, (F.col("p") + 1).alias("entry_no"), "r.*")


def education_records(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, entry_no, degree, institution, dates, field_of_study, grade, location) of the text in `source`. Narrow."""
    return _table(df, key, education(F.col(source)))


def experience_records(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, entry_no, job_title, company, dates, location, description) of the text in `source`. Narrow."""
    return _table(df, key, experience(F.col(source)))
