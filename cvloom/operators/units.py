"""Values on different scales (problem 4): general choice of units by an identity, and grades as percentages."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvloom.functions.text import once
from cvloom.tables import are_small

#: A factor, or a factor and a zero.
Unit = float | Column | tuple[float | Column, float | Column]


def resolve_units(
    df: DataFrame,
    units: Mapping[str, Mapping[str, Unit]],
    identity: Mapping[str, int],
    allowed: Mapping[str, Mapping[str, Column]] | None = None,
    tolerance: float = 1e-6,
    out: str = "solution",
) -> DataFrame:
    """Choose the unit of each value so that a physical identity among columns holds as well as it can.

    `units` names for each column the units it may be in, the preferred one first: the factor to the common unit, or the
    pair (factor, zero) where the unit counts from another zero, as degrees do: converted = (value - zero) * factor. Both
    may be columns, where they differ from row to row. `identity` gives exponents: the product of the converted values
    raised to them is 1 where all is right, for example {"mass": 1, "density": -1, "volume": -1}. `allowed` can forbid a
    unit in a row. Of all combinations the one with the least absolute log residual is chosen, and of equal ones the one
    listed first. Adds the struct `out`: `unit_<column>` and `value_<column>` (converted), `residual`, and `unique`, which is
    false if another combination with other converted values fits as well within `tolerance`. Narrow, and inside the JVM.
    Combinations in which a converted value is null or not positive do not count; without any left the struct is null.
    Other columns are kept; the name `out` must be free.
    """
    allowed = allowed or {}
    cols = list(units)
    d = df
    for n, c in enumerate(cols):
        found = []
        for k, (name, unit) in enumerate(units[c].items()):
            factor, zero = unit if isinstance(unit, tuple) else (unit, None)
            v = F.col(c).cast("double")
            v = (v if zero is None else v - zero) * (factor if isinstance(factor, Column) else F.lit(float(factor)))
            one = F.struct(F.lit(k).alias("k"), F.lit(name).alias("unit"), v.alias("value"))
            found.append(F.when(allowed[c][name], one) if name in allowed.get(c, {}) else one)
        # what is null or not positive is dropped here, so that combinations are formed of possible readings only
        d = d.withColumn(f"_units{n}", F.filter(F.array(*found), lambda x: x["value"] > 0))

    def combined(n: int, taken: list[Column]) -> Column:
        if n == len(cols):
            total = sum((identity[c] * F.ln(x["value"]) for c, x in zip(cols, taken)), F.lit(0.0))
            return F.array(F.struct((F.round(F.abs(total) / tolerance) * tolerance).alias("residual"), *[x.alias(f"x{k}") for k, x in enumerate(taken)]))
        return F.flatten(F.transform(F.col(f"_units{n}"), lambda x: combined(n + 1, [*taken, x])))

    d = d.withColumn("_options", once(F.array_sort(combined(0, [])), *[f"_units{n}" for n in range(len(cols))]))
    best = F.get("_options", F.lit(0))
    different = " or ".join(f"abs(ln(x.x{n}.value / _options[0].x{n}.value)) > {tolerance}" for n in range(len(cols)))
    rivals = F.expr(f"exists(_options, x -> x.residual = _options[0].residual and ({different}))")
    parts = [x for n, c in enumerate(cols) for x in (best[f"x{n}"]["unit"].alias(f"unit_{c}"), best[f"x{n}"]["value"].alias(f"value_{c}"))]
    solved = F.when(F.size("_options") > 0, F.struct(*parts, best["residual"].alias("residual"), (~rivals).alias("unique")))
    return d.withColumn(out, once(solved, "_options")).drop("_options", *[f"_units{n}" for n in range(len(cols))])


# ---- grades -----------------------------------------------------------------------------------------

_NUM = r"\d+(?:[.,]\d+)*"
_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
_WORD = "(?:" + "|".join(_WORDS) + r")(?:[\s-]+(?:" + "|".join(list(_WORDS)[:9]) + r"))?\b"
_LABEL = r"(?:\s*(?:cgpa|gpa|sgpa|grade|score|points?|pts|marks?)\b\.?)?"


def _group(c: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def _words_value(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in _WORDS.items() for x in kv])
    parts = F.filter(F.split(c, r"[\s-]+"), lambda x: x != "")
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.coalesce(table[x], F.lit(0)))


def _plain(c: Column) -> Column:
    """A number whose commas and dots, but for the last, are dropped; the last one is the decimal sign."""
    whole = F.regexp_replace(c, r"[.,](?=.*[.,])", "")
    return F.replace(whole, F.lit(","), F.lit("."))


def parse_grades(df: DataFrame, grade: str = "grade") -> DataFrame:
    """Adds `_value` and `_top` (numbers as written), and the scale that the text itself gives, to the rows of `df`.

    `_kind` is `percent`, `of` (x of y, worst 0), `code` (a scale code in `_code`), `ends` (best and worst in `_top` and
    `_worst`), or null where the text gives no scale. Only what belongs to the first value of the text counts.
    """
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(grade), F.lit("")), r"[\s\x{00A0}\x{2009}\x{202F}]+", " ")))
    d = df.withColumn("_t", text)
    digits = _group(F.col("_t"), rf"^[^0-9]*?({_NUM})")
    in_words = F.col("_t").rlike(rf"^(?:[a-z]+\s*[:\-]?\s+)?{_WORD}[\s-]*(?:%|per\s?cent|pct|out\s+of|of|/|on\s+a)")
    d = d.withColumns({"_digits": digits, "_said": F.when(digits.isNull() & in_words, _group(F.col("_t"), rf"\b({_WORD})"))})
    first = F.coalesce("_digits", "_said")
    d = d.withColumn("_before", F.substring(F.col("_t"), F.lit(1), F.call_function("locate", first, F.col("_t")) - 1)).withColumn("_after", F.substring(F.col("_t"), F.length("_before") + F.length(first) + 1, F.length("_t")))
    after = F.col("_after")
    d = d.withColumns(
        {
            "_best": _group(after, rf"^{_LABEL}\s*[(\[,;]?\s*({_NUM})\s*(?:=|is)?\s*best"),
            "_low": _group(after, rf"^{_LABEL}\s*[(\[,;]?\s*{_NUM}\s*(?:=|is)?\s*best\s*[,;/]?\s*({_NUM})\s*(?:=|is)?\s*worst"),
            "_code": F.upper(_group(after, r"^(?:\s*(?:cgpa|gpa|grade|score|points?)\b)?\s*[(\[,;]?\s*(?:on\s+)?(?:the\s+)?(?:scale\s+)?([a-z]\d+)\b")),
            "_of": F.coalesce(
                _group(after, rf"^{_LABEL}\s*(?:/|\bout\s+of\b|\bof\b)\s*({_NUM}|{_WORD})"),
                _group(after, rf"^{_LABEL}\s*[(\[,;]?\s*(?:on\s+)?(?:an?\s+)?({_NUM})\s*-?\s*(?:point\s+)?scale"),
                _group(after, rf"^{_LABEL}\s*[(\[,;]?\s*on\s+(?:a|the)\s+scale\s+of\s+({_NUM}|{_WORD})"),
            ),
            "_percent": after.rlike(r"^\s*(?:%|per\s?cent\b|pct\b)") | F.col("_before").rlike(r"\b(?:percentage|per\s?cent|percent)\b"),
        }
    )
    kind = (
        F.when(F.col("_best").isNotNull() & F.col("_low").isNotNull(), "ends")
        .when(F.col("_of").isNotNull(), "of")
        .when(F.col("_code").isNotNull(), "code")
        .when(F.col("_percent"), "percent")
    )
    top = F.when(F.col("_of").isNotNull(), F.coalesce(_plain(F.when(F.col("_of").rlike("^[0-9]"), F.col("_of"))), _words_value(F.col("_of")).cast("string")))
    return d.withColumns(
        {
            "_kind": kind,
            "_value_text": F.col("_digits"),
            "_top_text": F.when(F.col("_of").isNotNull(), F.col("_of")),
            "_value": F.coalesce(_plain(F.col("_digits")), F.when(F.col("_said").isNotNull(), _words_value(F.col("_said")).cast("string"))),
            "_top": F.when(kind == "ends", _plain(F.col("_best"))).otherwise(top),
            "_worst": F.when(kind == "ends", _plain(F.col("_low"))),
        }
    ).drop("_t", "_digits", "_said", "_before", "_after", "_best", "_low", "_of", "_percent")


_D = "decimal(18,6)"
_GROUPED = r"^\d{1,3}(?:,\d{3})+$"


def _on_scales(education: DataFrame, agencies: DataFrame, scales: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The parsed grades with the ends of the scale that the text gives (`_b`, `_w`) and of the agency's (`_ab`, `_aw`)."""
    known = scales.select(F.col("scale_code").alias("_code"), F.col("best").cast(_D).alias("_sb"), F.col("worst").cast(_D).alias("_sw")).dropDuplicates(["_code"])
    own = agencies.select("agency_id", F.col("default_scale").alias("_code")).dropDuplicates(["agency_id"]).join(side(known), "_code").select("agency_id", F.col("_sb").alias("_ab"), F.col("_sw").alias("_aw"))
    d = parse_grades(education.select("edu_id", "grade", "agency_id")).join(side(own), "agency_id", "left").join(side(known), "_code", "left")
    return d.select(
        "edu_id",
        "agency_id",
        "_kind",
        F.expr(f"try_cast(_value as {_D})").alias("_v"),
        F.when(F.col("_kind") == "percent", F.lit(100).cast(_D)).when(F.col("_kind").isin("of", "ends"), F.expr(f"try_cast(_top as {_D})")).when(F.col("_kind") == "code", F.col("_sb")).alias("_b"),
        F.when(F.col("_kind").isin("of", "percent"), F.lit(0).cast(_D)).when(F.col("_kind") == "ends", F.expr(f"try_cast(_worst as {_D})")).when(F.col("_kind") == "code", F.col("_sw")).alias("_w"),
        "_ab",
        "_aw",
        F.coalesce(F.col("_value_text").rlike(_GROUPED), F.lit(False)).alias("_gv"),
        F.coalesce(F.col("_top_text").rlike(_GROUPED), F.lit(False)).alias("_gb"),
    )


def agency_shares(graded: DataFrame) -> DataFrame:
    """(agency_id, typical): the mean share of the grades of each agency, and of those without one, over the grades that
    can be read in one way only. One row per agency; summed up before the shuffle, so an agency with a third of all rows
    is no hot group."""
    b, w = F.coalesce("_b", "_ab"), F.coalesce("_w", "_aw")
    share = ((F.col("_v") - w) / (b - w)).cast("double")
    # conditions inside of the aggregate: a filter would be pushed down with the whole definition of its columns
    one = graded.select("agency_id", share.alias("share"), (F.col("_gv") | F.col("_gb")).alias("open"))
    return one.groupBy("agency_id").agg(F.avg(F.when(~F.col("open") & F.col("share").between(0, 1), F.col("share"))).alias("typical"))


def grade_shares(education: DataFrame, agencies: DataFrame, scales: DataFrame) -> DataFrame:
    """One row per row of `education`: (edu_id, value, best, worst, scale_source, grade_bp, unique).

    `grade_bp` is 10000 * (value - worst) / (best - worst). The scales are the units: on each, a value converts to its share
    of the way from worst (the zero) to best, and `resolve_units` takes the scale and the reading of the numbers (the comma of
    1,030 may group thousands or be decimal, in the value and in the top) for which the share agrees best with the typical
    share of the same agency's other grades. A scale in the text goes before the agency's default, so the latter is allowed
    only where the text gives none; "x of y" and percentages have worst 0. `unique` is false if two readings fit equally well
    but differ; such a grade is not usable. Not usable, with null `grade_bp`, are also null, blank or wordy grades, a value
    outside its scale, no scale in the text and no agency (or one without default). Where no other grade of the agency can be
    read, the typical share is 1. Registers of up to 100,000 rows (counted) are broadcast, larger ones joined by shuffle.
    Repeated rows count like others.
    """
    # what is joined has at most one row per row of a register, so the registers' sizes decide
    side = F.broadcast if are_small(agencies, scales) else lambda x: x
    d = _on_scales(education, agencies, scales, side)
    typical = agencies.select("agency_id").distinct().join(agency_shares(d), "agency_id")
    d = d.join(side(typical), "agency_id", "left").withColumns({"_grade": F.col("_v"), "_typical": F.coalesce("typical", F.lit(1.0))})
    scale = {"text": ("_b", "_w", 1), "text, top grouped": ("_b", "_w", 1000), "agency": ("_ab", "_aw", 1)}
    hypotheses, allowed = {}, {}
    for reading, times in (("grouped", 1000), ("decimal", 1)):
        for name, (b, w, more) in scale.items():
            best, worst = F.col(b).cast("double") * more, F.col(w).cast("double")
            key = f"{name}, {reading}"
            hypotheses[key] = (times / F.nullif(best - worst, F.lit(0.0)), worst / times)
            of_text = F.col("_kind").isNull() if name == "agency" else F.col("_kind").isNotNull() & (F.col("_gb") if more > 1 else F.lit(True))
            allowed[key] = of_text & (F.col("_gv") if times > 1 else F.lit(True))
    d = resolve_units(d, {"_grade": hypotheses, "_typical": {"": 1.0}}, {"_grade": 1, "_typical": -1}, {"_grade": allowed})
    unit = F.coalesce(F.col("solution.unit__grade"), F.lit(""))
    times, more = F.when(unit.endswith("grouped"), 1000).otherwise(1), F.when(unit.contains("top grouped"), 1000).otherwise(1)
    by_text = F.col("_kind").isNotNull()
    d = d.select(
        "edu_id",
        (F.col("_v") * times).cast(_D).alias("value"),
        F.when(by_text, F.col("_b") * more).otherwise(F.col("_ab")).cast(_D).alias("best"),
        F.when(by_text, F.col("_w")).otherwise(F.col("_aw")).alias("worst"),
        F.when(by_text, F.lit("text")).when(F.col("_ab").isNotNull(), F.lit("agency")).alias("scale_source"),
        F.col("solution.unique").alias("unique"),
    )
    inside = (F.col("value") >= F.least("best", "worst")) & (F.col("value") <= F.greatest("best", "worst")) & (F.col("best") != F.col("worst")) & F.coalesce("unique", F.lit(True))
    share = F.expr("cast(10000 * cast(value - worst as decimal(18,6)) as decimal(28,6)) / cast(best - worst as decimal(18,6))")
    return d.select("edu_id", "value", "best", "worst", "scale_source", F.when(inside, F.round(share, 0).cast("int")).alias("grade_bp"), "unique")


def usable_grades(education: DataFrame, agencies: DataFrame, scales: DataFrame) -> DataFrame:
    """(edu_id, grade_bp) of the usable grades. The filter stands behind a generator, since otherwise it would be pushed down
    with the whole definition of the grade in it."""
    one = grade_shares(education, agencies, scales).select("edu_id", F.explode_outer(F.array("grade_bp")).alias("grade_bp"))
    return one.where("grade_bp is not null")
