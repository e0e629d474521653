"""Continuous periods and gaps of overlapping intervals (problem 3)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units per time shard, unless told otherwise.
SHARD = 60


def merge_intervals(df: DataFrame, key: str, start: str, end: str, shard: int = SHARD) -> DataFrame:
    """Maximal continuous periods per key: (key, from_unit, to_unit), integers, both ends inclusive.

    Two levels, so that a key with a third of all rows is never in one task: each interval is clipped into shards of
    `shard` units, and the clips of a (key, shard) merge locally, which Spark begins before the shuffle; then the few runs of
    each shard are stitched where they touch a shard boundary. An interval gives one row per shard that it reaches into, so
    a shard should be about as long as most intervals. Up to 62 units the coverage of a shard is a bit mask, and what
    reaches one task per key is bounded by the length of the time axis; in longer ones clips of one start merge before the
    shuffle, and what reaches one task per (key, shard) is bounded by the units of a shard. Intervals that touch
    (end + 1 = start) are one period. Null keys, null ends and intervals that end before they start are left out; repeated
    rows change nothing.
    """
    ok = df.select(F.col(key).alias("key"), F.col(start).cast("bigint").alias("a"), F.col(end).cast("bigint").alias("b")).where("key is not null and a <= b")
    clipped = ok.select("key", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / shard), F.floor(F.col("b") / shard))).alias("shard"))
    runs = (_masked if shard <= 62 else _sorted)(clipped, shard)
    by_key = Window.partitionBy("key").orderBy("a")
    new = F.when(F.col("a") <= F.lag("b").over(by_key) + 1, 0).otherwise(1)
    stitched = runs.withColumn("new", new).withColumn("period", F.sum("new").over(by_key))
    return stitched.groupBy("key", "period").agg(F.min("a").alias("from_unit"), F.max("b").alias("to_unit")).select(F.col("key").alias(key), "from_unit", "to_unit")


def _masked(clipped: DataFrame, shard: int) -> DataFrame:
    """Runs (key, a, b) within shards, by OR-ing bit masks."""
    one = F.lit(1).cast("bigint")
    lo = F.greatest(F.col("a") - F.col("shard") * shard, F.lit(0)).cast("int")
    hi = F.least(F.col("b") - F.col("shard") * shard, F.lit(shard - 1)).cast("int")
    span = F.call_function("shiftleft", one, hi - lo + 1) - 1
    local = clipped.groupBy("key", "shard").agg(F.bit_or(F.call_function("shiftleft", span, lo)).alias("mask"))
    # a run begins at a set bit whose lower neighbour is not set, and ends at one whose upper neighbour is not
    marked = local.select("key", "shard", F.expr("mask & ~shiftleft(mask, 1)").alias("s"), F.expr("mask & ~shiftrightunsigned(mask, 1)").alias("e"))
    starts, ends = (F.expr(f"filter(sequence(0, {shard - 1}), i -> getbit({c}, i) = 1)") for c in ("s", "e"))
    return marked.select("key", "shard", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("r")).select("key", (F.col("shard") * shard + F.col("r.s")).alias("a"), (F.col("shard") * shard + F.col("r.e")).alias("b"))


def _sorted(clipped: DataFrame, shard: int) -> DataFrame:
    """Runs (key, a, b) within shards, by start."""
    first = F.col("shard") * shard
    clips = clipped.groupBy("key", "shard", F.greatest("a", first).alias("a")).agg(F.max(F.least(F.col("b"), first + (shard - 1))).alias("b"))
    w = Window.partitionBy("key", "shard").orderBy("a")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = clips.withColumn("new", F.when(F.col("a") <= before + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return marked.groupBy("key", "shard", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("key", "a", "b")


def with_gaps(periods: DataFrame, key: str) -> DataFrame:
    """The periods, and between each two successive ones the gap: (key, kind, from_unit, to_unit)."""
    nxt = F.lead("from_unit").over(Window.partitionBy(key).orderBy("from_unit"))
    both = periods.withColumn("next", nxt).select(
        key,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("period").alias("kind"), "from_unit", "to_unit"),
                    F.when(F.col("next").isNotNull(), F.struct(F.lit("gap").alias("kind"), (F.col("to_unit") + 1).alias("from_unit"), (F.col("next") - 1).alias("to_unit"))),
                )
            )
        ).alias("x"),
    )
    return both.select(key, "x.*")


# ---- free-typed date cells -> month ranges ----------------------------------------------------------

_MON = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
_YEAR = r"(?:\d{4}(?!\d)|['’]\s?\d{2}(?!\d))"
_POINT = (
    r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d)"  # 2001-05-31
    r"|\d{4}[-/.](?:0?[1-9]|1[0-2])(?!\d)"  # 2001-05
    r"|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?!\d)"  # 31.05.2001
    r"|(?:0?[1-9]|1[0-2])[-/.]\d{4}(?!\d)"  # 05/2001
    rf"|(?:\d{{1,2}}(?:st|nd|rd|th)?\.?\s+)?{_MON}(?:\s+\d{{1,2}}(?:st|nd|rd|th)?,)?,?[\s-]*{_YEAR}"  # 31 May 2001, May-2001, May '01
    rf"|{_YEAR})"
)
_OPEN = r"(?:till\s+date|to\s+date|until\s+now|till\s+now|present|current(?:ly)?|ongoing|now|today|date)\b"
_JOIN = r"(?:\s*(?:[-–—−/]|\bto\b|\btill\b|\buntil\b)\s*)+"
_SPENT = r"\(?\s*\b\d+\s*(?:years?|yrs?|months?|mos?)\b\.?(?:\s*\d+\s*(?:months?|mos?)\b\.?)?\s*\)?"

#: Values that stand for "no company": written without anything but letters and digits.
PLACEHOLDERS = ("na", "none", "nil", "null", "unknown", "tbd", "tba", "notapplicable", "notavailable", "notspecified", "notprovided", "nocompany", "xxx")


def names_something(c: Column) -> Column:
    """Not null, blank or a mere placeholder."""
    kept = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.coalesce((kept != "") & ~kept.isin(*PLACEHOLDERS), F.lit(False))


def _month_of(point: str) -> int | None:
    """Month number in a date point, None if it has none."""
    named = re.search(_MON, point)
    if named:
        return "janfebmaraprmayjunjulaugsepoctnovdec".index(named[0][:3]) // 3 + 1
    for shape in (r"\d{1,2}[-/.](\d{1,2})[-/.]\d{4}", r"\d{4}[-/.](\d{1,2})", r"(\d{1,2})[-/.]\d{4}"):
        if m := re.match(shape, point):
            return int(m[1])
    return None


def _full_year(two: str) -> int:
    """Two-digit years lie in 1926 to 2025."""
    return int(two) + (2000 if int(two) <= 25 else 1900)


def _year_of(point: str) -> int | None:
    if m := re.search(r"(?<!\d)\d{4}(?!\d)", point):
        return int(m[0])
    if m := re.search(r"['’]\s?(\d{2})(?!\d)", point):
        return _full_year(m[1])
    return None


_RANGES = re.compile(
    rf"(?P<prefix>\b(?:since|from|until|till|up\s+to|to|before|by)\s+)?(?<!\d)(?P<first>{_POINT}|{_MON}(?={_JOIN}{_POINT}))"
    rf"(?:{_JOIN}(?:(?P<last>{_POINT})|(?P<open>{_OPEN})|(?P<short>\d{{2}})(?!\d)|(?P<nothing>(?=\s*(?:$|[;,)])))))?",
    re.ASCII,
)
_SPENT_TIME = re.compile(_SPENT, re.ASCII)


def parse_ranges(cell: str | None, now: int = 2025 * 12 + 11) -> list[dict[str, int]]:
    """The month ranges of one free-typed cell, months counted from year 0, both ends inclusive.

    Every range of a cell counts, whatever separates them. Days are ignored. A year alone spans January to December; a
    single point covers itself; an open end, or a dash with nothing after it, is `now`. A cell or part that only says
    until when gives nothing, neither does a range that ends before it starts or has an impossible month. None and blank
    cells give an empty list.
    """
    out: list[dict[str, int]] = []
    if not cell:
        return out
    text = _SPENT_TIME.sub(" ", " ".join(cell.lower().split()))
    for m in _RANGES.finditer(text):
        prefix, first, last = (m["prefix"] or "").strip(), m["first"], m["last"]
        if prefix not in ("", "since", "from"):
            continue
        end_year = _year_of(last) if last else _full_year(m["short"]) if m["short"] else None
        year, month, end_month = _year_of(first) or end_year, _month_of(first), _month_of(last) if last else None
        if year is None or not 1 <= (month or 1) <= 12 or not 1 <= (end_month or 1) <= 12:
            continue
        a = year * 12 + (month or 1) - 1
        if prefix == "since" or m["open"] or m["nothing"] is not None:
            b = now
        elif end_year is not None:
            b = end_year * 12 + (end_month or 12) - 1
        else:
            b = year * 12 + (month or 12) - 1
        if a <= b:
            out.append({"a": a, "b": b})
    return out


def _parse_batch(cells: pd.Series) -> pd.Series:
    known = {c: parse_ranges(c) for c in cells.dropna().unique()}
    return cells.map(lambda c: known.get(c, []))


def date_ranges(col: str | Column) -> Column:
    """`parse_ranges` of a column. The patterns as one Catalyst expression exceed what Spark compiles, so this runs in
    Arrow batches; each distinct cell of a batch is parsed once."""
    return F.pandas_udf(_parse_batch, "array<struct<a:bigint,b:bigint>>")(col)


def yyyymm(unit: Column) -> Column:
    """A month counted from year 0 as yyyymm."""
    return (F.floor(unit / 12) * 100 + unit % 12 + 1).cast("int")


def employment_intervals(experience: DataFrame) -> DataFrame:
    """One row (resume_id, a, b) per range of the rows that have a résumé and name a company."""
    rows = experience.where(F.col("resume_id").isNotNull() & names_something(F.col("company"))).select("resume_id", "dates")
    return rows.select("resume_id", F.explode(date_ranges("dates")).alias("r")).select("resume_id", "r.a", "r.b")


def employment_periods(experience: DataFrame) -> DataFrame:
    """(resume_id, kind, from_month, to_month): periods of employment and the gaps between them, per résumé.

    Rows without résumé, company or readable start are left out; repeated rows change nothing; an empty table gives an
    empty result. Only `resume_id`, `company` and `dates` are read, so other columns cannot clash.
    """
    periods = merge_intervals(employment_intervals(experience), "resume_id", "a", "b")
    return with_gaps(periods, "resume_id").select("resume_id", "kind", yyyymm(F.col("from_unit")).alias("from_month"), yyyymm(F.col("to_unit")).alias("to_month"))
