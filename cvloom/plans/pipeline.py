"""The document pipeline: text in, one nested record per document out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvloom.functions.contact import contact
from cvloom.functions.profiles import profiles
from cvloom.functions.sections import section_body, with_sections
from cvloom.functions.skills import SkillDictionary, with_skills
from cvloom.functions.text import blank_to_null, clean_text, strip
from cvloom.operators.entries import education, experience

RECORD = ["name", "email", "phone", "skills", "education", "experience", "linkedin", "github"]


def prepare(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds `clean_text`, `sections`, and for each extractor the text that it reads: its section, or else the whole text."""
    d = with_sections(df.withColumn("clean_text", clean_text(F.col(text))))
    whole = blank_to_null(F.col("clean_text"))
    return d.withColumns({f"{s}_text": F.coalesce(section_body("sections", s), whole) for s in ("skills", "education", "experience")})


def resume_records(df: DataFrame, key: str = "resume_id", text: str = "raw_text", urls: str = "extra_urls", dictionary: SkillDictionary | None = None) -> DataFrame:
    """One row per document: key, the eight fields of RECORD, and `error`.

    Narrow: a document is one row from its text to its record, cleaned once, on a stream as in a batch. Null text gives the
    error 'no text' and empty fields; lists are never null. Repeated keys give a record each. Other columns are left out, so
    none can clash, but for `error`, which is kept where it is given.
    """
    known = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    base = df.select(key, F.col(text).alias("raw_text"), F.col(urls).alias("extra_urls"), known.alias("error"))
    d = with_skills(prepare(base), "skills_text", dictionary=dictionary)
    d = d.withColumns({"_c": contact(F.col("clean_text")), "_p": profiles(F.coalesce("clean_text", F.lit("")), F.col("extra_urls"))})
    d = d.withColumns({"education": education(F.col("education_text")), "experience": experience(F.col("experience_text"))})
    own = {"name": "_c.name", "email": "_c.email", "phone": "_c.phone", "linkedin": "_p.linkedin", "github": "_p.github"}
    error = F.coalesce("error", F.when(F.col("raw_text").isNull(), "no text"))
    return d.select(key, *[F.col(own.get(c, c)).alias(c) for c in RECORD], error.alias("error"))


def record_json(fields: list[str] = RECORD, ascii_only: bool = False) -> Column:
    """The record as JSON with all keys, null ones included; if wanted, with other than ASCII characters escaped."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": str(ascii_only).lower()})


def shown(c: Column, fallback: str = "—") -> Column:
    """A value for people: without blanks at its ends, or the fallback where there is none."""
    return F.when(c.isNotNull() & (c.cast("string") != ""), strip(c.cast("string"))).otherwise(F.lit(fallback))


def file_size_label(n: Column) -> Column:
    """A size in bytes for people: B, KB with one decimal, or MB with two; halves are rounded to even."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.2f MB", F.bround(n / (1024 * 1024), 2)))


def dashboard(records: DataFrame, key: str = "resume_id") -> DataFrame:
    """What a record shows at a glance: labels for what is missing, and the numbers of skills and entries."""
    return records.select(key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Not detected")).alias(c) for c in ("name", "email", "phone", "linkedin", "github")], *[F.size(c).alias(f"n_{c}") for c in ("skills", "education", "experience")])


def education_cards(records: DataFrame, key: str = "resume_id") -> DataFrame:
    """One row per education entry as shown: the field only if the degree does not name it already."""
    e = records.select(key, F.posexplode("education").alias("p", "e")).select(key, (F.col("p") + 1).alias("entry_no"), "e.*")
    field = F.when(~F.coalesce(F.col("degree"), F.lit("Degree not specified")).contains(F.col("field_of_study")), F.col("field_of_study"))
    return e.select(key, "entry_no", F.coalesce("degree", F.lit("Degree not specified")).alias("title"), F.coalesce("institution", F.lit("")).alias("institution"), F.concat_ws(" · ", "dates", field, "grade", "location").alias("meta"))


def experience_cards(records: DataFrame, key: str = "resume_id") -> DataFrame:
    """One row per experience entry as shown."""
    e = records.select(key, F.posexplode("experience").alias("p", "e")).select(key, (F.col("p") + 1).alias("entry_no"), "e.*")
    return e.select(key, "entry_no", F.coalesce("job_title", F.lit("Position not specified")).alias("title"), F.coalesce("company", F.lit("")).alias("company"), F.concat_ws(" · ", "dates", "location").alias("meta"), F.size("description").alias("n_lines"))
