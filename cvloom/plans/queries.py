"""Queries of the core: name -> function of the session and the data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvloom.functions.contact import contact, email, name, phone
from cvloom.functions.profiles import github, linkedin, profiles
from cvloom.functions.sections import heading_key, live_aliases, section_of, with_sections
from cvloom.functions.skills import SkillDictionary, dictionary_rows, with_skills
from cvloom.functions.skills import skill_words as words_that_spell_skills
from cvloom.functions.text import clean_text, lines_of, strip
from cvloom.functions.vocab import GITHUB_RESERVED, MAX_HEADING
from cvloom.operators import intervals, shred, units
from cvloom.operators.entries import education, education_records, experience, experience_records
from cvloom.plans import pipeline
from cvloom.plans.pipeline import prepare
from cvloom.sources.files import extension, format_error
from cvloom.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _flat(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    return shred.shred_records(spread(table(spark, d, "parsed_records").select("record_id", "resume_id", "payload")), columns=columns)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.found(_flat(spark, d, ["record_id", "field", "entry_no", "line_no"]))


def p1_education(spark: SparkSession, d: str) -> DataFrame:
    return shred.entry_table(_flat(spark, d), "education")


def p1_experience(spark: SparkSession, d: str) -> DataFrame:
    return shred.entry_table(_flat(spark, d), "experience")


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    return shred.line_table(_flat(spark, d))


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    return shred.error_table(_flat(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.employment_periods(spread(table(spark, d, "experience").select("resume_id", "company", "dates")))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "education").select("edu_id", "grade", "agency_id"))


def p4_grades(spark: SparkSession, d: str) -> DataFrame:
    return units.grade_shares(_graded(spark, d), table(spark, d, "agencies"), table(spark, d, "grading_scales"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.usable_grades(_graded(spark, d), table(spark, d, "agencies"), table(spark, d, "grading_scales"))


# ---- the document pipeline over the résumés ---------------------------------------------------------


def _resumes(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "resumes").select("resume_id", "path", "raw_text", "extra_urls"))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _resumes(spark, d).withColumn("clean_text", clean_text(F.col("raw_text")))


def clean_text_resumes(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("resume_id", "clean_text")


def clean_text_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("clean_text"))


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per document of `documents`: lines, non-empty lines and length of the longest line of the cleaned text."""
    t = table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("t")).withColumn("x", lines_of(F.col("t")))
    return t.where("t is not null").select("doc_id", F.size("x").alias("n_lines"), F.size(F.filter("x", lambda y: y != "")).alias("n_filled"), F.array_max(F.transform("x", F.length)).alias("longest"))


def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    x = with_sections(_cleaned(spark, d))
    return x.select("resume_id", F.posexplode_outer("sections").alias("p", "s")).where("s is not null").select("resume_id", (F.col("p") + 1).alias("ord"), "s.section", "s.body")


def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return section_bodies(spark, d).groupBy("section").agg(F.count("*").alias("n_docs"), F.sum((F.col("body") == "").cast("bigint")).alias("n_empty"))


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that are headings, with their section."""
    x = _cleaned(spark, d).where("clean_text is not null").select("resume_id", F.posexplode(lines_of(F.col("clean_text"))).alias("line_no", "line"))
    return x.withColumn("section", section_of(F.col("line"))).where("section is not null").select("resume_id", "line_no", "section")


def heading_alias_join(spark: SparkSession, d: str) -> DataFrame:
    """Headings by spelling: an equi-join of the lines' keys with the table of spellings."""
    x = _cleaned(spark, d).where("clean_text is not null").select(F.explode(lines_of(F.col("clean_text"))).alias("line"))
    short = x.where(F.length(strip(F.col("line"))) <= MAX_HEADING).select(heading_key(F.col("line")).alias("alias"))
    aliases = spark.createDataFrame(list(live_aliases().items()), "alias string, section string")
    return short.join(aliases, "alias").groupBy("alias", "section").agg(F.count("*").alias("n"))


def email_first(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("resume_id", email(F.col("clean_text")).alias("email"))


def email_first_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", email(clean_text(F.col("text"))).alias("email"))


def phone_first(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("resume_id", phone(F.col("clean_text")).alias("phone"))


def name_first(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("resume_id", name(F.col("clean_text")).alias("name"))


def contact_info(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("resume_id", contact(F.col("clean_text")).alias("c")).select("resume_id", "c.*")


#: Text with profile links, built from the customer table by SQL that Spark and DuckDB both run.
CORPUS = """
SELECT c_custkey AS resume_id, concat_ws(chr(10), c_name,
  CASE WHEN c_custkey % 2 = 0 THEN concat('LinkedIn: https://www.linkedin.com/in/user-', CAST(c_custkey AS VARCHAR(20)))
       WHEN c_custkey % 5 = 0 THEN concat('see linkedin.com/in/u', CAST(c_custkey AS VARCHAR(20)), '/en, and linkedin.com/in/in') END,
  CASE WHEN c_custkey % 3 = 0 THEN concat('github.com/dev', CAST(c_custkey AS VARCHAR(20)), ' and http://www.github.com/about')
       WHEN c_custkey % 3 = 1 THEN 'GitHub: https://github.com/acme/repo' ELSE 'github.com/pricing github.com/x' END) AS clean_text,
  CASE WHEN c_custkey % 7 = 0 THEN 'http://LinkedIn.com/in/extra-one/' WHEN c_custkey % 7 = 1 THEN 'https://github.com/embedded/repo' WHEN c_custkey % 7 = 2 THEN 'https://github.com/deep/repo/tree/main' END AS url
FROM customer
"""


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CORPUS.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer")).withColumn("extra_urls", F.array_compact(F.array("url")))


def linkedin_url(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("resume_id", linkedin(F.col("clean_text"), F.col("extra_urls")).alias("linkedin"))


def github_profile(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("resume_id", github(F.col("clean_text"), F.col("extra_urls")).alias("github"))


def profile_links(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("resume_id", profiles(F.col("clean_text"), F.col("extra_urls")).alias("p")).select("resume_id", "p.*")


#: The hosts of the test table's links stand for these.
_HOSTS = (r"(?i)\b(linkedin|github)\.example\b", "$1.com")


def resume_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profile links of the résumés and of the links embedded in them, with the table's invented hosts read as the real ones."""
    urls = F.transform("extra_urls", lambda u: F.regexp_replace(u, *_HOSTS))
    t = F.regexp_replace(F.coalesce("clean_text", F.lit("")), *_HOSTS)
    return _cleaned(spark, d).select("resume_id", profiles(t, urls).alias("p")).select("resume_id", "p.*")


def _skills(spark: SparkSession, d: str) -> DataFrame:
    return with_skills(prepare(_resumes(spark, d)), "skills_text").select("resume_id", F.posexplode_outer("skills").alias("p", "skill")).where("skill is not null").select("resume_id", (F.col("p") + 1).alias("ord"), "skill")


def skills_by_resume(spark: SparkSession, d: str) -> DataFrame:
    return _skills(spark, d)


def skill_words(spark: SparkSession, d: str) -> DataFrame:
    """The skills that words spell, with their first position."""
    return words_that_spell_skills(prepare(_resumes(spark, d)), "skills_text", "resume_id")


def skill_doc_counts(spark: SparkSession, d: str) -> DataFrame:
    return _skills(spark, d).groupBy("skill").agg(F.count("*").alias("n_docs"))


def skill_category_counts(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by category: an equi-join with the dictionary table."""
    dim = dictionary_rows(spark, SkillDictionary.default()).select("category", F.col("canonical").alias("skill"))
    return skill_doc_counts(spark, d).join(dim, "skill").groupBy("category").agg(F.sum("n_docs").alias("n_mentions"), F.count("*").alias("n_skills"))


def skill_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return dictionary_rows(spark, SkillDictionary.default()).select("category", "canonical", "resolved")


def _education(spark: SparkSession, d: str) -> DataFrame:
    return education_records(prepare(_resumes(spark, d)), "resume_id", "education_text")


def education_entries(spark: SparkSession, d: str) -> DataFrame:
    return _education(spark, d)


def education_degree_counts(spark: SparkSession, d: str) -> DataFrame:
    return _education(spark, d).groupBy("degree").agg(F.count("*").alias("n"))


def _experience(spark: SparkSession, d: str) -> DataFrame:
    return experience_records(prepare(_resumes(spark, d)), "resume_id", "experience_text")


def experience_entries(spark: SparkSession, d: str) -> DataFrame:
    return _experience(spark, d).select("resume_id", "entry_no", "job_title", "company", "dates", "location", F.size("description").alias("n_lines"))


def experience_bullets(spark: SparkSession, d: str) -> DataFrame:
    return _experience(spark, d).select("resume_id", "entry_no", F.posexplode("description").alias("p", "bullet")).select("resume_id", "entry_no", (F.col("p") + 1).alias("line_no"), "bullet")


def resume_records(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: one nested record per résumé."""
    return pipeline.resume_records(_resumes(spark, d))


def resume_json(spark: SparkSession, d: str) -> DataFrame:
    return resume_records(spark, d).select("resume_id", pipeline.record_json().alias("json"), "error")


def resume_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.dashboard(resume_records(spark, d))


def education_card_view(spark: SparkSession, d: str) -> DataFrame:
    t = prepare(_resumes(spark, d))
    return pipeline.education_cards(t.select("resume_id", education(F.col("education_text")).alias("education")))


def experience_card_view(spark: SparkSession, d: str) -> DataFrame:
    t = prepare(_resumes(spark, d))
    return pipeline.experience_cards(t.select("resume_id", experience(F.col("experience_text")).alias("experience")))


def file_size_labels(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in three magnitudes, derived from the length of the text."""
    n = F.octet_length(F.coalesce(F.col("raw_text"), F.lit(""))).cast("bigint")
    x = _resumes(spark, d).select("resume_id", F.explode(F.array(n, n * 700, n * 90000)).alias("n_bytes"))
    return x.select("resume_id", "n_bytes", pipeline.file_size_label(F.col("n_bytes")).alias("label"))


def format_routes(spark: SparkSession, d: str) -> DataFrame:
    """Which decoder each file goes to, or why none."""
    return _resumes(spark, d).select("resume_id", extension(F.col("path")).alias("ext"), format_error(F.col("path")).alias("error"))


def reserved_slug_anti(spark: SparkSession, d: str) -> DataFrame:
    """Profile links whose user is no reserved word: an anti-join."""
    users = _corpus(spark, d).select("resume_id", F.explode(F.regexp_extract_all("clean_text", F.lit(r"(?i)github\.com/([a-z0-9_-]+)"), F.lit(1))).alias("slug"))
    reserved = spark.createDataFrame([(x,) for x in GITHUB_RESERVED], "slug string")
    return users.join(reserved, "slug", "left_anti").groupBy("slug").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_education, p1_experience, p1_lines, p1_errors, p3_found, p4_found, p4_grades,
        clean_text_resumes, clean_text_docs, line_stats, heading_lines, heading_alias_join, section_bodies, section_counts,
        email_first, email_first_docs, phone_first, name_first, contact_info, linkedin_url, github_profile, profile_links, resume_profiles,
        skills_by_resume, skill_words, skill_doc_counts, skill_category_counts, skill_dictionary,
        education_entries, education_degree_counts, experience_entries, experience_bullets,
        resume_records, resume_json, resume_dashboard, education_card_view, experience_card_view, file_size_labels, format_routes, reserved_slug_anti,
    )
}
