"""DuckDB SQL for skills, and for whole records and what is shown of them."""

from __future__ import annotations

import re

from cvloom.functions.skills import SkillDictionary
from cvloom.functions.vocab import LINKEDIN_RESERVED, MAX_HEADING, STRICT_SKILLS
from cvloom.plans.oracle import BODIES, HEADINGS, RESUMES, SQL as CORE, _GH, _GITHUB, _IN, _LINKEDIN, _OK, _SKILL_DIM, _SKILL_WORDS, _quoted
from cvloom.plans.queries import CORPUS
from cvloom.plans.oracle_entries import _EXP, EDUCATION

_DICT = SkillDictionary.default()


def _beside(skill: str) -> str:
    """What must not stand beside a skill, as the inside of a character class."""
    if skill in STRICT_SKILLS:
        return r"A-Za-z0-9+#.\-"
    return "A-Za-z0-9" if skill[-1] in "+#" else "A-Za-z0-9." if "." in skill else r"\p{L}\p{N}_"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _row(rank: int, skill: str) -> str:
    # no look-around: the character before (of which a line end at the beginning makes sure) belongs to the first group, whose
    # length gives the position of the skill
    body, no = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", skill), _beside(skill)
    return f"({rank}, {_q(skill.lower())}, {_q(_DICT.lookup().get(skill.lower(), skill))}, {_q(f'(?is)^(.*?[^{no}]){body}(?:[^{no}]|$)')})"


_SKILLS = f"""
WITH s AS (SELECT resume_id, max(CASE WHEN section = 'skills' THEN nullif(body, '') END) AS body FROM ({BODIES}) GROUP BY resume_id),
c AS ({RESUMES}),
src AS (SELECT c.resume_id, regexp_replace(coalesce(s.body, c.t), '(?m)^\\s*[A-Za-z &/()]+:\\s*', ' ', 'g') AS p FROM c LEFT JOIN s USING (resume_id) WHERE regexp_matches(coalesce(s.body, c.t), '\\S')),
lower_src AS MATERIALIZED (SELECT resume_id, chr(10) || p AS p, lower(p) AS lp FROM src),
look(rank, low, skill, pat) AS (VALUES {", ".join(_row(k, s) for k, s in enumerate(_DICT.ranked()))}),
w AS MATERIALIZED ({_SKILL_WORDS}),
g AS MATERIALIZED (SELECT resume_id, rank, skill, regexp_extract(p, pat, 1) AS before FROM lower_src, look WHERE contains(lp, low)),
f AS (SELECT resume_id, rank, skill, length(before) - 1 AS pos FROM g WHERE before <> ''),
f1 AS (SELECT resume_id, skill, min(rank) AS rank, arg_min(pos, rank) AS pos FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.resume_id = f.resume_id AND w.skill = f.skill) GROUP BY resume_id, skill),
u AS (SELECT resume_id, pos, 1 AS step, 0 AS rank, skill FROM w UNION ALL SELECT resume_id, pos, 2, rank, skill FROM f1)
SELECT resume_id, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY pos, step, rank, skill) AS INTEGER) AS ord, skill FROM u"""

_RECORD = f"""
WITH k AS (SELECT resume_id, list(skill ORDER BY ord) AS skills FROM ({_SKILLS}) GROUP BY resume_id),
e AS (SELECT resume_id, list(struct_pack(degree := degree, institution := institution, dates := dates, field_of_study := field_of_study, grade := grade, location := CAST(NULL AS VARCHAR)) ORDER BY entry_no) AS education FROM ({EDUCATION}) GROUP BY resume_id),
x AS (SELECT resume_id, list(struct_pack(job_title := job_title, company := company, dates := dates, location := location, description := description) ORDER BY entry_no) AS experience FROM ({_EXP}) GROUP BY resume_id)
SELECT r.resume_id, c.name, c.email, c.phone, coalesce(k.skills, []) AS skills, coalesce(e.education, []) AS education, coalesce(x.experience, []) AS experience,
       CAST(NULL AS VARCHAR) AS linkedin, CAST(NULL AS VARCHAR) AS github, CASE WHEN r.raw_text IS NULL THEN 'no text' END AS error
FROM resumes r LEFT JOIN ({CORE["contact_info"]}) c USING (resume_id) LEFT JOIN k USING (resume_id) LEFT JOIN e USING (resume_id) LEFT JOIN x USING (resume_id)"""


def _linked(url: str) -> str:
    """The résumés as the statements for profile links expect them: with the one embedded link that counts."""
    real = "regexp_replace({}, '(?i)\\b(linkedin|github)\\.example\\b', '\\1.com', 'g')"
    return f"""
SELECT r.resume_id, coalesce({real.format('c.t')}, '') AS clean_text, list_filter(list_transform(coalesce(extra_urls, []), lambda u: {real.format('u')}), lambda u: {url})[1] AS url
FROM resumes r JOIN ({RESUMES}) c USING (resume_id)"""


_IN_URL = f"regexp_matches(u, '^{_IN}') AND length(regexp_extract(u, '^{_IN}', 1)) >= 2 AND lower(regexp_extract(u, '^{_IN}', 1)) NOT IN ({_quoted(LINKEDIN_RESERVED)})"
_GH_URL = _OK.replace("(s)", f"(regexp_extract(u, '^{_GH}', 1))") + f" AND NOT contains(ltrim(regexp_replace(u, '^{_GH}', ''), '/'), '/')"


def _shown(c: str) -> str:
    return f"coalesce(nullif({c}, ''), 'Not detected') AS {c}"


SQL: dict[str, str] = {
    "resume_profiles": f"SELECT a.resume_id, a.linkedin, b.github FROM ({_LINKEDIN.replace(CORPUS, _linked(_IN_URL))}) a JOIN ({_GITHUB.replace(CORPUS, _linked(_GH_URL))}) b USING (resume_id)",
    "heading_alias_join": f"""
        WITH {HEADINGS} SELECT alias, section, count(*) AS n
        FROM (SELECT l.alias, l.section FROM x JOIN live l ON l.alias = lower(trim(regexp_replace(trim(x.line), '[\\s:.\\-–—|]+$', ''))) AND length(trim(x.line)) <= {MAX_HEADING}) GROUP BY alias, section""",
    "skills_by_resume": _SKILLS,
    "skill_doc_counts": f"SELECT skill, count(*) AS n_docs FROM ({_SKILLS}) GROUP BY skill",
    "skill_category_counts": f"""
        WITH dim(category, skill, resolved) AS (VALUES {_SKILL_DIM}), n AS (SELECT skill, count(*) AS n_docs FROM ({_SKILLS}) GROUP BY skill)
        SELECT category, CAST(sum(n_docs) AS BIGINT) AS n_mentions, count(*) AS n_skills FROM n JOIN dim USING (skill) GROUP BY category""",
    # the hosts of the table's links are no profile hosts, so both profile fields are null
    "resume_json": f"""
        SELECT resume_id, CAST(to_json(struct_pack(name := name, email := email, phone := phone, skills := skills, education := education, experience := experience, linkedin := linkedin, github := github)) AS VARCHAR) AS json, error FROM ({_RECORD})""",
    "resume_dashboard": f"""
        SELECT resume_id, {", ".join(map(_shown, ("name", "email", "phone", "linkedin", "github")))}, CAST(len(skills) AS INTEGER) AS n_skills, CAST(len(education) AS INTEGER) AS n_education, CAST(len(experience) AS INTEGER) AS n_experience FROM ({_RECORD})""",
    "education_card_view": f"""
        SELECT resume_id, entry_no, coalesce(degree, 'Degree not specified') AS title, coalesce(institution, '') AS institution,
               concat_ws(' · ', dates, CASE WHEN NOT contains(coalesce(degree, 'Degree not specified'), field_of_study) THEN field_of_study END, grade) AS meta FROM ({EDUCATION})""",
    "experience_card_view": f"""
        SELECT resume_id, entry_no, coalesce(job_title, 'Position not specified') AS title, coalesce(company, '') AS company, concat_ws(' · ', dates, location) AS meta, CAST(len(description) AS INTEGER) AS n_lines FROM ({_EXP})""",
}
