"""DuckDB SQL for education and experience records, from the rules: conditional minima over numbered lines."""

from __future__ import annotations

from cvloom.functions import patterns as P
from cvloom.functions.vocab import NOT_TITLE_WORDS, TITLE_WORDS
from cvloom.plans.oracle import BODIES, RESUMES


def _q(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _lines(section: str, keep_blank: bool) -> str:
    """CTEs up to `ln` (resume_id, n, line) of a section's body, or else of the whole text."""
    return f"""
s AS (SELECT resume_id, max(CASE WHEN section = '{section}' THEN nullif(body, '') END) AS body FROM ({BODIES}) GROUP BY resume_id),
c AS ({RESUMES}),
src AS (SELECT c.resume_id, coalesce(s.body, nullif(c.t, '')) AS t FROM c LEFT JOIN s USING (resume_id)),
ln0 AS (SELECT resume_id, unnest(range(len(string_split(t, chr(10))))) AS n, trim(unnest(string_split(t, chr(10)))) AS line FROM src WHERE t IS NOT NULL),
ln AS (SELECT * FROM ln0{"" if keep_blank else " WHERE line <> ''"})"""


_BOUNDED = [d for d in P._DEGREES if "\\.?" in d]
_FREE = [d for d in P._DEGREES if "\\.?" not in d]
#: Without look-around: the characters beside an abbreviation are matched too, and the token is a group.
_TOKEN = f"(?i)(?:(?:^|[^A-Za-z])({'|'.join(_BOUNDED)})(?:[^A-Za-z]|$)|({'|'.join(_FREE)}))"
_BEFORE = f"(?i)^(.*?)(?:(?:^|[^A-Za-z])(?:{'|'.join(_BOUNDED)})(?:[^A-Za-z]|$)|(?:{'|'.join(_FREE)}))"


def _degree_ctes(source: str, name: str, c: str) -> str:
    """CTEs that add tok (degree token), field and degree of the text in column c."""
    return f"""
{name}1 AS (SELECT *, coalesce(nullif(regexp_extract({c}, '{_TOKEN}', 1), ''), nullif(regexp_extract({c}, '{_TOKEN}', 2), '')) AS tok, length(regexp_extract({c}, '{_BEFORE}', 1)) AS pre FROM {source}),
{name}2 AS (SELECT *, substr({c}, pre + strpos(substr({c}, pre + 1), tok) + length(tok)) AS after FROM {name}1),
{name}3 AS (SELECT *, rtrim(trim(regexp_extract(after, '{P.FIELD_AFTER}', 1)), ')') AS near, nullif(rtrim(trim(regexp_extract({c}, '{P.FIELD_ANYWHERE}', 1)), ')'), '') AS far FROM {name}2),
{name} AS (SELECT * EXCLUDE (near, far), CASE WHEN tok IS NOT NULL THEN CASE WHEN length(near) > 1 THEN near ELSE far END END AS field FROM {name}3)"""


def _degree(a: str = "") -> str:
    return f"CASE WHEN {a}tok IS NOT NULL THEN trim({a}tok) || coalesce(' in ' || {a}field, '') END"


def _grade(c: str) -> str:
    return f"nullif(trim(regexp_extract({c}, '{P.GRADE}')), '')"


def _edu_dates(c: str) -> str:
    return f"coalesce(nullif(trim(regexp_extract({c}, '{P.EDU_DATES}')), ''), nullif(regexp_extract({c}, '{P.EDU_YEAR}'), ''))"


def _words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"


def _share(c: str, more: str = "") -> str:
    return f"length(regexp_replace({c}, '[^\\p{{L}}{more}]', '', 'g')) / length({c})"


def _is_inst(c: str) -> str:
    return (
        f"(length({c}) BETWEEN 3 AND 120 AND NOT regexp_matches({c}, '{P.EDU_SKIP}') AND NOT regexp_matches({c}, '{P.GRADE}') AND NOT regexp_matches({c}, '{P.EDU_DATE_ONLY}') "
        f"AND NOT regexp_matches({c}, '{_TOKEN}') AND {_words(c)} <= 8 AND {_share(c)} >= 0.45)"
    )


def _capitals(c: str) -> str:
    return f"NOT regexp_matches({c}, '(?:^|\\s)[\\p{{Ll}}\\p{{Lo}}\\p{{Lm}}]')"


def _finish(fields: list[str], same: list[str], short: int) -> str:
    keys = ", ".join(f"lower(trim(coalesce({c}, '')))" for c in same)
    cols = ", ".join(fields)
    return f"""
size AS (SELECT resume_id, count(*) AS n_lines FROM ln0 WHERE line <> '' GROUP BY resume_id),
u AS (SELECT resume_id, g, {cols}, 0 AS inl FROM grouped UNION ALL SELECT resume_id, g, {cols}, 1 FROM inline_),
cnt AS (SELECT resume_id, sum(inl) AS n_in, sum(1 - inl) AS n_gr FROM u GROUP BY resume_id),
pick AS (SELECT u.* FROM u JOIN cnt USING (resume_id) JOIN size USING (resume_id) WHERE u.inl = CASE WHEN n_lines <= {short} AND n_in > 0 OR n_gr = 0 THEN 1 ELSE 0 END),
uniq AS (SELECT *, row_number() OVER (PARTITION BY resume_id, {keys} ORDER BY g) AS r FROM pick)
SELECT resume_id, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY g) AS INTEGER) AS entry_no, {cols} FROM uniq WHERE r = 1"""


EDUCATION = f"""
WITH {_lines('education', False)},
{_degree_ctes('ln', 'dg', 'line')},
f AS (SELECT resume_id, n, line, tok, field, {_degree()} AS degree, {_grade('line')} AS grade, {_edu_dates('line')} AS dates, regexp_matches(line, '{P.EDU_DATE_ONLY}') AS only_date, {_is_inst('line')} AS inst,
             CASE WHEN regexp_matches(line, '{P.INSTITUTION}') THEN 3 ELSE 0 END + CASE WHEN {_capitals('line')} THEN 1 ELSE 0 END AS conf FROM dg),
e AS (SELECT *, greatest(1, sum(CASE WHEN tok IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY resume_id ORDER BY n)) AS g FROM f),
m AS (SELECT *, min(CASE WHEN grade IS NOT NULL THEN n END) OVER (PARTITION BY resume_id, g) AS gn FROM e),
grouped AS (SELECT * FROM (SELECT resume_id, g,
   arg_min(degree, n) FILTER (degree IS NOT NULL AND n IS DISTINCT FROM gn AND NOT (only_date AND dates IS NOT NULL)) AS degree,
   arg_max(line, conf * 100000 - n) FILTER (inst AND tok IS NULL AND n IS DISTINCT FROM gn AND NOT (only_date AND dates IS NOT NULL)) AS institution,
   arg_min(dates, n) FILTER (dates IS NOT NULL AND n IS DISTINCT FROM gn) AS dates,
   (arg_min(struct_pack(x := field), n) FILTER (degree IS NOT NULL AND n IS DISTINCT FROM gn AND NOT (only_date AND dates IS NOT NULL))).x AS field_of_study,
   arg_min(grade, n) FILTER (n = gn) AS grade FROM m GROUP BY resume_id, g) WHERE length(degree) >= 3),
pt0 AS (SELECT resume_id, n AS g, list_filter(list_transform(regexp_split_to_array(line, '{P.EDU_SEPARATOR}'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM e WHERE tok IS NOT NULL),
pt AS (SELECT resume_id, g, unnest(range(len(ps))) AS p, unnest(ps) AS part FROM pt0 WHERE len(ps) >= 2),
{_degree_ctes('pt', 'pd', 'part')},
pf AS (SELECT resume_id, g, p, part, field, {_degree()} AS degree, {_grade('part')} AS grade, {_edu_dates('part')} AS dates, {_is_inst('part')} AS inst FROM pd),
p1 AS (SELECT *, min(CASE WHEN degree IS NOT NULL THEN p END) OVER w AS d FROM pf WINDOW w AS (PARTITION BY resume_id, g)),
p2 AS (SELECT *, min(CASE WHEN grade IS NOT NULL AND p IS DISTINCT FROM d THEN p END) OVER w AS gr FROM p1 WINDOW w AS (PARTITION BY resume_id, g)),
p3 AS (SELECT *, min(CASE WHEN dates IS NOT NULL AND p IS DISTINCT FROM d AND p IS DISTINCT FROM gr THEN p END) OVER w AS dt FROM p2 WINDOW w AS (PARTITION BY resume_id, g)),
p4 AS (SELECT *, min(CASE WHEN inst AND p IS DISTINCT FROM d AND p IS DISTINCT FROM gr AND p IS DISTINCT FROM dt THEN p END) OVER w AS ins FROM p3 WINDOW w AS (PARTITION BY resume_id, g)),
inline_ AS (SELECT * FROM (SELECT resume_id, g, max(degree) FILTER (p = d) AS degree, max(part) FILTER (p = ins) AS institution, max(dates) FILTER (p = dt) AS dates, max(field) FILTER (p = d) AS field_of_study, max(grade) FILTER (p = gr) AS grade
            FROM p4 GROUP BY resume_id, g) WHERE length(degree) >= 3),
{_finish(['degree', 'institution', 'dates', 'field_of_study', 'grade'], ['degree', 'institution'], 3)}
"""


def _not_record(c: str) -> str:
    return f"(regexp_matches({c}, '{P.EXP_DATE_ONLY}') OR regexp_matches({c}, '{P.BULLET}') OR regexp_matches({c}, '{P.DEGREE_GUARD}'))"


def _few(c: str) -> str:
    return f"(length({c}) - length(replace({c}, ',', '')) <= 2 AND length({c}) - length(replace({c}, '|', '')) <= 2 AND {_words(c)} <= 7)"


def _title(c: str) -> str:
    ws = f"regexp_split_to_array(lower({c}), '\\s+')"
    return f"coalesce(length({c}) BETWEEN 3 AND 80 AND NOT {_not_record(c)} AND {_few(c)} AND list_has_any({ws}, [{_q(TITLE_WORDS)}]) AND NOT list_has_any({ws}, [{_q(NOT_TITLE_WORDS)}]) AND {_share(c, ' ')} >= 0.55, false)"


def _comp(c: str) -> str:
    return f"coalesce(length({c}) BETWEEN 2 AND 80 AND NOT {_not_record(c)} AND {_few(c)} AND {_share(c)} >= 0.45 AND (regexp_matches({c}, '{P.COMPANY}') OR {_capitals(c)}), false)"


def _loc(c: str) -> str:
    return f"coalesce(length({c}) BETWEEN 1 AND 60 AND NOT {_not_record(c)} AND regexp_matches({c}, '{P.LOCATION}'), false)"


def _exp_dates(c: str) -> str:
    return f"nullif(trim(regexp_extract({c}, '{P.EXP_DATES}')), '')"


_EXP = f"""
WITH {_lines('experience', True)},
a AS (SELECT *, regexp_matches(line, '{P.BULLET}') AS bullet, regexp_matches(line, '{P.EXP_DATE_ONLY}') AS only_date, {_title('line')} AS title, {_exp_dates('line')} AS dates,
             line <> '' AND coalesce(lag(line) OVER (PARTITION BY resume_id ORDER BY n), '') = '' AS starts FROM ln),
b AS (SELECT *, sum(starts::INT) OVER (PARTITION BY resume_id ORDER BY n) AS block, CASE WHEN bullet THEN NULL WHEN only_date THEN 'date' WHEN title THEN 'title' END AS label FROM a),
b2 AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY resume_id, block ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b WHERE line <> ''),
b3 AS (SELECT *, sum((starts OR coalesce(label = 'title' AND before = 'date', false))::INT) OVER (PARTITION BY resume_id ORDER BY n) AS g,
        CASE WHEN bullet OR only_date THEN NULL WHEN dates IS NOT NULL THEN nullif(trim(regexp_replace(line, '{P.EXP_DATES}', '', 'g'), ' |—–-,'), '') WHEN NOT title THEN line END AS rest FROM b2),
b4 AS (SELECT *, {_title('rest')} AS rt, {_comp('rest')} AS rc, {_loc('rest')} AS rl FROM b3),
b5 AS (SELECT *, min(CASE WHEN rl THEN n END) OVER (PARTITION BY resume_id, g) AS ln_ FROM b4),
gr AS (SELECT resume_id, g,
   coalesce(arg_min(line, n) FILTER (title AND NOT bullet AND NOT only_date AND dates IS NULL), arg_min(rest, n) FILTER (rest IS NOT NULL AND n IS DISTINCT FROM ln_ AND rt)) AS title1,
   arg_min(rest, n) FILTER (rest IS NOT NULL AND n IS DISTINCT FROM ln_ AND rc AND NOT rt) AS company1,
   arg_min(coalesce(dates, line), n) FILTER (NOT bullet AND (only_date OR dates IS NOT NULL)) AS dates,
   max(rest) FILTER (n = ln_) AS location,
   arg_min(struct_pack(r := rest, t := rt, c := rc), n) FILTER (rest IS NOT NULL) AS fst,
   list(regexp_replace(line, '{P.BULLET}', '') ORDER BY n) FILTER (bullet AND regexp_replace(line, '{P.BULLET}', '') <> '') AS description
   FROM b5 GROUP BY resume_id, g),
grouped AS (SELECT * FROM (SELECT resume_id, g, CASE WHEN title1 IS NULL AND company1 IS NULL AND fst.t THEN fst.r ELSE title1 END AS job_title,
   CASE WHEN title1 IS NULL AND company1 IS NULL AND fst.c AND NOT fst.t THEN fst.r ELSE company1 END AS company, dates, location, coalesce(description, []) AS description FROM gr)
   WHERE job_title IS NOT NULL OR company IS NOT NULL AND dates IS NOT NULL),
pt0 AS (SELECT resume_id, n AS g, list_filter(list_transform(regexp_split_to_array(line, '{P.EXP_SEPARATOR}'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM ln WHERE regexp_matches(line, '[|—–]')),
pt AS (SELECT resume_id, g, unnest(range(len(ps))) AS p, unnest(ps) AS part FROM pt0 WHERE len(ps) >= 2),
pf AS (SELECT *, {_exp_dates('part')} AS dates, {_title('part')} AS t, {_loc('part')} AS l, {_comp('part')} AS k FROM pt),
p1 AS (SELECT *, min(CASE WHEN dates IS NOT NULL THEN p END) OVER w AS dt FROM pf WINDOW w AS (PARTITION BY resume_id, g)),
p2 AS (SELECT *, min(CASE WHEN t AND p IS DISTINCT FROM dt THEN p END) OVER w AS tt FROM p1 WINDOW w AS (PARTITION BY resume_id, g)),
p3 AS (SELECT *, min(CASE WHEN l AND p IS DISTINCT FROM dt AND p IS DISTINCT FROM tt THEN p END) OVER w AS lt FROM p2 WINDOW w AS (PARTITION BY resume_id, g)),
p4 AS (SELECT *, min(CASE WHEN k AND p IS DISTINCT FROM dt AND p IS DISTINCT FROM tt AND p IS DISTINCT FROM lt THEN p END) OVER w AS kt FROM p3 WINDOW w AS (PARTITION BY resume_id, g)),
inline_ AS (SELECT * FROM (SELECT resume_id, g, max(part) FILTER (p = tt) AS job_title, max(part) FILTER (p = kt) AS company, max(dates) FILTER (p = dt) AS dates, max(part) FILTER (p = lt) AS location, CAST([] AS VARCHAR[]) AS description FROM p4 GROUP BY resume_id, g)
   WHERE job_title IS NOT NULL OR company IS NOT NULL AND dates IS NOT NULL),
{_finish(['job_title', 'company', 'dates', 'location', 'description'], ['job_title', 'company', 'dates'], 2)}
"""

SQL: dict[str, str] = {
    "education_entries": f"SELECT *, CAST(NULL AS VARCHAR) AS location FROM ({EDUCATION})",
    "education_degree_counts": f"SELECT degree, count(*) AS n FROM ({EDUCATION}) GROUP BY degree",
    "experience_entries": f"SELECT resume_id, entry_no, job_title, company, dates, location, CAST(len(description) AS INTEGER) AS n_lines FROM ({_EXP})",
    "experience_bullets": f"SELECT resume_id, entry_no, CAST(unnest(range(1, len(description) + 1)) AS INTEGER) AS line_no, unnest(description) AS bullet FROM ({_EXP})",
}
