"""DuckDB SQL that must give the same rows as the query of the same name.

The statements are written from the rules, not from the Spark expressions: relational where those use arrays, and in RE2's
dialect, which has no look-around. Vocabularies are shared values.
"""

from __future__ import annotations

from cvloom.functions.skills import SkillDictionary
from cvloom.functions.vocab import GITHUB_RESERVED, HEADING_WORDS, JOB_WORDS, LINKEDIN_RESERVED, MAX_HEADING, SECTION_ALIASES, SENTENCE_WORDS
from cvloom.operators.intervals import PLACEHOLDERS
from cvloom.plans.queries import CORPUS


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _cleaned(source: str, key: str, text: str) -> str:
    """(key, t): cleaned text."""
    blanks = " || ".join(f"chr({c})" for c in (0xA0, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000, 0xFEFF))
    n = 17
    plain = f"translate(nfc_normalize({text}), chr(8232) || chr(8233) || {blanks}, chr(10) || chr(10) || repeat(' ', {n}))"
    no_control = f"regexp_replace({plain}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g')"
    ends = f"regexp_replace({no_control}, '\\r\\n?', chr(10), 'g')"
    stripped = f"array_to_string(list_transform(string_split({ends}, chr(10)), lambda x: trim(x, ' ' || chr(9))), chr(10))"
    runs = f"regexp_replace(regexp_replace({stripped}, '[ \\t]+', ' ', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g')"
    return f"SELECT {key}, trim({runs}, ' ' || chr(9) || chr(10)) AS t FROM {source}"


RESUMES = _cleaned("resumes", "resume_id", "raw_text")
DOCS = _cleaned("documents", "doc_id", "text")

_ALIASES = ", ".join(f"('{a}', '{s}')" for s, names in SECTION_ALIASES.items() for a in names)
HEADINGS = f"""
c AS ({RESUMES}),
x AS (SELECT resume_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM c WHERE t IS NOT NULL),
aliases(alias, section) AS (VALUES {_ALIASES}),
stop(word) AS (SELECT unnest([{_quoted(SENTENCE_WORDS)}])),
live AS (SELECT * FROM aliases a WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE list_contains(string_split(a.alias, ' '), s.word))),
h AS (SELECT x.resume_id, x.i, x.line, l.section FROM x LEFT JOIN live l
      ON l.alias = lower(trim(regexp_replace(trim(x.line), '[\\s:.\\-–—|]+$', ''))) AND length(trim(x.line)) <= {MAX_HEADING})
"""
BODIES = f"""
WITH {HEADINGS},
r AS (SELECT *, sum(CASE WHEN section IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY resume_id ORDER BY i) AS b FROM h),
blocks AS (SELECT resume_id, b, max(section) AS section, min(i) AS first_line,
                  trim(coalesce(string_agg(CASE WHEN section IS NULL THEN line END, chr(10) ORDER BY i), ''), ' ' || chr(10)) AS body
           FROM r WHERE b > 0 GROUP BY resume_id, b),
merged AS (SELECT resume_id, section, min(first_line) AS first_line, coalesce(string_agg(CASE WHEN body <> '' THEN body END, chr(10) || chr(10) ORDER BY first_line), '') AS body FROM blocks GROUP BY resume_id, section)
SELECT resume_id, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY first_line) AS INTEGER) AS ord, section, body FROM merged
"""

_EMAIL = r"(?:^|[^.0-9A-Za-z_\p{L}\p{N}])([a-zA-Z0-9][a-zA-Z0-9._%+\-]*@[a-zA-Z0-9\-]+(?:\.[a-zA-Z0-9\-]+)*\.[a-zA-Z]{2,10})(?:[^a-zA-Z0-9]|$)"
_LABEL = r"(?i)^\s*(?:phone|mobile|cell|tel|telephone|email|e[\s\-]?mail|linkedin|github|address|location|website|url|portfolio|contact|dob|date\s+of\s+birth|nationality|gender)\s*[:\-]?\s*"
_PHONE = r"(?:\+\d{1,3}[\s\-]?)?(?:\(\d{1,4}\)[\s\-]?)?\d[\d\s\-.]{6,17}\d[%/]?"


def _email(source: str, key: str) -> str:
    return f"SELECT {key}, lower(nullif(regexp_extract(t, '{_EMAIL}', 1), '')) AS email FROM ({source})"


_PHONES = f"""
SELECT resume_id, trim(list_filter(regexp_extract_all(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '{_LABEL}', ''))), chr(10)), '{_PHONE}'),
  lambda p: NOT regexp_matches(p, '[%/]$') AND length(regexp_replace(p, '[^0-9]', '', 'g')) >= 7)[1], ' ' || chr(10)) AS phone FROM ({RESUMES})
"""
_WORDS = "list_filter(string_split(x, ' '), lambda w: w <> '')"


def _cap(w: str) -> str:
    return f"concat(upper(left({w}, 1)), lower(substr({w}, 2)))"


def _parts(mark: str) -> str:
    m = mark.replace("'", "''")
    return f"array_to_string(list_transform(string_split(w, '{m}'), lambda q: {_cap('q')}), '{m}')"


_NAMES = f"""
WITH c AS ({RESUMES}),
x AS (SELECT resume_id, unnest(list_filter(list_transform(string_split(t, chr(10)), lambda y: trim(y)), lambda y: y <> '')[1:12]) AS x,
             unnest(range(12)) AS i FROM c),
fit AS (SELECT resume_id, i, x FROM x WHERE x IS NOT NULL AND length(x) BETWEEN 2 AND 50 AND NOT contains(x, '@') AND NOT regexp_matches(x, '(?i)https?://|www\\.')
        AND NOT regexp_matches(x, '{_LABEL}') AND len({_WORDS}) BETWEEN 2 AND 5
        AND NOT list_has_any(list_transform({_WORDS}, lambda w: lower(w)), [{_quoted(HEADING_WORDS + JOB_WORDS)}])
        AND length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / length(x) >= 0.6),
best AS (SELECT resume_id, arg_min(x, i) AS x FROM fit GROUP BY resume_id)
SELECT c.resume_id, CASE WHEN b.x IS NOT NULL THEN array_to_string(list_transform(list_filter(string_split(b.x, ' '), lambda w: w <> ''), lambda w:
  CASE WHEN contains(w, '-') THEN {_parts('-')} WHEN contains(w, '''') THEN {_parts("'")} ELSE {_cap('w')} END), ' ') END AS name
FROM c LEFT JOIN best b ON b.resume_id = c.resume_id
"""

_IN = r"(?i)(?:https?://)?(?:[a-zA-Z0-9_\-]+\.)?linkedin\.com/in/([a-zA-Z0-9_\-%]+)(?:/[a-zA-Z0-9_\-%]*)?"
_HTTPS = "CASE WHEN u IS NULL THEN NULL WHEN starts_with(u, 'http://') THEN 'https://' || substr(u, 8) WHEN starts_with(u, 'https://') THEN u ELSE 'https://' || u END"
_LINKEDIN = f"""
WITH c AS ({CORPUS}),
f AS (SELECT resume_id,
  CASE WHEN regexp_matches(url, '^{_IN}') AND length(regexp_extract(url, '^{_IN}', 1)) >= 2 AND lower(regexp_extract(url, '^{_IN}', 1)) NOT IN ({_quoted(LINKEDIN_RESERVED)}) THEN url END AS a,
  nullif(regexp_extract(clean_text, '(?i)linkedin(?:\\s+profile|\\s+url)?\\s*[:\\-–—]\\s*((?:https?://)?(?:[a-zA-Z0-9_\\-]+\\.)?linkedin\\.com/in/[a-zA-Z0-9_\\-%]{{2,}})', 1), '') AS b,
  list_filter(regexp_extract_all(clean_text, '{_IN}'), lambda m: length(regexp_extract(m, '{_IN}', 1)) >= 2 AND lower(regexp_extract(m, '{_IN}', 1)) NOT IN ({_quoted(LINKEDIN_RESERVED)}))[1] AS d FROM c),
g AS (SELECT resume_id, regexp_replace(trim(coalesce(a, b, d)), '[.,;:)>\\]\\s/]+$', '') AS u FROM f)
SELECT resume_id, {_HTTPS} AS linkedin FROM g
"""
_GH = r"(?i)(?:https?://)?(?:www\.)?github\.com/([a-zA-Z0-9][a-zA-Z0-9_\-]{0,38})"
_OK = f"length(s) >= 2 AND lower(s) NOT IN ({_quoted(GITHUB_RESERVED)})"
_GITHUB = f"""
WITH c AS ({CORPUS}),
l AS (SELECT resume_id, unnest(string_split(clean_text, chr(10))) AS line, unnest(range(len(string_split(clean_text, chr(10))))) AS i FROM c),
p AS (SELECT resume_id, i, line, unnest(regexp_extract_all(line, '{_GH}(/[a-zA-Z0-9_\\-]+)?')) AS m, unnest(range(len(regexp_extract_all(line, '{_GH}(/[a-zA-Z0-9_\\-]+)?')))) AS j FROM l),
q AS (SELECT resume_id, i, j, regexp_extract(m, '{_GH}', 1) AS s FROM p WHERE NOT regexp_matches(m, '(?i)github\\.com/[a-zA-Z0-9_\\-]+/')),
one AS (SELECT resume_id, arg_min(s, i * 1000 + j) AS s FROM q WHERE {_OK} GROUP BY resume_id),
two AS (SELECT resume_id, arg_min(s, i) AS s FROM (SELECT resume_id, i, regexp_extract(line, '(?i)\\bgithub(?:\\s+profile|\\s+url)?\\s*[:\\-–—]\\s*(?:https?://)?(?:www\\.)?github\\.com/([a-zA-Z0-9_\\-]+)', 1) AS s FROM l) WHERE {_OK} GROUP BY resume_id),
zero AS (SELECT resume_id, s FROM (SELECT resume_id, url, regexp_extract(url, '^{_GH}', 1) AS s FROM c) WHERE {_OK} AND NOT contains(ltrim(regexp_replace(url, '^{_GH}', ''), '/'), '/'))
SELECT c.resume_id, 'https://github.com/' || coalesce(zero.s, one.s, two.s) AS github FROM c LEFT JOIN zero USING (resume_id) LEFT JOIN one USING (resume_id) LEFT JOIN two USING (resume_id)
"""

_DICT = SkillDictionary.default()
_SKILL_DIM = ", ".join(f"('{c}', '{s}', '{_DICT.lookup()[s.lower()]}')" for c, v in _DICT.categories.items() for s in v)
_SKILL_LOOK = ", ".join(f"('{k}', '{v}')" for k, v in _DICT.lookup().items())

#: Skills of single words, pairs and triples of words, of the skills section or else the whole text.
_SKILL_WORDS = f"""
WITH s AS (SELECT resume_id, max(CASE WHEN section = 'skills' THEN nullif(body, '') END) AS body FROM ({BODIES}) GROUP BY resume_id),
c AS ({RESUMES}),
src AS (SELECT c.resume_id, coalesce(s.body, c.t) AS t FROM c LEFT JOIN s USING (resume_id)),
w AS (SELECT resume_id, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(t, '(?m)^\\s*[A-Za-z &/()]+:\\s*', ' ', 'g'), '[,|•\\-–—►▪✓*]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS ws FROM src),
tok AS (SELECT resume_id, ws, unnest(range(len(ws))) AS i FROM w),
grams AS (SELECT resume_id, i * 100 AS pos, ws[i + 1] AS gram FROM tok
          UNION ALL SELECT resume_id, i * 100 + 50, ws[i + 1] || ' ' || ws[i + 2] FROM tok WHERE i + 2 <= len(ws)
          UNION ALL SELECT resume_id, i * 100 + 25, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] FROM tok WHERE i + 3 <= len(ws)),
look(spelling, skill) AS (VALUES {_SKILL_LOOK})
SELECT resume_id, CAST(min(pos) AS INTEGER) AS pos, skill FROM grams JOIN look ON gram = spelling GROUP BY resume_id, skill
"""

_MON = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"

#: Employment by brute force: every month that a row covers, then islands of months.
_POINT = rf"(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}\b|\d{{4}}[-/.](?:0?[1-9]|1[0-2])\b|(?:0?[1-9]|1[0-2])[-/.]\d{{4}}\b|(?:\d{{1,2}} )?(?:{_MON})[a-z]*\.?[ -]*(?:\d{{4}}|''\d{{2}})\b|\d{{4}}\b)"
_UP = r" ?(?:-|–|—|/|\bto\b|\btill\b|\buntil\b) ?"
_OPEN = r"(?:till date|present|current|ongoing|now|today)"
_RANGE = rf"(?:\b(?:since|from|until) )?(?:{_POINT}|(?:{_MON})[a-z]*\.?)(?:(?:{_UP})+(?:{_POINT}|{_OPEN}|\d{{2}}\b|$))?"


def _year(c: str) -> str:
    return f"coalesce(nullif(regexp_extract({c}, '(\\d{{4}})', 1), '')::INT, (SELECT CASE WHEN y <= 25 THEN y + 2000 ELSE y + 1900 END FROM (SELECT nullif(regexp_extract({c}, '''(\\d{{2}})', 1), '')::INT AS y)))"


def _month(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '[a-z]') THEN (strpos('janfebmaraprmayjunjulaugsepoctnovdec', regexp_extract({c}, '({_MON})', 1)) + 2) // 3 "
        f"ELSE coalesce(nullif(regexp_extract({c}, '^\\d{{4}}[-/.](\\d{{1,2}})', 1), ''), nullif(regexp_extract({c}, '^(\\d{{1,2}})[-/.]\\d{{4}}', 1), ''))::INT END"
    )


_PERIODS = f"""
WITH src AS (SELECT resume_id, trim(regexp_replace(replace(lower(dates), '’', ''''), '\\([0-9]+ (?:yr|mos)[^)]*\\)', '', 'g'), ' ()') AS d FROM experience
             WHERE resume_id IS NOT NULL AND dates IS NOT NULL AND regexp_replace(lower(company), '[^\\p{{L}}\\p{{N}}]', '', 'g') NOT IN ('', {_quoted(PLACEHOLDERS)})),
cells AS (SELECT resume_id, unnest(regexp_extract_all(d, '{_RANGE}')) AS r FROM src),
cut AS (SELECT resume_id, r, regexp_replace(r, '^(?:since|from) ', '') AS b, starts_with(r, 'since ') AS since FROM cells WHERE NOT starts_with(r, 'until ') AND regexp_matches(r, '\\d')),
ends AS (SELECT resume_id, b, since, regexp_extract(b, '^({_POINT}|(?:{_MON})[a-z]*\\.?)', 1) AS p FROM cut),
rest AS (SELECT *, substr(b, length(p) + 1) AS q FROM ends),
last AS (SELECT *, regexp_extract(q, '^(?:{_UP})+({_POINT})$', 1) AS e, regexp_extract(q, '^(?:{_UP})+(\\d{{2}})$', 1) AS yy,
                since OR regexp_matches(q, '^(?:{_UP})+(?:{_OPEN})?$') AS open FROM rest),
num AS (SELECT resume_id, open, {_year('p')} AS y1, {_month('p')} AS m1, CASE WHEN e <> '' THEN {_year('e')} WHEN yy <> '' THEN CASE WHEN yy::INT <= 25 THEN yy::INT + 2000 ELSE yy::INT + 1900 END END AS y2,
               CASE WHEN e <> '' THEN {_month('e')} END AS m2 FROM last),
iv AS (SELECT resume_id, coalesce(y1, y2) * 12 + coalesce(m1, 1) - 1 AS a, CASE WHEN open THEN 2025 * 12 + 11 WHEN y2 IS NOT NULL THEN y2 * 12 + coalesce(m2, 12) - 1 ELSE y1 * 12 + coalesce(m1, 12) - 1 END AS z FROM num),
months AS (SELECT DISTINCT resume_id, unnest(range(a, z + 1)) AS m FROM iv WHERE a <= z),
isl AS (SELECT resume_id, m, m - row_number() OVER (PARTITION BY resume_id ORDER BY m) AS g FROM months),
per AS (SELECT resume_id, min(m) AS a, max(m) AS z FROM isl GROUP BY resume_id, g),
nxt AS (SELECT *, lead(a) OVER (PARTITION BY resume_id ORDER BY a) AS n FROM per),
u AS (SELECT resume_id, 'period' AS kind, a, z FROM nxt UNION ALL SELECT resume_id, 'gap', z + 1, n - 1 FROM nxt WHERE n IS NOT NULL)
SELECT resume_id, kind, CAST(a // 12 * 100 + a % 12 + 1 AS INTEGER) AS from_month, CAST(z // 12 * 100 + z % 12 + 1 AS INTEGER) AS to_month FROM u
"""

SQL: dict[str, str] = {
    "p3_found": _PERIODS,
    "clean_text_resumes": f"SELECT resume_id, t AS clean_text FROM ({RESUMES})",
    "clean_text_docs": f"SELECT doc_id, t AS clean_text FROM ({DOCS})",
    "line_stats": f"""
        WITH x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM ({DOCS}) WHERE t IS NOT NULL)
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (line <> '') AS INTEGER) AS n_filled, CAST(max(length(line)) AS INTEGER) AS longest FROM x GROUP BY doc_id""",
    "heading_lines": f"WITH {HEADINGS} SELECT resume_id, CAST(i AS INTEGER) AS line_no, section FROM h WHERE section IS NOT NULL",
    "section_bodies": BODIES,
    "section_counts": f"SELECT section, count(*) AS n_docs, CAST(sum(CASE WHEN body = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty FROM ({BODIES}) GROUP BY section",
    "email_first": _email(RESUMES, "resume_id"),
    "email_first_docs": _email(DOCS, "doc_id"),
    "phone_first": _PHONES,
    "name_first": _NAMES,
    "contact_info": f"SELECT n.resume_id, n.name, e.email, p.phone FROM ({_NAMES}) n JOIN ({_email(RESUMES, 'resume_id')}) e USING (resume_id) JOIN ({_PHONES}) p USING (resume_id)",
    "linkedin_url": _LINKEDIN,
    "github_profile": _GITHUB,
    "profile_links": f"SELECT a.resume_id, a.linkedin, b.github FROM ({_LINKEDIN}) a JOIN ({_GITHUB}) b USING (resume_id)",
    "skill_dictionary": f"SELECT * FROM (VALUES {_SKILL_DIM}) t(category, canonical, resolved)",
    "skill_words": _SKILL_WORDS,
    "file_size_labels": """
        WITH n AS (SELECT resume_id, unnest([1, 700, 90000]) * CAST(strlen(coalesce(raw_text, '')) AS BIGINT) AS n_bytes FROM resumes)
        SELECT resume_id, n_bytes, CASE WHEN n_bytes < 1024 THEN n_bytes || ' B' WHEN n_bytes < 1048576 THEN printf('%.1f KB', n_bytes / 1024) ELSE printf('%.2f MB', n_bytes / 1048576) END AS label FROM n""",
    "format_routes": """
        WITH e AS (SELECT resume_id, lower(nullif(regexp_extract(path, '\\.([^./\\\\]+)$', 1), '')) AS ext FROM resumes)
        SELECT resume_id, ext, CASE WHEN ext IS NULL THEN 'Could not determine the file format' WHEN ext NOT IN ('pdf', 'docx') THEN 'Unsupported file format ''.' || ext || '''' END AS error FROM e""",
    "reserved_slug_anti": f"""
        WITH c AS ({CORPUS}), s AS (SELECT regexp_replace(unnest(regexp_extract_all(clean_text, '(?i)github\\.com/[a-z0-9_-]+')), '(?i)github\\.com/', '') AS slug FROM c)
        SELECT slug, count(*) AS n FROM s WHERE slug NOT IN ({_quoted(GITHUB_RESERVED)}) GROUP BY slug""",
}

# ---- grades ------------------------------------------------------------------------------------------

_SMALL = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety hundred".split()
_SAID = ", ".join(f"('{w}', {n})" for w, n in [*((w, k + 1) for k, w in enumerate(_SMALL)), *((w, 10 * k + 20) for k, w in enumerate(_TENS)), *((f"{t}-{u}", 10 * k + 21 + j) for k, t in enumerate(_TENS[:-1]) for j, u in enumerate(_SMALL[:9]))])
_N = r"\d+(?:[.,]\d+)*"
_L = r"(?: ?(?:cgpa|gpa|grade|score|points?|marks?))?"
_W = "(?:" + "|".join([*_SMALL, *_TENS]) + ")"


def _readings(c: str) -> str:
    """The readings of a number: grouped thousands first, if it may be one, then decimal."""
    return f"CASE WHEN regexp_matches({c}, '^\\d{{1,3}}(,\\d{{3}})+$') THEN [replace({c}, ',', '')::DECIMAL(18,6), replace({c}, ',', '.')::DECIMAL(18,6)] ELSE [replace({c}, ',', '.')::DECIMAL(18,6)] END"


#: All in millionths, as whole numbers, so that halves are exact.
SQL["p4_found"] = f"""
WITH said(word, n) AS (VALUES {_SAID}),
e AS (SELECT edu_id, agency_id, lower(trim(regexp_replace(grade, '\\s+', ' ', 'g'))) AS t FROM education WHERE grade IS NOT NULL),
w AS (SELECT *, regexp_extract(t, '({_N})', 1) AS num, regexp_extract(t, '^([a-z]+(?:-[a-z]+)?) (?:per ?cent|pct)', 1) AS word FROM e),
p AS (SELECT w.*, CASE WHEN num <> '' THEN num ELSE said.n::VARCHAR END AS v0, CASE WHEN num <> '' THEN substr(t, 1, strpos(t, num) - 1) ELSE '' END AS bef,
             CASE WHEN num <> '' THEN substr(t, strpos(t, num) + length(num)) ELSE substr(t, length(w.word) + 1) END AS aft FROM w LEFT JOIN said ON num = '' AND said.word = w.word),
s AS (SELECT *, regexp_extract(aft, '^{_L} ?[(\\[]?({_N}) ?=? ?best', 1) AS hi, regexp_extract(aft, 'best ?,? ?({_N}) ?=? ?worst', 1) AS lo,
        coalesce(nullif(regexp_extract(aft, '^{_L} ?(?:/|out of|of) ?({_N}|{_W})', 1), ''), nullif(regexp_extract(aft, '^{_L} ?\\(?({_N}) ?(?:point )?scale', 1), ''), nullif(regexp_extract(aft, '^{_L} ?on a scale of ({_N}|{_W})', 1), '')) AS top,
        upper(regexp_extract(aft, '^(?: ?\\[|, ?scale )([a-z]\\d+)', 1)) AS code,
        regexp_matches(aft, '^ ?(?:%|per ?cent|pct)') OR contains(bef, 'percent') AS pct FROM p WHERE v0 IS NOT NULL),
k AS (SELECT s.*, CASE WHEN hi <> '' AND lo <> '' THEN hi WHEN top IS NOT NULL THEN coalesce(said.n::VARCHAR, top) WHEN code <> '' THEN g1.best::VARCHAR WHEN pct THEN '100' ELSE g2.best::VARCHAR END AS b0,
        CASE WHEN hi <> '' AND lo <> '' THEN lo::DECIMAL(18,6) WHEN top IS NOT NULL THEN 0 WHEN code <> '' THEN g1.worst WHEN pct THEN 0 ELSE g2.worst END AS w0
      FROM s LEFT JOIN said ON said.word = s.top LEFT JOIN grading_scales g1 ON g1.scale_code = s.code
      LEFT JOIN agencies a ON a.agency_id = s.agency_id LEFT JOIN grading_scales g2 ON g2.scale_code = a.default_scale),
r AS (SELECT edu_id, w0, unnest({_readings('v0')}) AS v, {_readings('b0')} AS bs FROM k WHERE b0 IS NOT NULL),
r2 AS (SELECT edu_id, v, w0, unnest(bs) AS b FROM r),
o AS (SELECT edu_id, CAST(v * 1000000 AS HUGEINT) AS v, CAST(b * 1000000 AS HUGEINT) AS b, CAST(w0 * 1000000 AS HUGEINT) AS w, row_number() OVER (PARTITION BY edu_id ORDER BY round(abs(ln(v / greatest(b, w0) / 0.75)), 5), v DESC) AS best FROM r2 WHERE v > 0)
SELECT edu_id, CAST((20000 * abs(v - w) + abs(b - w)) // (2 * abs(b - w)) AS INTEGER) AS grade_bp FROM o WHERE best = 1 AND v BETWEEN least(b, w) AND greatest(b, w) AND b <> w
"""
