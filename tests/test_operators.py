"""Shredding, intervals and units against brute force on small tables with nulls, ties, repeated and clashing rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cvloom.operators import intervals, shred, units
from cvloom.tables import spread, use_checkpoints

PAYLOADS = [
    '{"education": [{"degree": "A", "grade": " "}, {}, null, {"dates": null}, {"location": "L"}], "experience": [{"jobTitle": "T", "company": "C", "description": ["x", "", null, ["y"], {"text": "z", "sub": ["w"]}]}]}',
    '{"data": {"candidate": {"education": {"1": {"degree": "A"}, "2": {"degree": "B"}}, "experience": "[{\\"job_title\\": \\"T\\", \\"description\\": \\"a\\\\n\\\\n b\\"}]"}}}',
    '[{"contact": {}, "sections": {"education": {"degree": "only"}, "experience": [{"company": "Firm", "location": "P", "roles": [{"job_title": "one"}, {"dates": "2001", "description": {"items": ["i", "j"]}}, {}]}]}}]',
    '{"education": [], "experience": null}',
    '{"education": [{"degree": "cut"',
    "",
    None,
    "null",
    '{"education": [{"degree": NaN}]}',
]
EXPECTED = {
    0: [("education", 1, 0), ("education", 2, 0), ("experience", 1, 0), ("experience", 1, 1), ("experience", 1, 2), ("experience", 1, 3), ("experience", 1, 4)],
    1: [("education", 1, 0), ("education", 2, 0), ("experience", 1, 0), ("experience", 1, 1), ("experience", 1, 2)],
    2: [("education", 1, 0), ("experience", 1, 0), ("experience", 2, 0), ("experience", 2, 1), ("experience", 2, 2)],
}


def test_shredding(spark):
    df = spark.createDataFrame([(k, None if k else 5, p, "clash") for k, p in enumerate(PAYLOADS)], "record_id bigint, resume_id bigint, payload string, field string")
    flat = shred.shred_records(df)
    got = {}
    for r in shred.found(flat).collect():
        got.setdefault(r.record_id, []).append((r.field, r.entry_no, r.line_no))
    assert {k: sorted(v) for k, v in got.items()} == EXPECTED
    assert [r.text for r in shred.line_table(flat).where("record_id = 0").orderBy("line_no").collect()] == ["x", "y", "z", "w"]
    roles = shred.entry_table(flat, "experience").where("record_id = 2").orderBy("entry_no").collect()
    assert [(r.job_title, r.company, r.location) for r in roles] == [("one", "Firm", "P"), (None, "Firm", "P")]
    assert sorted(r.record_id for r in shred.error_table(flat).collect()) == [4, 5, 8]
    assert shred.shred_records(df.limit(0)).count() == 0


def test_any_depth():
    """Thousands of levels, above the two lists and inside a description, and a broken end that far down."""
    n = 5_000
    inner = '{"education": [{"degree": "A", "subject": "S"}], "experience": [{"title": "T", "position": "second", "description": ' + "[" * n + '"x"' + "]" * n + "}]}"
    deep = '{"data": ' * n + inner + "}" * n
    got = shred.rebuild([deep, inner, deep[:-1], '["' + "[" * n + '"]'])
    assert [(r.row, r.field, r.entry_no, r.line_no) for r in got.sort_values(["row", "field", "line_no"]).itertuples()] == [
        (k, f, 1, j) for k in (0, 1) for f, j in (("education", 0), ("experience", 0), ("experience", 1))
    ] + [(2, "error", 0, 0)]
    assert set(got["other"].dropna()) == {"S", "second"}


def test_deep_parser_is_the_parser():
    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice("abc\"\\é"): value(depth - 1) for _ in range(rng.randrange(4))}
        return [None, True, rng.randrange(-9, 9), rng.random() * 1e9, rng.choice(["", "x\n", "é\u2028", '"'])][kind]

    for _ in range(300):
        v = value(5)
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert shred.parse_deep(text) == v
        broken = text[: rng.randrange(len(text))] + rng.choice(["", ",", "]", "x"]) + text[rng.randrange(len(text)) :]
        try:
            want = json.loads(broken, parse_constant=shred._reject)
        except ValueError:
            with pytest.raises(ValueError):
                shred.parse_deep(broken)
        else:
            assert shred.parse_deep(broken) == want


def test_levels_rebuild_any_record():
    """Random records: the rows from the level sequences are those of walking the records."""
    rng = random.Random(4)

    def entry():
        return {k: rng.choice([None, "", " ", "v", 3]) for k in rng.sample(["job_title", "company", "dates", "location", "extra"], rng.randint(0, 5))} | ({"description": [rng.choice(["a", "", None, "b\nc"]) for _ in range(rng.randint(0, 3))]} if rng.random() < 0.7 else {})

    records = [{"education": [], "experience": [entry() for _ in range(rng.randint(0, 4))]} for _ in range(200)]
    got = shred.rebuild([json.dumps(r) for r in records])
    want = []
    for k, r in enumerate(records):
        n = 0
        for e in r["experience"]:
            lines = [p for s in e.get("description", []) if s for p in s.split("\n") if p.strip()]
            if lines or any(str(v).strip() for c, v in e.items() if c != "description" and v is not None):
                n += 1
                want += [(k, n, j) for j in range(len(lines) + 1)]
    assert sorted(map(tuple, got[["row", "entry_no", "line_no"]].itertuples(index=False))) == sorted(want)


def ym(*pairs):
    return [(a // 100 * 12 + a % 100 - 1, b // 100 * 12 + b % 100 - 1) for a, b in pairs]


CELLS = {
    "Jan 2003 - Aug 2004": ym((200301, 200408)),
    "2015–16": ym((201501, 201612)),
    "2004-05 - 2006-07": ym((200405, 200607)),
    "Since Mar. '17": ym((201703, 202512)),
    "until Mar 2017": [],
    "Present": [],
    "May to Aug 2007": ym((200705, 200708)),
    "(Feb 2014 - May 2014)": ym((201402, 201405)),
    "Mar 2005 - May 2006 (1 yr 3 mos)": ym((200503, 200605)),
    "01/2013 - 02/2013, 07/2013 - 09/2013": ym((201301, 201302), (201307, 201309)),
    "Jul 2002 - Sep 2002 and Sep 2005 - Oct 2005": ym((200207, 200209), (200509, 200510)),
    "Jan 2015 –": ym((201501, 202512)),
    "15 April 2004 – 12 Jul 2005": ym((200404, 200507)),
    "1999-06-05 / 2000-08-01": ym((199906, 200008)),
    "From 05/2003 till 02/2004": ym((200305, 200402)),
    "Sept. 2002": ym((200209, 200209)),
    "in 1997": ym((199701, 199712)),
    "2014 - 2011": [],
    "13/2014": ym((201401, 201412)),
    "May '98 - till date": ym((199805, 202512)),
    "two years": [],
    " ": [],
    "": [],
}


def test_date_cells():
    assert {c: [(r["a"], r["b"]) for r in intervals.parse_ranges(c)] for c in CELLS} == CELLS
    assert intervals.parse_ranges(None) == []


def test_merge_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 3, 3, 3, None]), a, a + rng.randint(-2, 40) if rng.random() < 0.9 else a + 300) for a in (rng.randint(-200, 900) for _ in range(300))] + [(4, 59, 60), (4, 61, 61), (5, None, 3), (4, 59, 60)]
    df = spark.createDataFrame(rows, "k bigint, a bigint, b bigint")
    got = {tuple(r) for r in intervals.with_gaps(intervals.merge_intervals(df, "k", "a", "b"), "k").collect()}
    for shard in (1, 62, 63, 500):
        assert {tuple(r) for r in intervals.with_gaps(intervals.merge_intervals(df, "k", "a", "b", shard), "k").collect()} == got
    want = set()
    for k in {r[0] for r in rows if r[0]}:
        units_ = sorted({u for x, a, b in rows if x == k and a is not None for u in range(a, b + 1)})
        runs = []
        for u in units_:
            if runs and runs[-1][1] == u - 1:
                runs[-1][1] = u
            else:
                runs.append([u, u])
        want |= {(k, "period", a, b) for a, b in runs} | {(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])}
    assert got == want
    assert intervals.merge_intervals(df.limit(0), "k", "a", "b").count() == 0


def test_employment(spark):
    rows = [(1, "Acme", "2001 - 2002"), (1, "Beta", "Jan 2003 - Mar 2003"), (1, "n/a", "1990"), (1, " ", "1991"), (None, "Acme", "1992"), (1, "Acme", "May 2005"), (2, "Acme", None), (1, "Acme", "May 2005")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "resume_id bigint, company string, dates string, kind string")
    assert sorted(map(tuple, intervals.employment_periods(df).collect())) == [(1, "gap", 200304, 200504), (1, "period", 200101, 200303), (1, "period", 200505, 200505)]


GRADES = {
    "8.08/10": 8080, "CGPA: 7.41": 7410, "2,4 [N15]": 6500, "Note 1,7 (1 = best, 6 = worst)": 8600, "1,030/1,200": 8583, "988/1,400": 7057, "743/700": None, "Sixty-five percent": 6500,
    "7.78/10, earlier 60%": 7780, "8.05/10 (76.5%)": 8050, "6.9 on a scale of ten": 6900, "2.62 (4.3 point scale)": 6093, "Percentage: 60.3": 6030, "80,85 per cent": 8085, "First Class": None, "": None,
    "119%": None, "Grade 2.8, scale N16": 6400, "3.52 out of four": 8800, "2.76505/4": 6913, "Moyenne 11": None,
}


def test_grades(spark):
    agencies = spark.createDataFrame([(1, "G10"), (2, None)], "agency_id bigint, default_scale string")
    scales = spark.createDataFrame([("G10", 10.0, 0.0), ("N15", 1.0, 5.0), ("N16", 1.0, 6.0)], "scale_code string, best double, worst double")
    rows = [(k, g, 1) for k, g in enumerate(GRADES)] + [(100, "7.5", None), (101, "7.5", 2), (102, "7.5", 9), (103, None, 1), (104, "8/10", None), (104, "8/10", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "edu_id bigint, grade string, agency_id bigint, best string")
    got = {r.edu_id: r.grade_bp for r in units.grade_shares(df, agencies, scales).collect()}
    assert {g: got[k] for k, g in enumerate(GRADES)} == GRADES
    assert [got[k] for k in (100, 101, 102, 103, 104)] == [None, None, None, None, 8000]
    assert units.usable_grades(df, agencies, scales).where("edu_id = 104").count() == 2
    assert units.usable_grades(df.limit(0), agencies, scales).count() == 0


def test_units_of_mass(spark):
    """mass = density * volume, each in one of two units; and a case where two choices fit alike."""
    rows = [(1, 2.0, 1.0, 2000.0), (2, 2000.0, 1.0, 2000.0), (3, 2000.0, 1000.0, 2000.0), (4, None, 1.0, 1.0), (5, -1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, mass double, density double, volume double")
    out = units.resolve_units(df, {"mass": {"kg": 1.0, "g": 1e-3}, "density": {"kg/m3": 1.0, "g/cm3": 1e3}, "volume": {"m3": 1.0, "cm3": 1e-6}}, {"mass": 1, "density": -1, "volume": -1})
    got = {r.id: r.solution for r in out.collect()}
    assert (got[1].unit_mass, got[1].unit_density, got[1].unit_volume, got[1].residual) == ("kg", "g/cm3", "cm3", 0.0)
    assert got[2].residual == 0.0 and not got[2].unique
    assert got[4] is None and got[5] is None


def test_checkpoints_need_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        use_checkpoints(session)


def test_spread_leaves_wide_scans(spark):
    assert spread(spark.range(10).repartition(8)).rdd.getNumPartitions() == 8
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1), least=0).rdd.getNumPartitions() == 1
    assert spread(spark.range(10).coalesce(1)).agg(F.sum("id")).first()[0] == 45
