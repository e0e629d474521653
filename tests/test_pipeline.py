"""Golden rows of the extraction rules, among them their surprising cases."""

import json

import pytest
from pyspark.sql import functions as F

from cvloom.functions.contact import email, name, phone
from cvloom.functions.profiles import github, linkedin
from cvloom.functions.sections import with_sections
from cvloom.functions.skills import SkillDictionary, with_skills
from cvloom.functions.text import clean_text
from cvloom.operators.entries import education_records, experience_records
from cvloom.plans.pipeline import RECORD, file_size_label, record_json, resume_records

COMPLETE = """John Doe
Email: john.doe@example.com
Phone: +91 9876543210
LinkedIn: https://www.linkedin.com/in/johndoe
GitHub: https://github.com/johndoe

SKILLS
Python, Java, Docker, SQL, Git

EDUCATION
B.Tech in Computer Engineering
ABC University
2020 - 2024
CGPA: 8.9

EXPERIENCE
Software Engineer Intern
XYZ Technologies
Mumbai
June 2024 - August 2024
- Developed REST APIs using Python and FastAPI
- Optimized SQL database queries
"""


def column(spark, values, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r.x for r in df.select("k", fn(F.col("t")).alias("x")).orderBy("k").collect()]


def test_clean_text(spark):
    cases = {
        "p1\f\np2": "p1\np2",
        "a\r\nb\rc": "a\nb\nc",
        "  a \t b  \n\n\n\n c ": "a b\n\nc",
        "a\u00a0b\u3000c\u200bd": "a b c d",
        "x\x00y\x7fz": "xyz",
        "e\u0301": "\u00e9",
        " \n\t ": "",
        "": "",
        None: None,
        "a\u2028b": "a\nb",
    }
    assert column(spark, list(cases), clean_text) == list(cases.values())


def test_sections(spark):
    texts = ["SKILLS\n\nEDUCATION", "LICENSES AND CERTIFICATIONS\nx", "intro\nSkills:\na\nb\nEducation —\nc\nTECHNICAL SKILLS\nd", "no headings", "", None]
    df = with_sections(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, clean_text string"))
    got = [[(s.section, s.body) for s in r.sections] for r in df.orderBy("k").collect()]
    assert got == [[("skills", ""), ("education", "")], [], [("skills", "a\nb\n\nd"), ("education", "c")], [], [], []]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (email, {"mail John.Doe@Example.COM.": "john.doe@example.com", "_john@x.com": None, "a@b.co and c@d.org": "a@b.co", "none": None, "": None}),
        (phone, {"2020 - 2024": "2020 - 2024", "12345678%": None, "Phone: +91 98765 43210": "+91 98765 43210", "(022) 2345-6789": "(022) 2345-6789", "123": None, "9876543210\n2020": "9876543210\n2020"}),
        (name, {"O'BRIEN-SMITH JANE": "O'brien-Smith Jane", "Telma Hopkins": None, "RESUME\nmary-jane o'neil": "Mary-Jane O'Neil", "Software Engineer\nAda": None, "a@b.c x": None}),
    ],
)
def test_contact(spark, fn, cases):
    assert column(spark, list(cases), fn) == list(cases.values())


def test_profiles(spark):
    none = F.array().cast("array<string>")
    cases = {
        "GitHub: https://github.com/company/app": "https://github.com/company",
        "github.com/john-doe/repo": None,
        "www.github.com/john-doe": "https://github.com/john-doe",
        "github.com/pricing github.com/ab": "https://github.com/ab",
        "github.com/a": None,
    }
    assert column(spark, list(cases), lambda t: github(t, none)) == list(cases.values())
    assert column(spark, ["x"], lambda t: github(t, F.array(F.lit("https://github.com/u1/repo")))) == ["https://github.com/u1"]
    assert column(spark, ["x"], lambda t: github(t, F.array(F.lit("https://github.com/u1/repo/tree/x")))) == [None]
    links = {"see linkedin.com/in/ab, LinkedIn: http://www.linkedin.com/in/cd": "https://www.linkedin.com/in/cd", "linkedin.com/in/in linkedin.com/in/xy.": "https://linkedin.com/in/xy", "": None}
    assert column(spark, list(links), lambda t: linkedin(t, none)) == list(links.values())


def test_skills(spark):
    cases = {
        "React.js, SQL Server": ["React", "SQL", "SQL Server"],
        "I go home": ["Go"],
        "Power | BI": ["Power BI"],
        "Languages: C++, k8s": ["C++", "Kubernetes"],
        "C plus plus": ["C", "C++"],
        "(JS)": [],
        " ": [],
    }
    df = with_skills(spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string"), "t")
    assert [r.skills for r in df.orderBy("k").collect()] == list(cases.values())


def test_own_dictionary(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"_note": "x", "a": ["Baking", "Knots"], "b": 3, "aliases": {"_c": "y", "bread": "Baking"}}))
    d = SkillDictionary.read(str(p))
    df = with_skills(spark.createDataFrame([("bread and knots, Python",)], "t string"), "t", dictionary=d)
    assert df.first().skills == ["Baking", "Knots"]
    with pytest.raises(FileNotFoundError):
        SkillDictionary.read(str(tmp_path / "none.json"))


def entries(spark, fn, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k0 int, t string")
    got = {}
    for r in fn(df, "k0", "t").orderBy("k0", "entry_no").collect():
        got.setdefault(r.k0, []).append(r.asDict())
    return [got.get(k, []) for k in range(len(texts))]


def test_education(spark):
    texts = [
        "Diploma in Arts\nX College\n2010\nCGPA: 8",
        "B.Tech | Computer Engineering | ABC University | 2023-2027",
        "B.Tech, CSE\nABC University\n2020 - 2024",
        "MCA\nOld College\n2001\n90%\nB.Sc in Physics\nNew University\n1998 - 2001\nMCA\nOld College",
        "no degree here\nat all\nin these\nlines",
        None,
    ]
    got = entries(spark, education_records, texts)
    assert (got[0][0]["degree"], got[0][0]["institution"], got[0][0]["dates"], got[0][0]["grade"]) == ("Diploma in Arts in Arts", "X College", "2010", "CGPA: 8")
    assert (got[1][0]["institution"], got[1][0]["dates"], got[1][0]["field_of_study"]) == ("Computer Engineering", "2023", None)
    assert [(r["degree"], r["institution"]) for r in got[2]] == [("B.Tech", "CSE")]
    assert [(r["degree"], r["institution"], r["dates"], r["grade"]) for r in got[3]] == [("MCA", "Old College", "2001", "90%"), ("B.Sc in Physics", "New University", "1998 - 2001", None)]
    assert got[4] == got[5] == []
    assert all(r["location"] is None for x in got for r in x)


def test_experience(spark):
    texts = [
        "Engineer Lead\nFoo Labs, Pune\n2020 - 2021",
        "Backend Developer | XYZ Ltd | Jan 2023 - Dec 2023\n- one\n- two",
        "Data Analyst — Acme Corp",
        "Web Developer\nAcme Inc\n2019 - 2020\nQA Engineer\nBeta Ltd\n2020 - 2021\n\n• only a bullet",
        "Acme Corp\nJan 2020 - Present",
        "",
    ]
    got = entries(spark, experience_records, texts)
    assert [(r["location"], r["company"], r["dates"]) for r in got[0]] == [("Foo Labs, Pune", None, "2020 - 2021")]
    assert [(r["job_title"], r["company"], r["description"]) for r in got[1]] == [("Backend Developer | XYZ Ltd", None, ["one", "two"])]
    assert [(r["job_title"], r["company"]) for r in got[2]] == [("Data Analyst", "Acme Corp")]
    assert [(r["job_title"], r["company"], r["dates"]) for r in got[3]] == [("Web Developer", "Acme Inc", "2019 - 2020"), ("QA Engineer", "Beta Ltd", "2020 - 2021")]
    assert [(r["job_title"], r["company"], r["dates"]) for r in got[4]] == [(None, "Acme Corp", "Jan 2020 - Present")]
    assert got[5] == []


def test_whole_record(spark):
    df = spark.createDataFrame([(1, COMPLETE, [], "clash"), (2, None, None, "clash"), (3, "", ["https://github.com/zz-top"], "clash")], "resume_id bigint, raw_text string, extra_urls array<string>, email string")
    rows = {r.resume_id: r for r in resume_records(df).collect()}
    r = rows[1]
    assert (r.name, r.email, r.phone) == ("John Doe", "john.doe@example.com", "+91 9876543210")
    assert (r.linkedin, r.github) == ("https://www.linkedin.com/in/johndoe", "https://github.com/johndoe")
    assert r.skills == ["Python", "Java", "Docker", "SQL", "Git"]
    assert [x.asDict() for x in r.education] == [{"degree": "B.Tech in Computer Engineering", "institution": "ABC University", "dates": "2020 - 2024", "field_of_study": "Computer Engineering", "grade": "CGPA: 8.9", "location": None}]
    assert [(x.job_title, x.company, x.dates, x.location, x.description) for x in r.experience] == [("Software Engineer Intern", "XYZ Technologies", "June 2024 - August 2024", None, ["Developed REST APIs using Python and FastAPI", "Optimized SQL database queries"])]
    assert (rows[2].error, rows[2].skills, rows[2].education, rows[2].experience, rows[2].name) == ("no text", [], [], [], None)
    assert (rows[3].error, rows[3].github) == (None, "https://github.com/zz-top")
    out = json.loads(resume_records(df).where("resume_id = 2").select(record_json().alias("j")).first().j)
    assert list(out) == RECORD and out["email"] is None and out["skills"] == []
    assert resume_records(df.limit(0)).count() == 0


def test_file_size(spark):
    df = spark.createDataFrame([(1023,), (1024,), (1536,), (3 * 1024 * 1024,)], "n bigint")
    assert [r[0] for r in df.select(file_size_label(F.col("n"))).collect()] == ["1023 B", "1.0 KB", "1.5 KB", "3.00 MB"]
