"""Columnar shredding of nested records (problem 1).

A record is taken apart into one column per leaf path. Every slot of a column carries a repetition level
(at which repeated ancestor a new item began) and a definition level (how much of the path is there), so
the flat table of any repeated ancestor can be rebuilt from the level sequences alone, without looking at
the nested value again. All records of an Arrow batch share the columns; rebuilding is vectorised.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from json.decoder import scanstring

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A field of the target schema: with children a repeated group, without children an optional text leaf."""

    name: str
    children: tuple["Node", ...] = ()
    repeated: bool = False  # the root is not, every other group is


@dataclass
class Column:
    """Slots of one leaf path over all records of a batch."""

    rep: list = field(default_factory=list)
    dfn: list = field(default_factory=list)
    value: list = field(default_factory=list)


ENTRY_LEAVES = ("job_title", "company", "dates", "location", "other")

#: record > education* > leaves;  record > employer* > role* > leaves, line*
SCHEMA = Node(
    "record",
    (
        Node("education", tuple(Node(x) for x in ("degree", "institution", "dates", "field_of_study", "grade", "location", "other")), True),
        Node(
            "employer",
            (Node("employer_name"), Node("employer_location"), Node("employer_other"), Node("role", (*(Node(x) for x in ENTRY_LEAVES), Node("line", (Node("text"),), True)), True)),
            True,
        ),
    ),
)


class Shredder:
    """Shreds records of one schema into leaf columns and rebuilds tables of repeated ancestors."""

    def __init__(self, schema: Node):
        self.schema = schema
        self.columns: dict[str, Column] = {}
        #: of each node: repetition level and definition level when it is there
        self.levels: dict[str, tuple[int, int]] = {}
        self._leaves: dict[str, list[str]] = {}
        self._plan(schema, "", 0, 0)
        self._write = self._writer(schema, "")

    def _plan(self, node: Node, prefix: str, rep: int, dfn: int) -> list[str]:
        path = f"{prefix}.{node.name}" if prefix else node.name
        if prefix:
            rep, dfn = rep + node.repeated, dfn + 1
        self.levels[path] = (rep, dfn)
        if not node.children:
            self.columns[path] = Column()
            self._leaves[path] = [path]
        else:
            self._leaves[path] = [x for c in node.children for x in self._plan(c, path, rep, dfn)]
        return self._leaves[path]

    def add(self, record: dict) -> None:
        """Append one record; missing parts leave one slot with a low definition level per leaf."""
        self._write(record, 0, 0)

    def _writer(self, node: Node, prefix: str):
        """The function that appends one value of an inner node, with all that is known of its columns bound."""
        path = f"{prefix}.{node.name}" if prefix else node.name
        leaves, repeated = [], []
        for c in node.children:
            below = f"{path}.{c.name}"
            if not c.children:
                col = self.columns[below]
                leaves.append((c.name, col.rep.append, col.dfn.append, col.value.append))
            else:
                ends = [(x.rep.append, x.dfn.append, x.value.append) for x in map(self.columns.__getitem__, self._leaves[below])]
                repeated.append((c.name, self._writer(c, path), ends, self.levels[below][0]))
        step = 1 if prefix else 0

        def write(value: dict, rep: int, dfn: int) -> None:
            here, get = dfn + step, value.get
            for name, put_rep, put_dfn, put in leaves:
                v = get(name)
                put_rep(rep)
                put_dfn(here if v is None else here + 1)
                put(v)
            for name, sub, ends, deeper in repeated:
                at = rep
                for item in get(name) or ():
                    sub(item, at, here)
                    at = deeper
                if not get(name):
                    for put_rep, put_dfn, put in ends:
                        put_rep(rep)
                        put_dfn(here)
                        put(None)

        return write

    def items(self, leaf: str, ancestor: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each slot of `leaf`: does an item of the repeated `ancestor` begin here, and is it there at all."""
        c, (rep, dfn) = self.columns[leaf], self.levels[ancestor]
        r, d = np.asarray(c.rep, dtype=np.int16), np.asarray(c.dfn, dtype=np.int16)
        there = d >= dfn
        return there & (r <= rep), there

    def owner(self, leaf: str, ancestor: str) -> np.ndarray:
        """Of each slot of `leaf`: the running number (from 0, over the batch) of its item of `ancestor`, or -1."""
        begins, there = self.items(leaf, ancestor)
        return np.where(there, np.cumsum(begins) - 1, -1)

    def record_of_items(self, leaf: str, ancestor: str) -> np.ndarray:
        """Of each item of `ancestor`, in order: the running number of its record."""
        r = np.asarray(self.columns[leaf].rep, dtype=np.int16)
        begins, _ = self.items(leaf, ancestor)
        return (np.cumsum(r == 0) - 1)[begins]

    def leaf_of_items(self, leaf: str, ancestor: str) -> np.ndarray:
        """Values of a leaf that is repeated no deeper than `ancestor`: one per item."""
        begins, _ = self.items(leaf, ancestor)
        return np.asarray(self.columns[leaf].value, dtype=object)[begins]


# ---- from the exporters' shapes to the schema -------------------------------------------------------

_KEYS = {
    "fieldofstudy": "field_of_study", "field": "field_of_study", "major": "field_of_study",
    "jobtitle": "job_title", "title": "job_title", "position": "job_title", "role": "job_title",
    "employer": "company", "organisation": "company", "organization": "company", "companyname": "company",
    "school": "institution", "university": "institution", "date": "dates", "period": "dates", "score": "grade",
    "descriptions": "description", "bullets": "description", "highlights": "description", "responsibilities": "description",
    "positions": "roles", "workexperience": "experience", "work": "experience", "employment": "experience", "educations": "education",
}
_EDUCATION = {"degree", "institution", "dates", "field_of_study", "grade", "location"}
_EXPERIENCE = {"job_title", "company", "dates", "location"}
_BREAK = re.compile(r"\r\n|[\n\r\v\f\x85\u2028\u2029]")


@lru_cache(maxsize=4096)
def _key(k: str) -> str:
    flat = re.sub(r"[\s_\-]", "", k).lower()
    return _KEYS.get(flat) or (re.sub(r"[\s\-]", "_", k).lower() if "_" in k or "-" in k or " " in k else flat)


def _reject(x: str):
    raise ValueError(x)


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def parse_deep(text: str):
    """JSON of any depth: one loop over the text with a stack of its own. Raises ValueError if it is not valid.

    Open containers lie on `stack`, with the key that waits for its value beside an object. It is slower than the library's
    parser, which stops at the depth of the interpreter's own stack, and only takes over there.
    """
    stack: list = []
    keys: list = []
    at, value, n = _BLANK.match(text, 0).end(), None, len(text)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            opened = {} if c == "{" else []
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                value, at = opened, at + 1
            else:
                stack.append(opened)
                keys.append(None)
                if c == "{":
                    keys[-1], at = _member(text, at)
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            value, at = json.loads(m[0]), m.end()
        while True:  # a value has ended: it goes into what holds it, which may end with it
            at = _BLANK.match(text, at).end()
            if not stack:
                if at != n:
                    raise ValueError(f"more text at {at}")
                return value
            holder = stack[-1]
            is_list = isinstance(holder, list)
            if is_list:
                holder.append(value)
            else:
                holder[keys[-1]] = value
            c = text[at : at + 1]
            if c == ",":
                at = _BLANK.match(text, at + 1).end()
                if not is_list:
                    keys[-1], at = _member(text, at)
                break
            if c != ("]" if is_list else "}"):
                raise ValueError(f"no end of a container at {at}")
            value, at = stack.pop(), at + 1
            keys.pop()


def _member(text: str, at: int) -> tuple[str, int]:
    """The key that begins at `at`, and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = _BLANK.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, _BLANK.match(text, at + 1).end()


def parse(text: str):
    """A JSON value of any depth. Raises ValueError if the text is not valid JSON."""
    try:
        return json.loads(text, parse_constant=_reject)
    except RecursionError:
        return parse_deep(text)


def _unquoted(value):
    """A list or object that was written as a string of JSON."""
    if isinstance(value, str):
        s = value.strip()
        if s[:1] in ("[", "{"):
            try:
                return parse(s)
            except ValueError:
                return value
    return value


def strings(value) -> Iterator[str]:
    """All texts below a value, in the order written, however deep they lie."""
    if isinstance(value, str):
        yield value
        return
    stack = [iter((value,))]
    while stack:
        for v in stack[-1]:
            if isinstance(v, str):
                yield v
            elif isinstance(v, (dict, list)):
                stack.append(iter(v.values() if isinstance(v, dict) else v))
                break
            elif v is not None and not isinstance(v, bool):
                yield str(v)
        else:
            stack.pop()


def _text(value) -> str | None:
    if value is None:
        return None
    if type(value) is str:
        return value if value and not value.isspace() else None
    got = " ".join(x for x in strings(value) if x and not x.isspace())
    return got or None


def _entries(value, known: set[str]) -> list:
    """The entries of a list field: a list, an object by running number, one bare entry, or any of these as a string, with
    lists in lists taken apart in order."""
    value = _unquoted(value)
    if isinstance(value, dict) and value and not ({_key(k) for k in value} & (known | {"description", "roles"})):
        value = list(value.values())
    out, todo = [], list(reversed(value)) if isinstance(value, list) else [value]
    while todo:
        v = _unquoted(todo.pop())
        if isinstance(v, list):
            todo.extend(reversed(v))
        else:
            out.append(v)
    return out


def _lines(value) -> list[dict]:
    if not value:
        return []
    return [{"text": p} for s in strings(_unquoted(value)) for p in _BREAK.split(s) if p and not p.isspace()]


def _fields(entry, known: set[str], bare: str) -> dict:
    if isinstance(entry, str):
        return {bare: _text(entry)}
    if not isinstance(entry, dict):
        return {}
    got: dict = {}
    rest = []
    for k, v in entry.items():
        name = _key(k)
        if name in known and got.get(name) is None:
            got[name] = _text(v)
        elif name not in ("description", "roles"):
            rest.append(v)
    got["other"] = _text(rest) if rest else None
    return got


def _role(entry) -> dict:
    got = _fields(entry, _EXPERIENCE, "job_title")
    if isinstance(entry, dict):
        got["line"] = [x for k, v in entry.items() if _key(k) == "description" for x in _lines(v)]
    return got


def _holders(value) -> Iterator[dict[str, list]]:
    """The objects that hold the two lists, below any wrapping objects and lists; of each, the values by key."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, dict):
            own: dict[str, list] = {}
            for k, x in v.items():
                own.setdefault(_key(k), []).append(x)
            if "education" in own or "experience" in own:
                yield own
            else:
                todo.extend(reversed(v.values()))


def canonical(payload: str | None) -> dict | None:
    """A payload as a record of SCHEMA; None if it is null. Raises ValueError if it is no valid JSON."""
    if payload is None:
        return None
    record: dict = {"education": [], "employer": []}
    for own in _holders(parse(payload)):
        for value in own.get("education", ()):
            record["education"] += [_fields(e, _EDUCATION, "degree") for e in _entries(value, _EDUCATION)]
        for e in (x for value in own.get("experience", ()) for x in _entries(value, _EXPERIENCE)):
            roles = next((v for k, v in e.items() if _key(k) == "roles"), None) if isinstance(e, dict) else None
            if roles is None:
                record["employer"].append({"role": [_role(e)]})
            else:
                firm = _fields(e, _EXPERIENCE, "company")
                rest = [firm[x] for x in ("job_title", "dates", "other") if firm.get(x)]
                record["employer"].append(
                    {"employer_name": firm.get("company"), "employer_location": firm.get("location"), "employer_other": " ".join(rest) or None, "role": [_role(r) for r in _entries(roles, _EXPERIENCE)]}
                )
    return record


# ---- the flat tables --------------------------------------------------------------------------------

FLAT = (
    "record_id bigint, resume_id bigint, field string, entry_no int, line_no int, degree string, institution string, "
    "field_of_study string, grade string, job_title string, company string, dates string, location string, other string, employer_other string, text string"
)


_NUMBERS = ("record_id", "resume_id", "entry_no", "line_no")


def _number(group: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Numbers from 1 within runs of `group` (ascending), counting only what is kept."""
    total = np.cumsum(keep)
    first = np.searchsorted(group, group, side="left")
    before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
    return total - before


def rebuild(payloads: Iterable[str | None]) -> pd.DataFrame:
    """Rows of entries and lines of a batch of payloads; `row` is the payload's position. What is no valid JSON gives one
    row of the field `error` with the reason as text."""
    s = Shredder(SCHEMA)
    rows, errors = [], []
    for k, p in enumerate(payloads):
        try:
            r = canonical(p)
        except ValueError as e:
            errors.append({"row": k, "field": "error", "entry_no": 0, "line_no": 0, "text": str(e)})
            continue
        if r is not None:
            s.add(r)
            rows.append(k)
    out = [pd.DataFrame(errors).astype({"text": object})] if errors else []
    at = np.asarray(rows, dtype=np.int64)

    def filled(path: str) -> np.ndarray:
        return np.asarray([v is not None for v in s.columns[path].value], dtype=bool)

    for field_name, anchor, leaves in (("education", "record.education", sorted(_EDUCATION)), ("experience", "record.employer.role", sorted(_EXPERIENCE))):
        first = f"{anchor}.dates"
        rec = s.record_of_items(first, anchor)
        if not len(rec):
            continue
        own = [s.leaf_of_items(f"{anchor}.{x}", anchor) for x in (*leaves, "other")]
        counts = np.zeros(len(rec), dtype=bool)
        for values in own:
            counts |= np.asarray([v is not None for v in values], dtype=bool)
        if field_name == "experience":
            path = f"{anchor}.line.text"
            owner = s.owner(path, anchor)
            begins, _ = s.items(path, f"{anchor}.line")
            has = begins & filled(path)
            counts[owner[has]] = True
        number = _number(rec, counts)
        entry = {"row": at[rec], "field": field_name, "entry_no": number, "line_no": 0} | dict(zip((*leaves, "other"), own))
        if field_name == "experience":
            # the employer's name and place hold for roles that do not give their own
            begins_role, _ = s.items(first, anchor)
            of = s.owner(first, "record.employer")[begins_role]
            # the employer's leaf has one slot per employer; a role finds its employer by its own level sequence
            entry["employer_other"] = s.leaf_of_items("record.employer.employer_other", "record.employer")[of]
            for mine, theirs in (("company", "employer_name"), ("location", "employer_location")):
                firm = s.leaf_of_items(f"record.employer.{theirs}", "record.employer")
                entry[mine] = np.where(np.asarray([v is None for v in entry[mine]]), firm[of], entry[mine])
            lines = np.flatnonzero(has)
            mine = owner[lines]
            out.append(pd.DataFrame({"row": at[rec[mine]], "field": field_name, "entry_no": number[mine], "line_no": _number(mine, np.ones(len(mine), dtype=bool)), "text": np.asarray(s.columns[path].value, dtype=object)[lines]}))
        out.append(pd.DataFrame(entry)[counts])
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"row": []})


def shred_records(df: DataFrame, id_col: str = "record_id", parent_col: str = "resume_id", payload_col: str = "payload", columns: list[str] | None = None) -> DataFrame:
    """Flat tables of the nested lists in `payload_col`, all in one pass, as rows of FLAT.

    A row with `line_no` 0 is an entry of `field`; a row with a greater one is a line below it. Narrow: no shuffle.
    Payloads that are no valid JSON, empty ones among them, give one row of the field `error`, which only `error_table`
    shows; null payloads and JSON without the two lists give no rows. Objects may be nested to any depth. What an entry
    holds besides the known fields, a second value of a known field among it, is its `other`; what an employer of several
    roles holds besides name and place is the `employer_other` of each role. Entries without any text and blank lines are not counted.
    `columns` names those of FLAT that are wanted, since Spark cannot prune what comes out of Python (default: all). Repeated payloads give their rows again; extra columns of `df` are left out. A null id is kept.
    """
    need = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(parent_col).cast("bigint").alias("resume_id"), F.col(payload_col).cast("string").alias("payload"))
    kinds = dict(x.split() for x in FLAT.split(", "))
    names = columns or list(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 2000):
                part = b.iloc[k : k + 2000]
                got = rebuild(part["payload"].where(part["payload"].notna(), None))
                if len(got):
                    at = got["row"].to_numpy(dtype=np.int64)
                    for c in {"record_id", "resume_id"} & set(names):
                        got[c] = part[c].array.take(at)
                    yield got.reindex(columns=names).astype({c: object for c in names if c not in _NUMBERS})

    return need.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def entry_table(flat: DataFrame, field_name: str) -> DataFrame:
    """The entries of `education` or `experience`, keyed by record and entry number."""
    own = ["degree", "institution", "dates", "field_of_study", "grade", "location"] if field_name == "education" else ["job_title", "company", "dates", "location", "employer_other"]
    return flat.where((F.col("field") == field_name) & (F.col("line_no") == 0)).select("record_id", "resume_id", "entry_no", *own, "other")


def line_table(flat: DataFrame) -> DataFrame:
    """The description lines, keyed by record, entry number and line number."""
    return flat.where(F.col("line_no") > 0).select("record_id", "entry_no", "line_no", "text")


def error_table(flat: DataFrame) -> DataFrame:
    """The payloads that are no valid JSON, and why."""
    return flat.where(F.col("field") == "error").select("record_id", "resume_id", F.col("text").alias("error"))


def found(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("field") != "error").select("record_id", "field", "entry_no", "line_no")
