"""Linking variant spellings of organisation names to a register, and to each other (problem 6).

Spellings are compared token by token with Jaro-Winkler and a table of nicknames (short forms, other names, initials). Which
tokens are alike at all is found first, without loss, by bounds on Jaro-Winkler; names meet where a token of theirs has one
that is alike. Accepted pairs, of a spelling with an entry of the register or with another spelling, are clustered by
connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvloom.llm.canonical import transducer
from cvloom.llm.worker import Shared
from cvloom.tables import are_small, use_checkpoints

#: Words that do not tell organisations apart.
STOP = frozenset("the of and for at in o & de la".split())
LEGAL = frozenset("ltd limited pvt private llp llc inc incorporated gmbh plc ag sa co company p l lp".split())
#: Usual short forms of words in names of organisations.
SHORT_FORMS = {
    "academy": "acad aca", "analytics": "anl analyt", "associates": "assoc assocs", "association": "assn assoc", "bank": "bk bnk", "brothers": "bros",
    "business": "bus biz", "center": "ctr cntr", "centre": "ctr cntr", "college": "coll clg col", "communications": "comm comms", "computer": "comp",
    "conservatory": "conserv cons", "construction": "constr const", "consultancy": "consult", "consulting": "consult cons", "department": "dept",
    "development": "dev devt", "economics": "econ", "education": "edu educ", "electric": "elec", "electronics": "elec electr", "energy": "ener",
    "engineering": "eng engg engr", "enterprises": "ent entp", "finance": "fin", "financial": "fin", "foods": "fds", "foundation": "fdn found", "general": "gen",
    "group": "grp gp", "hospital": "hosp", "industries": "ind inds", "institute": "inst ins", "institution": "inst", "insurance": "ins insur", "international": "intl int",
    "labs": "lab", "laboratories": "labs lab", "laboratory": "lab", "logistics": "log logist", "management": "mgmt mgt mngt mgm", "manufacturing": "mfg manuf", "marketing": "mktg",
    "media": "med", "medical": "med", "motors": "mtrs mot", "music": "mus", "national": "natl nat", "networks": "net netw", "partners": "ptnrs part", "pharma": "ph phar", "pharmaceuticals": "pharma ph",
    "polytechnic": "poly polytech", "products": "prod prods", "research": "res", "school": "sch schl", "science": "sc sci", "sciences": "sc sci scs", "services": "svc svcs serv",
    "society": "soc", "software": "sw soft", "solutions": "soln solns sol sols", "state": "st", "systems": "sys syst", "technical": "tech", "technologies": "tech techs technol",
    "technology": "tech technol", "trading": "trdg", "transport": "transp", "university": "uni univ u varsity",
}
NICKNAMES = frozenset((short, word) for word, shorts in SHORT_FORMS.items() for short in shorts.split())
#: A word is generic (university, bank) if at least so many entries of the register use it.
GENERIC = 3
#: Least Jaro-Winkler similarity of two words that count as the same, what it costs not to
#: be the word and what a lack of similarity of 1 would cost, and the most
#: that all telling words of a name may lack together; the same of generic words, which count for less.
SAME, OTHER, LACK, MOST = 0.87, 2.0, 130.0, 19.0
SAME_GENERIC, LACK_GENERIC = 0.83, 60.0
#: How far the best entry must be ahead, and the least score that is accepted.
AHEAD, ACCEPT = 2.0, 70.0


@lru_cache(maxsize=100_000)
def fold(text: str) -> list[str]:
    """Lower-case words without accents and punctuation. The list is shared: do not change it."""
    t = unicodedata.normalize("NFKD", (transducer().apply(text) or "").casefold())
    t = "".join(c for c in t if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l")
    t = re.sub(r"(?<=\b\w)\.(?=\w\b)", "", t)  # initials: y.a.s.
    return re.findall(r"[^\W_]+", re.sub(r"[&+]", " and ", t))


@lru_cache(maxsize=500_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    reach = max(la, lb) // 2 - 1
    hit_a, hit_b, m = [False] * la, [False] * lb, 0
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not hit_b[j] and b[j] == c:
                hit_a[i] = hit_b[j] = True
                m += 1
                break
    if not m:
        return 0.0
    x = [c for c, h in zip(a, hit_a) if h]
    y = [c for c, h in zip(b, hit_b) if h]
    swapped = sum(p != q for p, q in zip(x, y)) / 2
    jaro = (m / la + m / lb + (m - swapped) / m) / 3
    same = 0
    while same < min(4, la, lb) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


_REPEAT = re.compile(r"(.)\1+")


def _within(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


@lru_cache(maxsize=500_000)
def word_cost(a: str, b: str, generic: bool) -> float | None:
    """What it costs to take the typed word `a` for the register's word `b`; None if they are not the same word."""
    if a == b:
        return 0.0
    if generic:
        if (a, b) in NICKNAMES or (len(a) >= 4 and len(b) >= 4 and (a.startswith(b) or b.startswith(a))):
            return 0.5
        if a[0] == b[0] and len(a) < len(b):
            if _within(_REPEAT.sub(r"\1", a), b):
                return 1.0
            if len(a) >= 3 and any(_within(a[:i] + a[i + 1 :], b) for i in range(1, len(a))):
                return 3.0
    alike = jaro_winkler(a, b)
    if alike < (SAME_GENERIC if generic else SAME):
        return None
    return (1 - alike) * LACK_GENERIC if generic else OTHER + (1 - alike) * LACK


@dataclass(frozen=True)
class Entry:
    core: tuple[str, ...]
    generic: tuple[str, ...]
    other: tuple[str, ...]
    city: tuple[str, ...]
    initials: str


@lru_cache(maxsize=100_000)
def entry(name: str, other: str | None, city: str | None, generic: frozenset[str]) -> Entry:
    words = [w for w in fold(name) if w not in STOP and w not in LEGAL]
    initials = "".join(w[0] for w in words)
    return Entry(tuple(w for w in words if w not in generic), tuple(w for w in words if w in generic), tuple(fold(other or "")), tuple(fold(city or "")), initials)


def _assign(typed: list[str], wanted: tuple[str, ...], generic: bool) -> tuple[float, list[str], list[str]] | None:
    """Greedy best assignment of typed to wanted words: (cost, typed words left, wanted words left)."""
    left, open_, cost = list(typed), list(wanted), 0.0
    pairs = sorted((c, i, j) for i, a in enumerate(typed) for j, b in enumerate(wanted) if (c := word_cost(a, b, generic)) is not None)
    used_i, used_j = set(), set()
    for c, i, j in pairs:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            cost += c
    left = [a for i, a in enumerate(typed) if i not in used_i]
    open_ = [b for j, b in enumerate(wanted) if j not in used_j]
    return cost, left, open_


@lru_cache(maxsize=100_000)
def _empty_word(w: str) -> bool:
    """A misspelt small word or legal form: alike, or its letters in another order or some of them, since Jaro-Winkler sees no
    swap in words of three letters."""
    known = [x for x in (*LEGAL, "and", "the") if len(x) > 2]
    return 1 < len(w) <= 3 and (w[0] in "oa" or w[-1] == "f") or any(jaro_winkler(w, x) >= 0.79 or len(w) > 1 and w[0] == x[0] and (_within(w, x) or sorted(w) == sorted(x)) for x in known)


def _without_city(words: list[str], city: tuple[str, ...]) -> tuple[list[str], bool]:
    n = len(city)
    for at in [len(words) - n, *range(len(words) - n)]:
        if n and at >= 1 and all((c := word_cost(a, b, False)) is not None and c <= 10 for a, b in zip(words[at : at + n], city)):
            return words[:at] + words[at + n :], True
    return words, False


def score(words: list[str], short: bool, e: Entry) -> float:
    """How well the words of a typed name agree with an entry of the register, up to about 104; below ACCEPT it is not that
    entry. `short` says that it was typed as initials are: in capitals or with full stops."""
    near = all(any(word_cost(a, b, False) is not None for a in words) for b in e.core)
    if not near and not (len(words) == 1 and words[0] == e.initials) and not (e.other and any(word_cost(a, e.other[0], False) is not None for a in words)):
        return 0.0
    words, at_city = _without_city(words, e.city)
    words = [w for w in words if w not in STOP]
    bonus = 4.0 if at_city else 0.0
    if not words:
        return 0.0
    if e.other and len(words) == len(e.other):
        cost = sum(c if (c := word_cost(a, b, False)) is not None else 100 for a, b in zip(words, e.other))
        if cost <= MOST and (cost == 0 or min(map(len, e.other)) > 3):
            return 98.0 - cost + bonus
    if len(words) == 1 and len(words[0]) == len(e.initials) <= 5 and words[0] == e.initials and short:
        return 90.0 + bonus
    told = [w for w in words if w not in LEGAL or w in e.core or w in e.generic]
    cost, left, missing = _assign(told, e.core, False)
    if missing or cost > MOST:
        return 0.0
    g_cost, left, open_ = _assign(left, e.generic, True)
    if any(not _empty_word(w) for w in left):
        return 0.0
    if not e.core and len(open_) == len(e.generic):
        return 0.0  # no word of the entry
    if e.generic and len(open_) == len(e.generic):
        return 100.0 - cost - 16 + bonus  # only the telling words: right if no other entry has them
    return 100.0 - cost - g_cost - 3 * len(open_) + bonus


# ---- Spark ------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b), strings; the component is its least node.

    Every round each node takes the least label among its own and its neighbours', and then that of its label's node, so
    the rounds grow with the logarithm of a component's width. Lineage is cut by checkpoint() after each round, so a lost
    executor costs one round at most. Null ends are left out.
    """
    use_checkpoints(edges.sparkSession)
    # checkpointed before it is used in both directions, or what the edges come from would be computed twice
    e = edges.where("a is not null and b is not null").select("a", "b").checkpoint()
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")).checkpoint()
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = step.join(jump, step.component == jump.n2, "left").select("node", F.least("component", F.coalesce("c2", "component")).alias("component"), "old").checkpoint()
        if not new.where("component != old").head(1):
            return new.select("node", "component")
        labels = new.select("node", "component")


def register_words(register: DataFrame) -> frozenset[str]:
    """The generic words of a register: those that at least GENERIC of its entries use. There are at most a third as many as
    the register has words; they grow with the register and not with the rows that mention it."""

    def words(names: pd.Series) -> pd.Series:
        return names.map(lambda n: sorted({w for w in fold(n or "") if w not in STOP and w not in LEGAL}))

    counted = register.select(F.explode(F.pandas_udf(words, "array<string>")("org_name")).alias("w")).groupBy("w").count().where(F.col("count") >= GENERIC)
    return frozenset(r.w for r in counted.collect())


#: Words of a block that are compared at once, and how often a word may have one character (of a class) to have a bag.
BLOCK, OFTEN = 2_000, 6


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0 and 1 for each word, whose product with another's is the number of characters that they share or more
    (rare characters share a class), and whether it has one: a word with a character more than OFTEN times has none."""
    bags, whole = np.zeros((len(words), 64 * OFTEN), dtype=np.float32), np.ones(len(words), dtype=bool)
    for k, w in enumerate(words):
        for c, n in Counter(ord(c) % 64 for c in w).items():
            bags[k, c * OFTEN : c * OFTEN + min(n, OFTEN)] = 1
            whole[k] &= n <= OFTEN
    return bags, whole


def near_pairs(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """All pairs of words that count as the same in either order: a Jaro-Winkler similarity of SAME or more.

    Similarity is at most what all shared characters in one order would give, so only pairs whose shared characters and
    common beginning suffice are compared.
    """
    if not left or not right:
        return []
    (a, whole_a), (b, whole_b) = _bags(left), _bags(right)
    used = a.any(axis=0) & b.any(axis=0)
    share = a[:, used] @ b[:, used].T
    size_a, size_b = (np.array([len(w) for w in words], dtype=np.float32) for words in (left, right))
    most = share * (1 / size_a[:, None] + 1 / size_b[None, :])  # of 2, for Jaro (most + 1) / 3
    most[~whole_a, :] = most[:, ~whole_b] = 2
    x, y = np.nonzero(most >= 3 * (SAME - 0.4) / 0.6 - 1 - 1e-3)
    start_a, start_b = (np.array([[ord(c) for c in w[:4]] + [pad] * (4 - len(w[:4])) for w in words]) for words, pad in ((left, -1), (right, -2)))
    jaro = np.minimum((most[x, y] + 1) / 3, 1)
    begin = np.cumprod(start_a[x] == start_b[y], axis=1).sum(axis=1)
    close = jaro + 0.1 * begin * (1 - jaro) >= SAME - 1e-3
    pairs = ((left[i], right[j]) for i, j in zip(x[close], y[close]))
    return [(p, q) for p, q in pairs if word_cost(p, q, False) is not None or word_cost(q, p, False) is not None]


def near_keys(words: list[str], keys: list[str]) -> list[tuple[str, str]]:
    """(word of a name, key of an entry) that lead from one to the other; see `entry_keys`."""
    got = near_pairs(words, [k for k in keys if k[0] not in "#+"])
    initials = {k[1:] for k in keys if k[0] == "#"}
    got += [(w, "#" + w) for w in words if w in initials]
    return got + [(w, k) for k in keys if k[0] == "+" for w in words if word_cost(w, k[1:], True) is not None]


def entry_keys(e: Entry) -> set[str]:
    """What a name must have to score with an entry: a word like its longest telling word, or like the first word of its
    other name, or its initials; or, if it has no telling word, any that can stand for one of its generic words."""
    keys = {max(e.core, key=lambda w: (len(w), w))} if e.core else {"+" + w for w in e.generic}
    if e.other:
        keys.add(e.other[0])
    if 0 < len(e.initials) <= 5:
        keys.add("#" + e.initials)
    return keys


def near_table(left: DataFrame, right: DataFrame, pairs: Callable[[list[str], list[str]], list[tuple[str, str]]]) -> DataFrame:
    """(a, b) of `pairs` between the distinct words of both sides (column w), a block of one with a block of the other at a time."""

    def blocks(words: DataFrame, name: str) -> DataFrame:
        d = words.select("w").distinct().checkpoint()
        return d.groupBy(F.pmod(F.xxhash64("w"), F.lit(d.count() // BLOCK + 1)).alias("block")).agg(F.collect_list("w").alias(name)).select(name)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, q in zip(b["left"], b["right"]):
                yield pd.DataFrame(pairs(list(p), list(q)), columns=["a", "b"])

    cores = left.sparkSession.sparkContext.defaultParallelism
    return blocks(left, "left").crossJoin(blocks(right, "right")).repartition(4 * cores).mapInPandas(compare, "a string, b string").checkpoint()


def core_words(name: str) -> list[str]:
    """The words of a name that spellings are compared by, sorted."""
    return sorted(w for w in name.split(" ") if w not in STOP and w not in LEGAL)


def same_name(a: list[str], b: list[str]) -> bool:
    """Are two spellings the same word for word, in any order, by Jaro-Winkler?"""
    a, b = ([w for w in x if w not in STOP and w not in LEGAL] for x in (a, b))
    if not a or len(a) != len(b):
        return False
    got = _assign(a, tuple(b), False)
    return not got[1] and not got[2] and got[0] <= MOST


class Register:
    """The register by key, in a worker."""

    def __init__(self, rows: list[tuple[int, str, str, str | None, str | None]], generic: frozenset[str]):
        self.by_key: dict[tuple[str, str], list[tuple[int, Entry]]] = defaultdict(list)
        for row in rows:
            e = entry(row[2], row[3], row[4], generic)
            for k in entry_keys(e):
                self.by_key[row[1], k].append((row[0], e))
        self.keys = sorted({k for _, k in self.by_key})
        self.near: dict[str, list[str]] = {}

    def learn(self, names: list[str]) -> None:
        """Finds the keys of the words of names, for `best`."""
        words = sorted({w for n in names for w in n.split(" ")} - self.near.keys())
        self.near.update((w, []) for w in words)
        for at in range(0, len(words), BLOCK):
            for w, k in near_keys(words[at : at + BLOCK], self.keys):
                self.near[w].append(k)

    def best(self, kind: str, name: str, short: bool) -> tuple[int | None, bool]:
        """(org_id or None, is it a tie) of a spelling; a tie between entries is no link."""
        words = name.split(" ")
        near = {org: e for w in set(words) for k in self.near[w] for org, e in self.by_key.get((kind, k), ())}
        top = sorted(((s, org) for org, e in near.items() if (s := score(words, short, e)) >= ACCEPT), reverse=True)[:2]
        if not top:
            return None, False
        tie = len(top) > 1 and top[0][0] - top[1][0] < AHEAD
        return (None if tie else top[0][1]), tie


_FORM = "struct<name:string,short:boolean>"


def _form(values: pd.Series) -> pd.DataFrame:
    """What a spelling is compared by: its folded words, and whether it was typed as initials are."""
    got = [(" ".join(fold(v)), v.strip(" .,").isupper() or "." in v) for v in values]
    # only a single short word can be initials, so nothing else is told apart by that
    return pd.DataFrame({"name": [n for n, _ in got], "short": [s and len(n) <= 5 and " " not in n for n, s in got]})


def _register_links(forms: DataFrame, register: DataFrame, generic: frozenset[str]) -> DataFrame:
    """(kind, name, short, org_id, tie) of every form: the entry of the register that it means, or null.

    Every entry that a form can score with shares a key with one of its words (`near_keys`). A register of up to 100,000
    entries (counted) is looked up in the workers, so that no pair leaves the task that makes it. A larger one is joined; then only numbers of forms and entries travel until the pairs are distinct.
    """
    entries = register.select(F.col("org_id").cast("bigint"), "kind", F.coalesce("org_name", F.lit("")).alias("org_name"), "also_known_as", "city")
    schema = "kind string, name string, short boolean, org_id bigint, tie boolean"
    if are_small(register):
        rows = [tuple(r) for r in entries.collect()]
        shared = Shared(register.sparkSession, "register", (rows, generic), lambda v: Register(*v))

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reg = shared.get()
            for b in batches:
                reg.learn(list(b["name"]))
                got = [reg.best(k, n, s) for k, n, s in zip(b["kind"], b["name"], b["short"])]
                yield b[["kind", "name", "short"]].assign(org_id=pd.array([g[0] for g in got], dtype="Int64"), tie=[g[1] for g in got])

        return forms.select("kind", "name", "short").mapInPandas(look_up, schema)

    def keys_of_entries(names: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([sorted(entry_keys(entry(n, o, None, generic))) for n, o in zip(names, others)])

    def scores(names: pd.Series, short: pd.Series, orgs: pd.Series, others: pd.Series, cities: pd.Series) -> pd.Series:
        return pd.Series([score(n.split(" "), s, entry(o, k, c, generic)) for n, s, o, k, c in zip(names, short, orgs, others, cities)], dtype="float64")

    numbered = forms.withColumn("form", F.xxhash64("kind", "name", "short")).checkpoint()
    said = numbered.select("kind", "form", F.explode(F.array_distinct(F.split("name", " "))).alias("w"))
    listed = entries.select("kind", "org_id", F.explode(F.pandas_udf(keys_of_entries, "array<string>")("org_name", "also_known_as")).alias("w")).checkpoint()
    near = near_table(said, listed, near_keys)
    pairs = said.join(near.withColumnRenamed("a", "w"), "w").join(listed.withColumnRenamed("w", "b"), ["kind", "b"]).select("form", "org_id").distinct()
    full = pairs.join(numbered, "form").join(entries.drop("kind"), "org_id")
    scored = full.withColumn("score", F.pandas_udf(scores, "double")("name", "short", "org_name", "also_known_as", "city")).where(F.col("score") >= ACCEPT)
    w = Window.partitionBy("form").orderBy(F.desc("score"), F.desc("org_id"))
    top = scored.withColumns({"second": F.lead("score").over(w), "r": F.row_number().over(w)}).where("r = 1")
    tie = F.coalesce(F.col("score") - F.col("second") < AHEAD, F.lit(False))
    best = top.select("form", F.when(~tie, F.col("org_id")).alias("org_id"), tie.alias("tie"))
    return numbered.join(best, "form", "left").select("kind", "name", "short", "org_id", F.coalesce("tie", F.lit(False)).alias("tie"))


def _node(kind: str, name: str, short: str) -> Column:
    return F.concat_ws("\u0001", kind, F.col(short).cast("string"), name)


def _words_node(bag: str) -> Column:
    """A node for words, behind all other nodes, so that none names a component."""
    return F.concat_ws("\u0001", F.lit("\U0010ffff"), "kind", bag)


def clusters(forms: DataFrame, register: DataFrame) -> DataFrame:
    """(kind, name, short, org_id, tie, cluster) of the distinct forms (kind, name, short).

    Edges lead from a form to the entry that it means, and from a form that means none by itself to every form that is the
    same word for word. So a name of many slips is linked by way of one of few, and variants of organisations outside of the
    register come together too. Forms of the same words hang on one node for these words, so that only different words are
    compared, and all that are alike meet: two names that are the same have as many words, and each word of the one is like
    a word of the other, so a name is compared with those that have a word like the one of its words that leads to fewest.
    `org_id` is the entry that the form itself means, or else the only one that its cluster means; ties, and forms of
    clusters that mean several, have none.
    """
    use_checkpoints(forms.sparkSession)
    own = _register_links(forms, register, register_words(register)).withColumn("node", _node("kind", "name", "short")).checkpoint()

    def words_of(names: pd.Series) -> pd.Series:
        return names.map(lambda n: " ".join(core_words(n)))

    said = own.where("not tie").select("kind", "node", "org_id", F.pandas_udf(words_of, "string")("name").alias("bag")).where("bag != ''").checkpoint()
    bags = said.groupBy("kind", "bag").agg(F.max(F.col("org_id").isNull()).alias("open"), F.count("*").alias("forms"))
    bags = bags.withColumns({"words": F.split("bag", " "), "n": F.size(F.split("bag", " "))}).checkpoint()
    listed = bags.select("kind", "n", "bag", "open", F.explode(F.array_distinct("words")).alias("w")).checkpoint()
    near = near_table(listed.where("open"), listed, near_pairs)
    leads = near.join(listed.groupBy("kind", "n", F.col("w").alias("b")).count(), "b").groupBy("kind", "n", F.col("a").alias("w")).agg(F.sum("count").alias("leads"))
    by = listed.where("open").join(leads, ["kind", "n", "w"]).groupBy("kind", "n", "bag").agg(F.min_by("w", F.struct("leads", "w")).alias("a"))
    met = by.join(near, "a").join(listed.select("kind", "n", F.col("bag").alias("other"), F.col("w").alias("b")), ["kind", "n", "b"]).where("bag != other").select("kind", "bag", "other").distinct()

    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([same_name(p.split(" "), q.split(" ")) for p, q in zip(x, y)], dtype=bool)

    cores = forms.sparkSession.sparkContext.defaultParallelism
    among = met.repartition(4 * cores).withColumn("same", F.pandas_udf(same, "boolean")("bag", "other")).where("same").select("kind", "bag", "other").checkpoint()
    # words that one form has and no other is like need no node
    used = among.select("kind", "bag").union(among.select("kind", "other")).union(bags.where("open and forms > 1").select("kind", "bag")).distinct()
    hung = said.join(used, ["kind", "bag"]).select("org_id", F.col("node").alias("a"), _words_node("bag").alias("b")).checkpoint()
    to_entry = hung.where("org_id is not null").select(F.concat_ws("\u0001", F.lit("org"), F.col("org_id").cast("string")).alias("a"), F.col("a").alias("b"))
    among = among.select(_words_node("bag").alias("a"), _words_node("other").alias("b")).unionByName(hung.select("a", "b"))
    parts = connected_components(among.unionByName(to_entry))
    joined = own.join(parts, "node", "left")
    means = joined.where("component is not null and org_id is not null").groupBy("component").agg(F.min("org_id").alias("one"), F.max("org_id").alias("other")).where("one = other").select("component", "one")
    entry_of = F.when(F.col("tie"), None).otherwise(F.coalesce("org_id", "one"))
    label = F.when(entry_of.isNotNull(), F.concat(F.lit("org "), entry_of.cast("string"))).otherwise(F.coalesce("component", "node"))
    return joined.join(means, "component", "left").select("kind", "name", "short", entry_of.alias("org_id"), "tie", F.regexp_replace(label, "\u0001", " ").alias("cluster"))


def _forms(values: DataFrame) -> DataFrame:
    """The distinct non-blank values (kind, value) with their form."""
    said = values.where("trim(value) != ''").select("kind", "value").distinct()
    return said.withColumn("f", F.pandas_udf(_form, _FORM)("value")).select("kind", "value", "f.name", "f.short").checkpoint()


def link_values(values: DataFrame, register: DataFrame) -> DataFrame:
    """(kind, value, org_id, tie, cluster) of the distinct typed names. Null and blank names, and names without any letter or
    digit, give no row. Only distinct forms are compared, so a name that a third of all rows share costs nothing more."""
    use_checkpoints(values.sparkSession)
    forms = _forms(values).where("name != ''")
    # dealt out by number: what few bytes there are would otherwise be put into one task, however much each costs
    cores = values.sparkSession.sparkContext.defaultParallelism
    linked = clusters(forms.select("kind", "name", "short").distinct().repartition(2 * cores, "name"), register)
    return forms.join(linked, ["kind", "name", "short"]).select("kind", "value", "org_id", "tie", "cluster")


def link_to_register(values: DataFrame, register: DataFrame) -> DataFrame:
    """(kind, value, org_id) of the distinct typed names that mean an entry of the register of their kind. A name whose two
    best entries are within AHEAD is left unlinked, as it does not say which is meant; `link_values` shows it as a tie."""
    return link_values(values, register).where("org_id is not null").select("kind", "value", "org_id")


def mentions(education: DataFrame, experience: DataFrame) -> DataFrame:
    """(field, row_id, kind, value) of every institution and company as typed."""
    inst = education.select(F.lit("institution").alias("field"), F.col("edu_id").alias("row_id"), F.lit("institution").alias("kind"), F.col("institution").alias("value"))
    comp = experience.select(F.lit("company").alias("field"), F.col("exp_id").alias("row_id"), F.lit("company").alias("kind"), F.col("company").alias("value"))
    return inst.unionByName(comp).where("value is not null")


def linked_mentions(education: DataFrame, experience: DataFrame, register: DataFrame) -> DataFrame:
    """(field, row_id, value, org_id) of the rows whose institution or company means an entry of the register."""
    said = mentions(education, experience)
    return said.join(link_to_register(said, register), ["kind", "value"]).select("field", "row_id", "value", "org_id")
