"""Skills of a dictionary in a text, in order of appearance."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvloom.functions import patterns as P
from cvloom.functions.text import constant, let, words_of
from cvloom.functions.vocab import SKILL_ALIASES, SKILLS, STRICT_SKILLS


@dataclass(frozen=True)
class SkillDictionary:
    """Skills by category and their aliases. Immutable: a custom dictionary holds only where it is passed."""

    categories: dict[str, list[str]]
    aliases: dict[str, str]

    @classmethod
    def default(cls) -> "SkillDictionary":
        return cls(SKILLS, SKILL_ALIASES)

    @classmethod
    def read(cls, path: str) -> "SkillDictionary":
        """From a JSON file: lists of names by category, and the object `aliases`. Keys that begin with _ and values of
        other kinds are skipped. A missing file raises FileNotFoundError, broken JSON ValueError."""
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        cats = {k: [x for x in v if isinstance(x, str)] for k, v in raw.items() if not k.startswith("_") and k != "aliases" and isinstance(v, list)}
        return cls(cats, {k.lower(): v for k, v in raw.get("aliases", {}).items() if not k.startswith("_") and isinstance(v, str)})

    def names(self) -> list[str]:
        return list(dict.fromkeys(x for v in self.categories.values() for x in v))

    def lookup(self) -> dict[str, str]:
        """Lower-case spelling -> skill; aliases go before names."""
        return {n.lower(): n for n in self.names()} | self.aliases

    def ranked(self) -> list[str]:
        """Names to search for, longest first, otherwise in the order of the dictionary."""
        return sorted(dict.fromkeys([*self.names(), *self.aliases.values()]), key=lambda s: -len(s))


def skill_pattern(skill: str) -> str:
    """How a skill is found as a whole word: what may stand beside it depends on its characters."""
    body = "\\Q" + skill + "\\E"
    if skill in STRICT_SKILLS:
        beside = r"A-Za-z0-9+#.\-"
    elif skill.endswith(("+", "#")):
        beside = "A-Za-z0-9"
    elif "." in skill:
        beside = "A-Za-z0-9."
    else:
        beside = r"\p{L}\p{N}_"
    return f"(?i)(?<![{beside}]){body}(?![{beside}])"


def dictionary_rows(spark: SparkSession, d: SkillDictionary) -> DataFrame:
    """The dictionary as a table (category, canonical, json_ord, pattern_rank, resolved)."""
    rank = {s: k for k, s in enumerate(d.ranked())}
    look = d.lookup()
    rows = [(c, s, k, rank[s], look[s.lower()]) for k, (c, s) in enumerate((c, s) for c, v in d.categories.items() for s in v)]
    return spark.createDataFrame(rows, "category string, canonical string, json_ord int, pattern_rank int, resolved string")


def skills(text: Column, dictionary: SkillDictionary | None = None) -> Column:
    """The skills of a text as array<string>, each once, in order of appearance; empty for null or blank.

    First single words, pairs and triples of words are looked up; then every skill whose letters occur in the text at all
    is searched by its pattern, longest first. Positions of the first kind count words in hundreds, those of the second
    characters, as the rules have it. Narrow and inside the JVM: the dictionary is a literal, and the cheap tests (is it one
    of the spellings, are the letters there) come before the costly ones.
    """
    d = dictionary or SkillDictionary.default()
    look = d.lookup()
    table, spelled = constant(look, "map<string,string>"), list(look)
    rows = [{"low": s.lower(), "pattern": skill_pattern(s), "rank": k, "name": look.get(s.lower(), s)} for k, s in enumerate(d.ranked())]
    entries = constant(rows, "array<struct<low:string,pattern:string,rank:int,name:string>>")

    def item(pos: Column, step: int, ord_: Column, name: Column) -> Column:
        return F.struct(pos.alias("pos"), F.lit(step).alias("pass"), ord_.alias("ord"), name.alias("name"))

    def looked_up(t: Column) -> Column:
        def grams(w: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                two = F.concat_ws(" ", x, F.get(w, i + 1))
                grams = ((0, x), (25, F.when(i + 2 < F.size(w), F.concat_ws(" ", two, F.get(w, i + 2)))), (50, F.when(i + 1 < F.size(w), two)))
                return F.array(*[F.struct((i * 100 + n).alias("pos"), g.alias("gram")) for n, g in grams])

            return F.filter(F.flatten(F.transform(w, at)), lambda g: g["gram"].isin(spelled))

        hits = F.transform(let(words_of(F.lower(F.regexp_replace(t, P.SKILL_SEPARATORS, " "))), grams), lambda g: F.struct(g["pos"].alias("pos"), F.try_element_at(table, g["gram"]).alias("name")))
        return let(hits, lambda h: F.transform(F.array_distinct(F.transform(h, lambda x: x["name"])), lambda n: item(F.get(F.filter(h, lambda x: x["name"] == n), F.lit(0))["pos"], 1, F.lit(0), n)))

    def searched(t: Column, first: Column) -> Column:
        maybe = let(F.lower(t), lambda low: F.filter(entries, lambda s: low.contains(s["low"])))
        rest = F.filter(maybe, lambda s: ~F.exists(first, lambda f: f["name"] == s["name"]))
        found = F.filter(F.transform(rest, lambda s: item(F.regexp_instr(t, s["pattern"]) - 1, 2, s["rank"], s["name"])), lambda s: s["pos"] >= 0)
        return let(found, lambda x: F.filter(x, lambda s: ~F.exists(x, lambda o: (o["name"] == s["name"]) & (o["ord"] < s["ord"]))))

    def both(t: Column) -> Column:
        return let(looked_up(t), lambda first: F.transform(F.array_sort(F.concat(first, searched(t, first))), lambda s: s["name"]))

    return F.when(text.rlike(r"\S"), let(F.regexp_replace(text, P.SKILL_LABEL, " "), both)).otherwise(F.array().cast("array<string>"))


def with_skills(df: DataFrame, source: str, out: str = "skills", dictionary: SkillDictionary | None = None) -> DataFrame:
    """Adds the skills of the text in `source`."""
    return df.withColumn(out, skills(F.col(source), dictionary))


def skill_words(df: DataFrame, source: str, key: str, dictionary: SkillDictionary | None = None) -> DataFrame:
    """(key, pos, skill): skills that single words, pairs or triples of words of the text spell, with their first position.

    A relational form of the first half of `with_skills`: an equi-join of n-grams with the dictionary, which is a literal
    table of fixed size.
    """
    look = list((dictionary or SkillDictionary.default()).lookup().items())
    words = F.when(F.col(source).rlike(r"\S"), words_of(F.lower(F.regexp_replace(F.regexp_replace(F.col(source), P.SKILL_LABEL, " "), P.SKILL_SEPARATORS, " "))))
    x = df.select(F.col(key), words.alias("_w")).select(key, "_w", F.posexplode_outer("_w").alias("i", "w")).where("w is not null")
    grams = F.expr("array(struct(i * 100 as pos, w as gram), struct(i * 100 + 50 as pos, concat(w, ' ', get(_w, i + 1)) as gram), struct(i * 100 + 25 as pos, concat(w, ' ', get(_w, i + 1), ' ', get(_w, i + 2)) as gram))")
    g = x.select(key, F.explode(grams).alias("g")).select(key, "g.*")
    table = df.sparkSession.createDataFrame(look, "gram string, skill string")
    return g.join(table, "gram").groupBy(key, "skill").agg(F.min("pos").alias("pos")).select(key, "pos", "skill")
