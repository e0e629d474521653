"""Text that was decoded with the wrong character encoding (problem 9).

For every chain of mistakes (bytes of encoding A read as B, and UTF-8 in such a text once more) the text that it would have
come from is a candidate. Candidates are compared by description length: the bytes that zstandard needs for the sentences
concerned with the dictionary of the text's language, plus the cost of the chain and of characters that the languages do not
use. The best is taken, and all begins anew, until no candidate is shorter than the text itself. Bytes that were lost
(replacement characters, control characters) are told the same way: by what the text costs with and without them.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from cvloom.llm.worker import Shared
from cvloom.tables import use_checkpoints

#: Encodings that a text may have been read as, and encodings that its bytes may really have had.
READ_AS = ("cp1252", "latin_1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859_2", "koi8_r", "cp866", "iso8859_15", "mac_cyrillic", "iso8859_5")
REALLY = ("cp1252", "mac_roman", "cp850", "cp437", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866")
#: Bytes of a dictionary, and the share of a language's texts that must hold a word for it to count as usual.
DICTIONARY_BYTES, USUAL = 400_000, 0.001
#: A language has a dictionary of its own from this share of the texts on, and three. With fewer, what is garbled
#: could not be told from what is usual; texts of such a language are judged by the dictionary that makes them shortest.
LANGUAGE_SHARE = 0.01
#: Of two words that a chain connects and that are spelt equally well, the one that fewer distinct texts hold by this factor
#: is taken for the garbled one when fitting, unless the texts that hold it tell.
RATIO = 4
#: Description length of a chain, in bytes. A step back to UTF-8 proves itself by its byte pattern, and a step between
#: one-byte encodings is likelier where it turns characters that the languages do not use into usual ones.
COST_UTF8, COST_ODD, COST_OTHER = 0.5, 1.0, 3.0
#: What a character costs that the languages do not use and that a candidate brings in, by the kind of its chain; and a place
#: where bytes were lost.
COST_STRANGE_UTF8, COST_STRANGE, COST_LOST = 1.5, 6.0, 0.5
LEVEL = 3

_SENTENCE = re.compile(r"[.!?;:\n)\]»”](\s+)")
_TOKEN = re.compile(r"\S*[^\x00-\x7F]\S*")
_BLANK = re.compile(r"[\t-\r\x1c-\x1f ]+")
_WIDE = [chr(c) for c in range(0x80, 0x3001) if chr(c).isspace()]
#: Well-formed UTF-8 is two bytes above 0x7F at least, and no encoding here has an ASCII character for such a byte.
_MULTI = re.compile(r"[^\x00-\x7F]{2}")
#: What stands where bytes were lost.
_LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]")
_DIGIT = re.compile(r"\d")
_EDGE = re.compile(r"^[\x00-\x2F:-@\[-`{-\x7F]+|[\x00-\x2F:-@\[-`{-\x7F]+$")


@lru_cache(maxsize=64)
def _to_bytes(name: str) -> dict[int, int]:
    """Character -> byte of a one-byte encoding. Bytes that it leaves open stand for the control character of that number,
    as lenient readers do."""
    out: dict[int, int] = {}
    for b in range(256):
        try:
            out[ord(codecs.decode(bytes([b]), name))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


@lru_cache(maxsize=64)
def _runs(name: str) -> re.Pattern:
    """Runs of characters that, as bytes of `name`, are well-formed multi-byte UTF-8."""
    of = defaultdict(list)
    for ch, b in _to_bytes(name).items():
        kind = "t" if 0x80 <= b < 0xC0 else "2" if 0xC2 <= b < 0xE0 else "3" if 0xE0 <= b < 0xF0 else "4" if 0xF0 <= b < 0xF5 else ""
        of[kind].append(re.escape(chr(ch)))
    t, two, three, four = ("[" + "".join(of[k]) + "]" for k in "t234")
    return re.compile(f"(?:{two}{t}|{three}{t}{{2}}|{four}{t}{{3}})+")


def _as_bytes(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _to_bytes(name))[0]
    except UnicodeEncodeError:
        return None


def _tokens(text: str) -> list[str]:
    """What _TOKEN finds, without its going back and forth in ASCII words. (It takes one blank that is not ASCII into a token.)"""
    if not any(map(text.__contains__, _WIDE)):
        return [t for t in text.split() if not t.isascii()]
    out: list[str] = []
    for chunk in _BLANK.split(text):
        if not chunk.isascii():
            if chunk.split() == [chunk]:
                out.append(chunk)
            else:
                out += _TOKEN.findall(chunk)
    return out


def undo_utf8(text: str, read_as: str) -> str:
    """UTF-8 read as a one-byte encoding, undone wherever the bytes are well-formed."""
    if not _MULTI.search(text):
        return text

    def back(m: re.Match) -> str:
        raw = _as_bytes(m[0], read_as)
        try:
            return raw.decode("utf-8") if raw else m[0]
        except UnicodeDecodeError:
            return m[0]

    return _runs(read_as).sub(back, text)


def undo_byte(token: str, read_as: str, really: str) -> str | None:
    """A token of a one-byte encoding read as another one, undone; None if it cannot be."""
    raw = _as_bytes(token, read_as)
    if raw is None:
        return None
    try:
        return raw.decode(really)
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=20_000)
def _byte_steps(chars: str) -> list[tuple[dict[int, int], tuple[str, ...]]]:
    """(character -> character, chains) of the steps between one-byte encodings that change a token whose other than ASCII
    characters are `chars`. No step changes ASCII."""
    out: dict[str, list[str]] = defaultdict(list)
    for enc in READ_AS:
        for real in REALLY:
            if enc != real and (u := undo_byte(chars, enc, real)) is not None and u != chars:
                out[u].append(f"{real} as {enc}")
    return [(str.maketrans(chars, u), tuple(names)) for u, names in out.items()]


@lru_cache(maxsize=None)
def _place(chain: str) -> tuple[int, ...]:
    """Order of the chains: single steps first, those back to UTF-8 before others, by encoding."""
    steps = [x.split(" as ") for x in chain.split(", then ")]
    last = ("utf-8", *REALLY).index(steps[-1][0]), READ_AS.index(steps[-1][1])
    return len(steps), last[0] > 0, last[1], last[0], *(READ_AS.index(x) for _, x in steps[:-1])


def _split(text: str) -> list[str]:
    """A text at the blanks after its sentences."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        out.append(text[at : m.start(1)])
        at = m.end()
    return [*out, text[at:]]


def _word(token: str) -> str:
    """A token without its outer ASCII punctuation and with digits made alike."""
    return re.sub(r"\d", "0", _EDGE.sub("", token))


@lru_cache(maxsize=200_000)
def oddness(word: str) -> int:
    """Places where a word is spelt as no language spells: letters of two alphabets, a capital after a small letter or a
    small letter between capitals, signs inside of words, three accented Latin letters in a row. How often a word occurs
    does not matter here. Only places with other than ASCII characters count."""
    n, alphabets, run = 0, set(), 0
    for a, c, b in zip(" " + word, word, word[1:] + " "):
        if c.isalpha():
            alphabets.add("latin" if c <= "\x7f" else unicodedata.name(c, "").split(" ")[0].lower())
        run = run + 1 if c > "\x7f" and c.isalpha() and unicodedata.name(c, "").startswith("LATIN") else 0
        n += run == 3
        if c.isupper() and a.islower() or c.islower() and a.isupper() and b.isupper():
            n += max(a, c, b) > "\x7f"
        if c > "\x7f" and not c.isalnum() or unicodedata.category(c) == "No":
            kind = unicodedata.category(c)
            if kind in ("Sk", "Cc") or c in "‚„":
                n += a.isalpha()
            elif kind[0] in "SN" or kind in ("Po", "Pi", "Ps", "Pe") and c not in "’‘·…":
                n += a.isalpha() and b.isalpha()
    return n + (len(alphabets & {"latin", "cyrillic", "greek"}) > 1)


@dataclass
class Model:
    """What is usual in each language: words with other than ASCII letters, their characters, and a zstandard dictionary."""

    words: dict[str, frozenset[str]] = field(default_factory=dict)
    chars: frozenset[str] = frozenset()
    content: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.all_words = frozenset().union(*self.words.values()) if self.words else frozenset()
        self.own_chars = {lang: frozenset(c for w in ws for c in w if c > "\x7f") for lang, ws in self.words.items()}

    def prepare(self) -> None:
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.coder = {}
        for lang, raw in self.content.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coder[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        self.memo: dict[tuple[str, str], int] = {}

    def length(self, text: str, lang: str) -> int:
        """Description length of a text in bytes."""
        return self.known(_DIGIT.sub("0", text), lang)

    def known(self, text: str, lang: str) -> int:
        """The same of a text whose digits are alike."""
        key = (lang, text)
        got = self.memo.get(key)
        if got is None:
            got = len(self.coder[lang].compress(text.encode("utf-8", "replace")))
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[key] = got
        return got

    def language(self, text: str, hint: str | None) -> str:
        # a label is believed unless another language is clearly shorter; texts without a label are none
        rivals = [k for k in self.coder if k != "und"] if hint in self.coder and hint != "und" else self.coder
        best = min(rivals, key=lambda k: (self.length(text, k), k))
        if hint in self.coder and self.length(text, hint) <= self.length(text, best) * 1.02:
            return hint
        return best


_Words = dict[str, set[str]]


def _sources(words: _Words) -> dict[str, list[tuple[str, str]]]:
    """(chain, what it would have been) of every word that some chain changes."""
    out = {}
    for w in set().union(*words.values()):
        steps = [("utf-8", enc, undo_utf8(w, enc)) for enc in READ_AS] + [(r, enc, undo_byte(w, enc, r)) for enc in READ_AS for r in REALLY if r != enc]
        out[w] = [(f"{real} as {enc}", u) for real, enc, u in steps if u is not None and u != w]
    return out


def _by_spelling(words: _Words, sources: dict[str, list[tuple[str, str]]], by_lang: dict[str, Counter]) -> tuple[_Words, _Words, set[str]]:
    """Which of the `words` (by language) some chain turns into another word of the texts: those whose spelling tells that
    they are mistakes and those where it leaves that open, by chain, and those that only counts tell.

    What is garbled may be as frequent as what is not, or more so, where one source or text has many rows. So the spelling
    of the two words decides, within a language. Where it leaves that open, a word is a mistake if most distinct texts that
    hold it also hold one which the spelling tells to be a mistake of the same chain (`_beside`). Else distinct texts are counted.
    """
    count = sum(by_lang.values(), Counter())
    odd: _Words = defaultdict(set)  # chain -> words
    even: _Words = defaultdict(set)
    fewer: set[str] = set()
    for w, read in sources.items():
        own = [by_lang[lang] for lang, ws in words.items() if w in ws]
        for chain, u in read:
            if not count[u]:
                continue
            worse = oddness(w) - oddness(u)
            if worse >= 0 and any(c[u] for c in own):
                (odd if worse else even)[chain].add(w)
            if worse > 0 and count[u] >= RATIO * count[w] or worse == 0 and sum(c[u] for c in own) >= RATIO * sum(c[w] for c in own):
                fewer.add(w)
    return odd, even, fewer


def _beside(texts: Iterable[set[str]], odd: _Words, even: _Words) -> Counter:
    """(chain, word) -> how many of the texts, given as their words, hold the word beside a mistake of the same chain."""
    near: Counter = Counter()
    for h in texts:
        for chain, ws in even.items():
            if chain in odd and not h.isdisjoint(ws) and not h.isdisjoint(odd[chain]):
                near.update((chain, w) for w in h & ws)
    return near


def _told(odd: _Words, near: Counter, count: Counter) -> set[str]:
    return set().union(*odd.values(), {w for (_, w), k in near.items() if 2 * k > count[w]})


def _undoable(letters: frozenset[str]) -> Callable[[str], bool]:
    """Is a token well-formed UTF-8 that was misread, by some encoding, with nothing new but `letters`?"""

    @lru_cache(maxsize=200_000)
    def undoable(token: str) -> bool:
        return any((u := undo_utf8(token, enc)) != token and set(u) - set(token) <= letters for enc in READ_AS)

    return undoable


def _sentences(text: str) -> list[str]:
    """Of more than five characters, with digits made alike."""
    return [s for s in _split(_DIGIT.sub("0", text)) if len(s) > 5]


def _rank(sentence: str, n: int) -> tuple:
    """Order of the sentences for a dictionary: the most frequent first, equally frequent ones in an order of no meaning."""
    return -n, zlib.crc32(sentence.encode("utf-8", "replace")), sentence


def _model(words: dict[str, frozenset[str]], chosen: dict[str, list[str]]) -> Model:
    """Of the usual words and of usual sentences, the most frequent first, by language."""
    usual = frozenset().union(*words.values()) if words else frozenset()
    # the single words once more, and the most frequent sentences last: zstandard reaches them with the shortest offsets
    vocabulary = " ".join(sorted(usual)).encode("utf-8", "replace") + b" "
    content = {}
    for lang in words:
        out, size = [], 0
        for s in chosen.get(lang, ()):
            raw = s.encode("utf-8", "replace") + b" "
            if (size := size + len(raw)) > DICTIONARY_BYTES:
                break
            out.append(raw)
        content[lang] = vocabulary + b"".join(reversed(out))
    return Model(words, frozenset(c for w in usual for c in w if c > "\x7f"), {k: v for k, v in content.items() if len(v) > 8})


def fit(rows: list[tuple[str | None, str]]) -> Model:
    """A model from labelled texts (language, text). Texts with undoable UTF-8 or lost characters are left out, and so are
    sentences with unusual words, because what is garbled in the texts must not become usual. `fit_table` is the same on Spark."""
    by_lang: dict[str, list[str]] = defaultdict(list)
    for lang, text in rows:
        if text and not _LOST.search(text):
            by_lang[lang or "und"].append(text)
    spoken = {k: v for k, v in by_lang.items() if len(v) >= max(3, len(rows) * LANGUAGE_SHARE)}
    chars: Counter = Counter()
    for texts in spoken.values():
        for t in texts:
            chars.update({c for c in t if c > "\x7f"})
    n = sum(map(len, spoken.values()))
    undoable = _undoable(frozenset(c for c, k in chars.items() if k >= max(3, n * USUAL)))

    def frequent(kept: dict[str, list[str]]) -> _Words:
        out: _Words = {}
        for lang, texts in kept.items():
            counted: Counter = Counter()
            for t, k in Counter(texts).items():
                for w in {_word(m) for m in _tokens(t)}:
                    counted[w] += k
            out[lang] = {w for w, k in counted.items() if k >= max(3, len(texts) * USUAL)}
        return out

    kept = {lang: [t for t in texts if not any(map(undoable, _tokens(t)))] for lang, texts in spoken.items()}
    words = frequent(kept)
    holding = {lang: [{_word(m) for m in _tokens(t)} for t in set(ts)] for lang, ts in kept.items()}
    by_words = {lang: Counter(w for h in hs for w in h) for lang, hs in holding.items()}
    odd, even, fewer = _by_spelling(words, _sources(words), by_words)
    told = _told(odd, _beside((h for hs in holding.values() for h in hs), odd, even), sum(by_words.values(), Counter()))
    # a text with such a word is likely to hold others of its kind whose right form is not among the words
    for lang, texts in kept.items():
        rest = [t for t in texts if not any(_word(m) in told for m in _tokens(t))]
        if len(rest) >= 3:
            kept[lang] = rest
    final = {lang: frozenset(ws - told - fewer) for lang, ws in frequent(kept).items()}
    usual = frozenset().union(*final.values())
    chosen = {}
    for lang, texts in kept.items():
        seen = Counter(s for t in texts for s in _sentences(t))
        chosen[lang] = sorted((s for s in seen if all(_word(m) in usual for m in _tokens(s))), key=lambda s: _rank(s, seen[s]))
    return _model(final, chosen)


@dataclass
class Verdict:
    text: str
    garbled: bool
    chains: list[str]


class Restorer:
    def __init__(self, model: Model):
        self.model = model
        self.readings: dict[str, list[tuple[str, float, tuple[str, ...]]]] = {}
        self.usual: dict[str, bool] = {}
        model.prepare()

    def _unusual(self, token: str) -> bool:
        got = self.usual.get(token)
        if got is None:
            if len(self.usual) > 200_000:
                self.usual.clear()
            got = self.usual[token] = _word(token) in self.model.all_words
        return not got

    def _readings(self, token: str) -> list[tuple[str, float, tuple[str, ...]]]:
        """What a token would have been: (original, cost of strange characters, chains that give it), remembered by token."""
        got = self.readings.get(token)
        if got is None:
            steps = [((f"utf-8 as {enc}",), u) for enc in READ_AS if (u := undo_utf8(token, enc)) != token]
            steps += [(names, token.translate(table)) for table, names in _byte_steps("".join(sorted({c for c in token if c > "\x7f"})))]
            by_result: dict[tuple[str, bool], list[str]] = defaultdict(list)
            again: dict[str, list[tuple[str, str]]] = {}
            for names, u in steps:
                by_result[u, "utf-8 as" in names[0]] += names
                # what one step leaves may be UTF-8 that was misread before
                if u not in again:
                    again[u] = [(enc, v) for enc in READ_AS if (v := undo_utf8(u, enc)) != u and v != token] if _MULTI.search(u) else []
                for enc, v in again[u]:
                    by_result[v, True] += [f"utf-8 as {enc}, then {name}" for name in names]
            got = []
            for (u, utf8), names in by_result.items():
                new = [c for c in u if c > "\x7f" and c not in self.model.chars]
                strange = sum(c not in token for c in new)
                if "\n" not in u and (not strange or all(map(str.isalpha, new))):  # else a sign that no language uses
                    got.append((u, strange * (COST_STRANGE_UTF8 if utf8 else COST_STRANGE), tuple(names)))
            if len(self.readings) > 30_000:
                self.readings.clear()
            self.readings[token] = got
        return got

    def _cost(self, name: str, change: dict[str, tuple[str, float]], spoken: str) -> float:
        """Of a chain, by the tokens of the text that it can change."""
        n = name.count("utf-8 as")
        cost = COST_UTF8 * n
        if not n or " as " in name.partition(", then ")[2] and not name.partition(", then ")[2].startswith("utf-8"):
            plain = [t for t, (_, strange) in change.items() if not strange]
            odd = plain and not any(self.model.own_chars[spoken].issuperset(c for c in t if c > "\x7f") for t in plain)
            cost += COST_ODD if odd else COST_OTHER
        return cost

    def _best(self, text: str, tokens: list[str], spoken: str) -> tuple[str, dict[str, str]] | None:
        """The chain that makes a text shortest, and what it makes of which tokens; None if none makes it shorter.

        A token changes only where that alone is shorter, so a result is compressed once, however many chains give it, and
        chains that shorten no token are not looked at.
        """
        holds = defaultdict(list)
        for s in _split(text):
            for t in set(_tokens(s)):
                holds[t].append(s)
        gains: dict[str, float] = defaultdict(float)
        uses: dict[str, dict[str, str]] = defaultdict(dict)
        read = {t: self._readings(t) for t in tokens}
        for t, options in read.items():
            here = holds[t]
            if not (digits := _DIGIT.search(t)):  # then no place of it comes or goes by making digits alike
                here = [_DIGIT.sub("0", s) for s in here]
            before = sum(self.model.length(s, spoken) for s in holds[t])
            after: dict[str, int] = {}
            for u, strange, names in options:
                if u not in after:
                    new = u if digits else _DIGIT.sub("0", u)
                    after[u] = sum((self.model.length if digits else self.model.known)(s.replace(t, new), spoken) for s in here)
                if (less := before - after[u] - strange) > 0:
                    for name in names:
                        gains[name] += less
                        uses[name][t] = u
        changes: dict[str, dict[str, tuple[str, float]]] = {name: {} for name in gains}
        for t, options in read.items() if gains else ():
            for u, strange, names in options:
                for name in names:
                    if name in changes:
                        changes[name][t] = u, strange
        place = {t: k for k, t in enumerate(tokens)}
        seen: set[tuple] = set()
        best, best_gain = None, 0.0
        # in the order of the text and of the chains: of chains that do the same, and of equally good ones, the first is taken
        for name in sorted(gains, key=lambda c: (place[next(iter(changes[c]))], _place(c))):
            change = changes[name]
            key = tuple((t, u) for t, (u, _) in change.items())
            if key not in seen:
                seen.add(key)
                if (gain := gains[name] - self._cost(name, change, spoken)) > best_gain:
                    best, best_gain = (name, uses[name]), gain
        return best

    def judge(self, text: str | None, lang: str | None = None) -> Verdict:
        """The original text as far as it can still be known, and whether the text is garbled at all."""
        if not text or text.isascii() or not self.model.content:
            return Verdict(text, False, [])
        chains: list[str] = []
        while True:  # a text may hold several kinds of mistakes; every round makes it shorter
            tokens = [t for t in dict.fromkeys(_tokens(text)) if self._unusual(t)]
            best = self._best(text, tokens, self.model.language(text, lang)) if tokens else None
            if best is None:
                break
            chains.append(best[0])
            text = _TOKEN.sub(lambda m: best[1].get(m[0], m[0]), text)
        if _LOST.search(text):
            spoken = self.model.language(text, lang)
            for s in _split(text):
                places = len(_LOST.findall(s))
                if places and self.model.length(_LOST.sub("", s), spoken) + COST_LOST * places < self.model.length(s, spoken):
                    chains.append("lost bytes")
                    break
        return Verdict(text, bool(chains), chains)


# ---- Spark ------------------------------------------------------------------------------------------


def fit_table(documents: DataFrame) -> Model:
    """What `fit` gives, from all rows of a table that have other than blank texts.

    One scan gives the words and characters of each distinct text, and its rows; all counts are made from that. A second one
    counts sentences. The driver gets what is frequent only: characters, words that a share of a language's texts hold, and
    DICTIONARY_BYTES of sentences a language.
    """
    use_checkpoints(documents.sparkSession)
    d = documents.where(F.col("text").rlike(r"\S")).select(F.when(F.col("lang") != "", F.col("lang")).otherwise("und").alias("lang"), F.xxhash64("text", F.length("text")).alias("h"), "text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens: list[str | None] = []  # in one string, as none holds an ordinary blank
            chars: list[str] = []
            for t in b.column(2).to_pylist():
                whole = t.isascii() or not _LOST.search(t)
                tokens.append(" ".join(sorted(set(_tokens(t)))) if whole else None)
                chars.append(" ".join(sorted(c for c in set(t) if c > "\x7f")) if whole and not t.isascii() else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.string()), pa.array(chars, pa.string())], ["lang", "h", "tokens", "chars"])

    looked = d.mapInArrow(look, "lang string, h bigint, tokens string, chars string")
    texts = looked.groupBy("lang", "h").agg(F.count("*").alias("k"), F.first("tokens").alias("tokens"), F.first("chars").alias("chars")).checkpoint()
    rows = texts.agg(F.sum("k")).first()[0] or 0
    size = F.sum("k").alias("k")
    spoken = {r.lang: r.k for r in texts.where("tokens is not null").groupBy("lang").agg(size).where(F.col("k") >= max(3, rows * LANGUAGE_SHARE)).collect()}
    texts = texts.where(F.col("tokens").isNotNull() & F.col("lang").isin(list(spoken)))
    letters = texts.select("k", F.explode(F.split("chars", " ")).alias("c")).where("c != ''").groupBy("c").agg(size).where(F.col("k") >= max(3, sum(spoken.values()) * USUAL)).collect()
    usual_letters = frozenset(r.c for r in letters)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undoable, word = _undoable(usual_letters), lru_cache(maxsize=200_000)(_word)
        for b in batches:
            rows = ((g, k, ts.split(" ") if ts else []) for g, k, ts in zip(*(c.to_pylist() for c in b.columns)))
            got = [(g, k, " ".join(set(map(word, ts)))) for g, k, ts in rows if not any(map(undoable, ts))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string())], ["lang", "k", "words"])

    kept = texts.select("lang", "k", "tokens").mapInArrow(clean, "lang string, k bigint, words string").withColumn("words", F.when(F.col("words") != "", F.split("words", " ")).otherwise(F.array().cast("array<string>"))).checkpoint()

    def per_language(kept: DataFrame) -> dict[str, int]:
        return {r.lang: r.k for r in kept.groupBy("lang").agg(size).collect()}

    def counted(kept: DataFrame) -> DataFrame:
        return kept.select("lang", "k", F.explode("words").alias("w")).groupBy("lang", "w").agg(size, F.count("*").alias("texts"))

    def frequent(counts: DataFrame, sizes: dict[str, int]) -> tuple[_Words, list[Row]]:
        enough = F.coalesce(*(F.when(F.col("lang") == g, F.col("k") >= max(3, n * USUAL)) for g, n in sizes.items()), F.lit(False))
        got = counts.where(enough).collect()
        return {g: {r.w for r in got if r.lang == g} for g in sizes}, got

    sizes = per_language(kept)
    counts = counted(kept).checkpoint()
    words, got = frequent(counts, sizes)
    sources = _sources(words)
    by_words: dict[str, Counter] = {g: Counter() for g in sizes}
    read = sorted({u for us in sources.values() for _, u in us} | {r.w for r in got})
    if read:
        asked = documents.sparkSession.createDataFrame([(u,) for u in read], "w string")
        for r in counts.join(asked, "w", "left_semi").select("lang", "w", "texts").collect():
            by_words[r.lang][r.w] = r.texts
    odd, even, fewer = _by_spelling(words, sources, by_words)
    near: Counter = Counter()
    if even and odd:

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(_beside(map(set, b.column(0).to_pylist()), odd, even).items())
                yield pa.RecordBatch.from_arrays([pa.array([c for (c, _), _ in got], pa.string()), pa.array([w for (_, w), _ in got], pa.string()), pa.array([k for _, k in got], pa.int64())], ["c", "w", "k"])

        near.update({(r.c, r.w): r.k for r in kept.select("words").mapInArrow(beside, "c string, w string, k bigint").groupBy("c", "w").agg(size).collect()})
    told = _told(odd, near, sum(by_words.values(), Counter()))
    dropped: set[str] = set()  # languages whose texts with such a word are left out
    if told:
        rest = kept.where(~F.arrays_overlap("words", F.array(*map(F.lit, sorted(told)))))
        dropped = {g for g, n in per_language(rest).items() if n >= 3}
        kept = rest.where(F.col("lang").isin(list(dropped))).unionByName(kept.where(~F.col("lang").isin(list(dropped))))
        words, _ = frequent(counted(kept), per_language(kept))
    final = {g: frozenset(words.get(g, set()) - told - fewer) for g in spoken}
    usual = frozenset().union(*final.values())

    def count_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undoable = _undoable(usual_letters)

        @lru_cache(maxsize=200_000)
        def state(token: str) -> tuple[bool, bool, bool]:
            return undoable(token), (w := _word(token)) in told, w in usual

        def out(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "s", "k"])

        seen: Counter = Counter()
        good = lru_cache(maxsize=200_000)(lambda x: x.isascii() or all(_word(m) in usual for m in _tokens(x)))
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                states = [state(m) for m in _tokens(t)]
                if not any(un or g in dropped and bad for un, bad, _ in states) and not _LOST.search(t):
                    same = all(ok for *_, ok in states)
                    seen.update((g, x) for x in _sentences(t) if same or good(x))
            if len(seen) > 100_000:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    said = d.where(F.col("lang").isin(list(spoken))).select("lang", "text").mapInArrow(count_sentences, "lang string, s string, k bigint")
    said = said.withColumn("bucket", F.pmod(F.xxhash64("s"), F.lit(64))).repartition("lang", "bucket").groupBy("lang", "bucket", "s").agg(size)
    ranked = said.withColumns({"crc": F.crc32(F.encode("s", "UTF-8")), "size": F.octet_length("s") + 1})
    for parts in (["lang", "bucket"], ["lang"]):  # what is first among all is first in its part
        w = Window.partitionBy(*parts).orderBy(F.desc("k"), "crc", "s")
        ranked = ranked.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= DICTIONARY_BYTES).drop("upto")
    chosen: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for r in ranked.select("lang", "s", "k").collect():
        chosen[r.lang].append((r.s, r.k))
    return _model(final, {g: [s for s, _ in sorted(got, key=lambda x: _rank(*x))] for g, got in chosen.items()})


def judged(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, restored, garbled, chains) of every row.

    The model is fitted on all rows first (`fit_table`); the rest is narrow. Null and empty texts stay as they are and are not
    garbled. Texts in ASCII cannot be garbled and do not go through Python. Repeated rows are judged like others; a
    wrong or missing `lang` is only a hint. Whole texts are judged, whatever their length.
    """
    spark = documents.sparkSession
    fitted = model or fit_table(documents)
    shared = Shared(spark, "restorer", (fitted.words, fitted.chars, fitted.content), lambda m: Restorer(Model(*m)))  # bounded by shares and by DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.get()
        for b in batches:
            got = [r.judge(t, g) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([v.text for v in got], pa.string()), pa.array([v.garbled for v in got], pa.bool_()), pa.array([v.chains for v in got], pa.list_(pa.string()))],
                ["doc_id", "restored", "garbled", "chains"],
            )

    d = documents.select("doc_id", "text", "lang")
    other = F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = d.where(~other).select("doc_id", F.col("text").alias("restored"), F.lit(False).alias("garbled"), F.array().cast("array<string>").alias("chains"))
    return plain.unionByName(d.where(other).mapInArrow(run, "doc_id bigint, restored string, garbled boolean, chains array<string>"))


def garbled_documents(documents: DataFrame) -> DataFrame:
    return judged(documents).where("garbled").select("doc_id")
