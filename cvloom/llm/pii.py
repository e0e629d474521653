"""Personal information inside free text (problem 2).

A linear-chain conditional random field over word-shape features marks e-mail addresses, phone numbers, identity numbers,
street addresses and names of persons. It is trained from the small labelled table of `pii_table`, and decoded by Viterbi
in numpy batches. An exact check of the form of each marked item follows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvloom.llm.canonical import transducer
from cvloom.llm.pii_table import labelled
from cvloom.llm.worker import Shared

KINDS = ("email", "phone", "id_number", "address", "person")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in ("B", "I")))
L = len(LABELS)
#: Training: passes over the table, lines per step, step size, and the share by which weights shrink per pass.
PASSES, BATCH, RATE, SHRINK = 5, 64, 0.3, 1e-4
#: What a worker remembers: labels of lines, and weights of contexts and of their parts; emptied when full.
LINES_KEPT, CONTEXTS_KEPT, PARTS_KEPT = 200_000, 400_000, 600_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _case(w: str) -> str:
    if w[0].isdigit():
        return f"d{min(len(w), 14)}"
    if not w[0].isalpha():
        return w
    if w.islower():
        return "xx" if len(w) > 1 else "x"
    if w.isupper():
        return "XX" if len(w) > 1 else "X"
    return "Xx" if w[0].isupper() and w[1:].islower() else "xX"


_EDGE = ("^", "^", 0)


def _NUMERIC(s: tuple[str, str, int]) -> bool:
    c = s[1]
    return c[0] == "d" and len(c) > 1 or c in "+()" or s[2] == 1 and c in ".-"


def _CAPITAL(s: tuple[str, str, int]) -> bool:
    return s[1][0] in "Xx" and s[1] not in ("x", "xx") or s[2] == 1 and s[1] in ".-'"


class Shapes:
    """Turns a line into symbols (word if known, shape, distance to the token before), and symbols into features."""

    def __init__(self, known: frozenset[str]):
        self.known = known

    def symbols(self, text: str, spans: list[tuple[int, int]]) -> tuple[tuple[str, str, int], ...]:
        out, end = [], -1
        for a, b in spans:
            w = text[a:b]
            low = w.lower()
            out.append((low if low in self.known else "?", _case(w), 1 if a == end else 0))
            end = b
        return tuple(out)

    def contexts(self, sym: tuple[tuple[str, str, int], ...]) -> list[tuple]:
        """Of each token all that its features depend on: the symbols around it, what it is written together with, its
        distance to an at-sign, and the run of numbers or capitalised words that it is in. Equal contexts have equal
        features, so their weights are added up once."""
        n = len(sym)
        padded = (_EDGE,) * 3 + sym + (_EDGE,) * 3
        runs: list[tuple | None] = [None] * n
        for name, member in (("N", _NUMERIC), ("C", _CAPITAL)):
            k = 0
            while k < n:
                if runs[k] is not None or not member(sym[k]):
                    k += 1
                    continue
                j = k
                while j + 1 < n and member(sym[j + 1]):
                    j += 1
                b = j + 1
                # separators at the end belong to the sentence
                while b > k + 1 and sym[b - 1][1] in ".-(+":
                    b -= 1
                shape = "".join((" " if i > k and not sym[i][2] else "") + sym[i][1] for i in range(k, b))
                before, after, before2 = padded[k + 2], padded[b + 3], padded[k + 1]
                for i in range(k, b):
                    if runs[i] is None:
                        runs[i] = (name, shape, min(i - k, 3), before[0], before[1], after[0], after[1], before2[0], sym[0][0] if name == "N" else "")
                k = j + 1
        glued: list[tuple[str, int]] = []
        a = 0
        for k in range(1, n + 1):
            if k == n or not sym[k][2]:
                shape = "".join(sym[j][1][0] if sym[j][1][0] != "d" else "9" for j in range(a, k))
                glued += [(shape, min(j - a, 3)) for j in range(a, k)]
                a = k
        mail = [k for k in range(n) if sym[k][1] == "@" or sym[k][0] == "at" and (sym[k][1] == "XX" or padded[k + 2][1] in "([" and padded[k + 4][1] in ")]")]
        near = [None] * n if not mail else [max(-6, min(min((abs(k - m), k - m) for m in mail)[1], 8)) for k in range(n)]
        return [(padded[k : k + 7], glued[k], near[k], runs[k]) for k in range(n)]

    @staticmethod
    def groups(context: tuple) -> list[tuple]:
        """A context in parts whose features are independent of each other; parts recur far more than whole contexts."""
        (z, x, p, (w, c, g), q, y, v), glued, mail, run = context
        return [("a", p, w, c, g, q), ("b", x, p, c), ("c", c, q[0], y[0]), ("d", z[0], v[0]), ("e", glued), ("f", mail, c if len(c) < 3 else "d"), ("g", run)]

    @staticmethod
    def features(part: tuple) -> list[str]:
        kind = part[0]
        if kind == "a":
            _, p, w, c, g, q = part
            return ["b", "w" + w, "c" + c, f"g{g}{q[2]}", "p" + p[0] + p[1], "q" + q[0] + q[1], f"s{p[1]}|{c}|{q[1]}|{g}{q[2]}", f"i{p[0]}|{w}{c}", f"j{w}{c}|{q[0]}", f"m{p[1]}|{c}"]
        if kind == "b":
            _, x, p, c = part
            return ["x" + x[0], f"k{x[0]}|{p[0]}|{c}", f"n{x[1]}|{p[1]}|{c}"]
        if kind == "c":
            _, c, q, y = part
            return ["y" + y, f"l{c}|{q}|{y}"]
        if kind == "d":
            return ["z" + part[1], "v" + part[2]]
        if kind == "e":
            shape, pos = part[1]
            return [f"G{shape}|{pos}", f"H{pos == 0}{'@' in shape}"]
        if kind == "f":
            return [] if part[1] is None else [f"M{part[1]}|{part[2]}"]
        if part[1] is None:
            return []
        name, shape, first, before, before_c, after, after_c, before2, line = part[1]
        f = [f"R{name}{shape}|{first}", f"S{name}{first}|{before}{before_c}", f"T{name}{first}|{after}{after_c}", f"U{name}{first}|{before2}|{before}", f"V{name}{shape}|{before}"]
        return f + [f"W{shape}|{after}", f"X{shape}|{line}", f"Y{shape}|{before2}|{before}"] if name == "N" else f


class Field:
    """The conditional random field: weights of features and of neighbouring labels."""

    def __init__(self, known: frozenset[str], index: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.shapes, self.index, self.weights, self.moves, self.start = Shapes(known), index, weights, moves, start
        self.seen: dict[tuple, np.ndarray] = {}
        self.parts: dict[tuple, np.ndarray] = {}
        self.lines: dict[tuple, bytes] = {}
        self.nothing = np.zeros(L, dtype=np.float32)

    @classmethod
    def train(cls, lines: list[tuple[str, list[tuple[int, int, str]]]]) -> "Field":
        """Maximise the conditional likelihood of the labelled table, by AdaGrad in batches of padded lines."""
        count: dict[str, int] = defaultdict(int)
        for text, items in lines:
            for a, b in tokens_of(text):
                if not any(s <= a < e and k == "person" for s, e, k in items):
                    count[text[a:b].lower()] += 1
        known = frozenset(w for w, n in count.items() if n >= 8)
        shapes, index = Shapes(known), {}
        data = []
        for text, items in lines:
            spans = tokens_of(text)
            y = []
            for a, b in spans:
                lab = next((("B-" if a == s else "I-") + k for s, e, k in items if s <= a < e), "O")
                y.append(LABELS.index(lab))
            data.append(([[index.setdefault(f, len(index)) for f in fs] for fs in ([f for part in shapes.groups(c) for f in shapes.features(part)] for c in shapes.contexts(shapes.symbols(text, spans)))], y))
        size = len(index)
        W, moves, start = np.zeros((size, L)), np.zeros((L, L)), np.zeros(L)
        hw, hm, hs = np.full((size, L), 1e-6), np.full((L, L), 1e-6), np.full(L, 1e-6)
        order = np.arange(len(data))
        rng = np.random.default_rng(3)
        for _ in range(PASSES):
            rng.shuffle(order)
            for at in range(0, len(order), BATCH):
                part = [data[i] for i in order[at : at + BATCH] if data[i][1]]
                B, T = len(part), max(len(y) for _, y in part)
                flat = np.concatenate([np.concatenate([np.asarray(f) for f in fs]) for fs, _ in part])
                sizes = np.concatenate([[len(f) for f in fs] for fs, _ in part])
                rows = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                em = np.add.reduceat(W[flat], rows, axis=0)
                n = np.asarray([len(y) for _, y in part])
                mask = np.arange(T)[None, :] < n[:, None]
                E = np.zeros((B, T, L))
                E[mask] = em
                Y = np.zeros((B, T), dtype=int)
                Y[mask] = np.concatenate([y for _, y in part])
                alpha = np.zeros((B, T, L))
                alpha[:, 0] = E[:, 0] + start
                for t in range(1, T):
                    s = alpha[:, t - 1][:, :, None] + moves[None]
                    top = s.max(1)
                    new = E[:, t] + top + np.log(np.exp(s - top[:, None]).sum(1))
                    alpha[:, t] = np.where(mask[:, t][:, None], new, alpha[:, t - 1])
                top = alpha[:, -1].max(1)
                logz = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
                beta = np.zeros((B, T, L))
                gm = np.zeros((L, L))
                for t in range(T - 1, 0, -1):
                    s = moves[None] + (E[:, t] + beta[:, t])[:, None, :]
                    top = s.max(2)
                    new = top + np.log(np.exp(s - top[:, :, None]).sum(2))
                    m = mask[:, t][:, None]
                    pair = np.exp(alpha[:, t - 1][:, :, None] + s - logz[:, None, None]) * m[:, :, None]
                    gm += pair.sum(0)
                    beta[:, t - 1] = np.where(m, new, 0.0)
                prob = np.exp(alpha + beta - logz[:, None, None])
                both = mask[:, 1:]
                np.add.at(gm, (Y[:, :-1][both], Y[:, 1:][both]), -1.0)
                g = prob[mask]
                g[np.arange(len(g)), Y[mask]] -= 1.0
                gs = prob[:, 0].sum(0)
                np.add.at(gs, Y[:, 0], -1.0)
                used, inv = np.unique(flat, return_inverse=True)
                per = np.repeat(g, sizes, axis=0)
                gw = np.stack([np.bincount(inv, weights=per[:, k], minlength=len(used)) for k in range(L)], axis=1) / B
                hw[used] += gw**2
                W[used] -= RATE * gw / np.sqrt(hw[used])
                hm += (gm / B) ** 2
                moves -= RATE * (gm / B) / np.sqrt(hm)
                hs += (gs / B) ** 2
                start -= RATE * (gs / B) / np.sqrt(hs)
            W *= 1 - SHRINK
        # inside follows only begin or inside of the same kind
        for j, lab in enumerate(LABELS):
            if lab[0] == "I":
                for i, before in enumerate(LABELS):
                    if before not in ("B-" + lab[2:], lab):
                        moves[i, j] = -1e4
                start[j] = -1e4
        return cls(known, index, W.astype(np.float32), moves.astype(np.float32), start.astype(np.float32))

    def state(self) -> tuple:
        return self.shapes.known, self.index, self.weights, self.moves, self.start

    def _part(self, part: tuple) -> np.ndarray:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) > PARTS_KEPT:
                self.parts.clear()
            ids = [i for f in self.shapes.features(part) if (i := self.index.get(f)) is not None]
            got = self.parts[part] = self.weights[ids].sum(0) if ids else self.nothing
        return got

    def _emission(self, context: tuple) -> np.ndarray:
        got = self.seen.get(context)
        if got is None:
            if len(self.seen) > CONTEXTS_KEPT:
                self.seen.clear()
            a, b, c, d, e, f, g = map(self._part, self.shapes.groups(context))
            got = self.seen[context] = a + b + c + d + e + f + g
        return got

    def decode(self, symbols: list[tuple]) -> list[bytes]:
        """Best labels of each line of symbols, by Viterbi over batches of lines of like length. A line's labels depend on
        its symbols alone, so equal lines are decoded once."""
        memo = self.lines
        if len(memo) > LINES_KEPT:
            memo.clear()
        todo = sorted((s for s in dict.fromkeys(symbols) if s and s not in memo), key=len)
        for at in range(0, len(todo), 256):
            part = todo[at : at + 256]
            B, T = len(part), len(part[-1])
            E = np.zeros((B, T, L), dtype=np.float32)
            for b, s in enumerate(part):
                E[b, : len(s)] = [self._emission(c) for c in self.shapes.contexts(s)]
            n = np.asarray([len(s) for s in part])
            score = E[:, 0] + self.start
            back = np.zeros((B, T, L), dtype=np.int8)
            stay = np.arange(L, dtype=np.int8)
            for t in range(1, T):
                s = score[:, :, None] + self.moves[None]
                arg = s.argmax(1)
                new = np.take_along_axis(s, arg[:, None], 1)[:, 0] + E[:, t]
                live = (t < n)[:, None]
                back[:, t] = np.where(live, arg, stay)
                score = np.where(live, new, score)
            path = np.zeros((B, T), dtype=np.int8)
            path[:, -1] = score.argmax(1)
            for t in range(T - 1, 0, -1):
                path[:, t - 1] = back[np.arange(B), t, path[:, t]]
            for b, s in enumerate(part):
                memo[s] = path[b, : len(s)].tobytes()
        return [memo[s] if s else b"" for s in symbols]


# ---- the exact check ----------------------------------------------------------------------------------

_MAIL = re.compile(r"[\w.%+\-]+\s?(?:@|\(at\)|\[at\]|\bat\b)\s?[\w\-]+(?:\s?(?:\.|\[dot\]|\(dot\)|\bdot\b)\s?[\w\-]+)+", re.I)
_SMALL = frozenset("and or of the for in at on to a an".split())


def _fits(kind: str, item: str) -> bool:
    """Is this the form of an item of its kind?"""
    digits = sum(c.isdigit() for c in item)
    if kind == "email":
        return _MAIL.fullmatch(item) is not None
    if kind == "phone":
        return 7 <= digits <= 17 and re.search(r"[^\W\d_]{4,}", item) is None
    if kind == "id_number":
        return digits >= 4 and len(item) >= 6
    if kind == "address":
        return digits > 0 and re.search(r"[^\W\d_]{3,}", item) is not None
    words = re.findall(r"[^\W\d_]+", item)
    return digits == 0 and words[0][0].isupper() and words[-1][0].isupper() and any(len(w) > 1 for w in words) and words[-1].lower() not in _SMALL


_TITLE = re.compile(r"(?:\b(?:mr|mrs|ms|miss|dr|prof|shri|smt|sri|sir|mx|herr|frau)\b\.?\s*)$", re.I)
_LABEL = re.compile(r"^(?:(?:mr|mrs|ms|miss|dr|prof|shri|smt|sri|mx)\b\.?\s+|(?:mailto|tel|phone|fax|ph)\b[.:]?\s*)", re.I)
_AREA = re.compile(r"\(\d{1,5}\)")
_TAILS = {"email": ".,;:)>]", "phone": ".,;:)-", "id_number": ".,;:)", "address": ".,;:)-–", "person": ".,;:)-–'"}


def extract(text: str, labels: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Items (start, end, kind) from the labels of a line's tokens, after the check."""
    out, k = [], 0
    while k < len(labels):
        name = LABELS[labels[k]]
        if name == "O":
            k += 1
            continue
        kind, j = name[2:], k + 1
        while j < len(labels) and LABELS[labels[j]] == "I-" + kind:
            j += 1
        a, b = spans[k][0], spans[j - 1][1]
        k = j
        if m := _LABEL.match(text[a:b]):
            a += m.end()
        while a < b and text[a] in " ,;:<#=–-" or a < b and text[a] in "([" and kind != "phone":
            a += 1
        if kind == "phone":
            if a and text[a - 1] == "+":
                a -= 1
            # a bracket belongs to the number only around its first digits
            if a and _AREA.match(text, a - 1):
                a -= 1
            while text[a] == "(" and not _AREA.match(text, a):
                a += 1
        while b > a and text[b - 1] in _TAILS[kind] and not (text[b - 1] == ")" and text.count("(", a, b) >= text.count(")", a, b)):
            b -= 1
        if b > a and _fits(kind, text[a:b]) and (kind != "person" or _whole_name(text, a, b)):
            out.append((a, b, kind))
    return out


def _whole_name(text: str, a: int, b: int) -> bool:
    """A surname with given name or initial, or after a title."""
    parts = [w for w in re.findall(r"[^\W\d_][\w'’\-]*", text[a:b])]
    return len(parts) > 1 or _TITLE.search(text[:a]) is not None


class Finder:
    def __init__(self, field: Field):
        self.field = field

    def find(self, lines: list[str]) -> list[list[tuple[int, int, str]]]:
        """Items of each line, as positions (from 0) in the line as stored. Lines are read in their consistent form, so
        full-width digits or hidden characters do not hide an item."""
        t = transducer()
        forms, symbols, spans = [], [], []
        for line in lines:
            form = t.with_positions(line) if not line.isascii() else (line, None)
            s = tokens_of(form[0])
            forms.append(form)
            spans.append(s)
            symbols.append(self.field.shapes.symbols(form[0], s))
        out = []
        for (text, at), s, lab, line in zip(forms, spans, self.field.decode(symbols), lines):
            items = extract(text, lab, s) if any(lab) else []
            if at is not None:
                items = [(at[a], at[b] if b < len(at) else len(line), k) for a, b, k in items]
            out.append(items)
        return out


def redact(line: str, items: list[tuple[int, int, str]]) -> str:
    """The line with each item replaced by its typed placeholder, everything else unchanged."""
    out, at = [], 0
    for a, b, kind in items:
        out += [line[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + line[at:]


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field.train(labelled())


# ---- Spark ------------------------------------------------------------------------------------------

_ITEMS = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string())]))


def line_items(experience: DataFrame) -> DataFrame:
    """(exp_id, line_no, line, items, redacted) of every description line, numbered from 1 by array position.

    `items` has start_pos and end_pos (1-based code points of the stored line, end exclusive) and kind. Narrow: lines go
    through Python once, in Arrow batches; the field's weights are broadcast (their size depends on the labelled table
    only). Null arrays and null lines give no row; empty and blank lines give a row without items; repeated rows count.
    """
    shared = Shared(experience.sparkSession, "finder", trained().state(), lambda state: Finder(Field(*state)))
    lines = experience.select("exp_id", F.posexplode("description").alias("p", "line")).where("line is not null").select("exp_id", (F.col("p") + 1).alias("line_no"), "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared.get()
        for b in batches:
            text = b.column(2).to_pylist()
            found = finder.find(text)
            items = pa.array([[{"start_pos": s + 1, "end_pos": e + 1, "kind": k} for s, e, k in x] for x in found], _ITEMS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), items, pa.array([redact(t, x) for t, x in zip(text, found)], pa.string())], ["exp_id", "line_no", "line", "items", "redacted"])

    return lines.mapInArrow(run, "exp_id bigint, line_no int, line string, items array<struct<start_pos:int,end_pos:int,kind:string>>, redacted string")


def found_items(experience: DataFrame) -> DataFrame:
    """(exp_id, line_no, kind, start_pos): one row per item."""
    d = line_items(experience).select("exp_id", "line_no", F.explode("items").alias("i"))
    return d.select("exp_id", "line_no", "i.kind", "i.start_pos")


def redacted_lines(experience: DataFrame) -> DataFrame:
    return line_items(experience).select("exp_id", "line_no", "redacted")
