"""The training-text operators against brute force, exact round trips and held-out lines."""

import random
from collections import Counter

import pytest

from cvloom.llm import bpe, canonical, garble, names, packing, pii
from cvloom.llm.pii_table import labelled

LONG = "word " * 20_000


# ---- 2: personal information ------------------------------------------------------------------------


@pytest.fixture(scope="session")
def finder():
    return pii.Finder(pii.trained())


#: Other wording than the training table's, with foreign addresses and names, and with what only looks similar.
HELDOUT = [
    "My landlord wanted rent at {12 rue de la Paix, Paris|address}",
    "Please forward it to {Lindenallee 14, 20095 Hamburg|address}",
    "The workshop stood at {221b Baker Street, London|address}, phone {+44 20 7946 0958|phone}",
    "Stayed with a host family at {7 via Garibaldi, Torino|address}",
    "Parcel for {Flat 3, 18 Park Lane, Leeds 400012|address}",
    "Spent June with Dr. {Okafor|person} and nurse {Amélie Dubois|person}",
    "Met {Priya Sharma|person} and {Tom O'Neil|person}",
    "Interned with {Zsófia Horváth|person} in the blood lab",
    "The rota was drawn up by {J. Mbeki|person}",
    "Praised in writing by Ms. {Li|person}",
    "Thesis examined by {Lars van Dijk|person}",
    "Got my first job from {IVANA NOVAK|person}",
    "Please e-mail {jo.smith@mail.example.org|email} or phone {(555) 123-4567|phone}",
    "Bookings through {front-desk(at)hotel.example|email}",
    "Anything urgent: {k.lund@ward7.example|email}",
    "Reachable all night on {+49 151 2345678|phone}",
    "The pager was {555-867-5309|phone}",
    "Dial {00441632960961|phone} and wait",
    "Travelled on passport no. {X1234567|id_number}",
    "Registered at the clinic, SSN {123-45-6789|id_number}",
    "Hired after an Aadhaar check, {1234 5678 9012|id_number}",
    "We used Red Hat Linux and Google Cloud",
    "Visited New York with the Board",
    "Sold 14 Nova Deluxe mixers",
    "Catalogue entry 123-45-6789 went missing",
    "Raised output from 1,250,000 to 1,400,000 units in 2019",
    "Upgraded to version 12.4.1 over the weekend",
    "Spoke at the pizza@work lunch",
    "Walked 12 miles along Harbour Road",
    "Order 2291-77-10394 arrived late",
]


def marked(line):
    import re

    text, items, at = "", [], 0
    for m in re.finditer(r"\{([^|}]*)\|(\w+)\}", line):
        text += line[at : m.start()]
        items.append((len(text), m[2]))
        text += m[1]
        at = m.end()
    return text + line[at:], items


def test_lines_of_other_wording(finder):
    lines = [marked(x) for x in HELDOUT]
    got = [[(a, k) for a, _, k in r] for r in finder.find([t for t, _ in lines])]
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(got, lines))
    wanted, found = sum(len(b) for _, b in lines), sum(map(len, got))
    assert right >= 0.9 * wanted and right >= 0.85 * found


def test_lines_of_the_grammar(finder):
    """Other fillers in the table's own wording."""
    lines = labelled(600, seed=1234)
    got = finder.find([t for t, _ in lines])
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(got, lines))
    assert right >= 0.97 * sum(len(b) for _, b in lines)
    assert right >= 0.97 * sum(map(len, got))


def test_item_positions(finder):
    lines = ["Call +44 (0)7700 900292 for a reference", "Write to <ana.b@x.example> with questions", "Referee: Dr. Anne-Marie Vogel", "Scored 443-25-1233 on the internal parts index", "Hotline (555) 555-0199)"]
    got = finder.find(lines)
    assert [[(x[a:b], k) for a, b, k in r] for x, r in zip(lines, got)][:4] == [[("+44 (0)7700 900292", "phone")], [("ana.b@x.example", "email")], [("Anne-Marie Vogel", "person")], []]


def test_hidden_characters_keep_positions(finder):
    line = "Ca​ll +４４ (０)７７００ ９００６７４ for a reference"
    ((a, b, kind),) = finder.find([line])[0]
    assert kind == "phone" and line[a] == "+" and line[b - 1] == "４"
    assert pii.redact(line, [(a, b, kind)]) == "Ca​ll [PHONE] for a reference"


def test_viterbi_is_exact(finder):
    """The batch decoder against all label sequences of short lines."""
    import itertools

    import numpy as np

    f = finder.field
    for text in ("Call 555", "by Ana B", "x"):
        sym = f.shapes.symbols(text, pii.tokens_of(text))
        em = np.asarray([f._emission(c) for c in f.shapes.contexts(sym)])
        best = max(itertools.product(range(pii.L), repeat=len(sym)), key=lambda y: f.start[y[0]] + sum(em[k, y[k]] for k in range(len(y))) + sum(f.moves[a, b] for a, b in zip(y, y[1:])))
        assert list(f.decode([sym])[0]) == list(best)


def test_line_items_on_spark(spark):
    df = spark.createDataFrame([(1, ["", None, " ", "Mentored by Ana Kovel during the first year"], "x"), (2, None, "x"), (3, [LONG], "x"), (1, ["", None, " ", "Mentored by Ana Kovel during the first year"], "x")], "exp_id bigint, description array<string>, line string")
    rows = pii.found_items(df).collect()
    assert [tuple(r) for r in rows] == [(1, 4, "person", 13)] * 2
    assert pii.found_items(df.limit(0)).count() == 0
    assert sorted(r.redacted for r in pii.redacted_lines(df).where("line_no = 4").collect()) == ["Mentored by [PERSON] during the first year"] * 2


# ---- 5: consistent characters -----------------------------------------------------------------------

FORMS = {
    "Ｋａｖｙａ　Ｄéｒａ": "Kavya Déra",
    "é​": "é",
    "e​́": "é",
    "a b c": "a b c",
    "Soﬁa": "Sofia",
    "𝐣𝐨𝐛𝐬": "jobs",
    "Mirela Аrrеѕk": "Mirela Arresk",
    "the саѕе": "the case",
    "Добро пожаловать": "Добро пожаловать",
    "Localised “Добро а” now": "Localised “Добро а” now",
    "Οδηγίες χρήσης": "Οδηγίες χρήσης",
    "10 kΩ – “x”  y": "10 kΩ – “x”  y",
    "👩‍💻": "👩‍💻",
    "": "",
}


def test_canonical_forms():
    t = canonical.transducer()
    assert {x: t.apply(x) for x in FORMS} == FORMS
    assert all(t.apply(y) == y for y in FORMS.values())
    assert t.apply(None) is None


def test_longest_source_is_taken():
    t = canonical.transducer()
    assert {"e\u0302", "e\u0302\u0301", "\uff41"} <= set(canonical.build_mapping())
    assert t._longest("e\u0302\u0301x") == "\u1ebfx" and t._longest("e\u0302x") == "\u00eax"
    # accents in another order, on a full-width letter, and a thousand of them
    assert t.apply("\u0301e\u0323\u0302".replace("\u0301", "")) == "\u1ec7" and t.apply("\uff45\u0301") == "\u00e9"
    assert t.apply("a" + "\u200b\u0301" * 20_000).startswith("\u00e1")


def test_canonical_is_composed_for_any_letters():
    """What only needs composing comes out as the library composes it."""
    import unicodedata

    t = canonical.transducer()
    for cp in (*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x400, 0x460), *range(0x1E00, 0x1EFA), *range(0xAC00, 0xD7A3, 97)):
        if chr(cp).isalpha() and not unicodedata.decomposition(chr(cp)).startswith("<"):
            assert t.cluster(unicodedata.normalize("NFD", chr(cp))) == unicodedata.normalize("NFC", chr(cp)) == t.cluster(chr(cp))


def test_positions_of_canonical_text():
    text, at = canonical.transducer().with_positions("a​ﬁéx")
    assert (text, at) == ("afiéx", [0, 2, 2, 3, 5])


def test_inconsistent_values_on_spark(spark):
    c = spark.createDataFrame([(1, "Аna Bo"), (2, "Ana Bo"), (3, None), (4, "")], "cand_id bigint, name string")
    e = spark.createDataFrame([(7, ["ok", "n o", None]), (8, None), (9, []), (7, ["ok", "n o", None])], "exp_id bigint, description array<string>")
    assert sorted(map(tuple, canonical.inconsistent_values(c, e).collect())) == [("description", 7, 2), ("description", 7, 2), ("name", 1, 0)]
    assert canonical.canonical_values(c, e).count() == 3 + 4


# ---- 6: names ---------------------------------------------------------------------------------------


def test_link_to_register(spark):
    reg = [(1, "company", "Tavormere Systems Inc", "Tavlab", "Durn"), (2, "company", "Tavormere Consulting LLP", None, "Nagpur"), (3, "company", "Norbury & Pellvale Consulting", "Blue Bell", "Port Ansel"), (4, "company", "Ildwick Bank", None, "Pune")]
    reg += [(9, "institution", "University of Rudamere", "Green Mill", "Silverton"), (10, "institution", "Zanor University", None, None), (11, "institution", "Kolen University", None, None)]
    reg += [(20 + k, "company", f"{w} {t}", None, None) for k, (w, t) in enumerate([("Qarlo", "Systems"), ("Wenda", "Systems"), ("Zubri", "Consulting"), ("Holto", "Bank"), ("Mirsa", "Bank")])]
    register = spark.createDataFrame(reg, "org_id bigint, kind string, org_name string, also_known_as string, city string")
    said = {"TAVORMERE SYSTMS": 1, "Sys. - Tavormere, Durn": 1, "Tavormere": None, "Tavlab": 1, "pellvale + norbury cons.": 3, "NPC": 3, "Ildwick Bakery": None, "The Ildwik  Bank.": 4, "": None, "University of Rudamere": None}
    values = spark.createDataFrame([("company", v) for v in said] + [("institution", "Rudamere, Univ. of"), ("institution", None)], "kind string, value string")
    got = {(r.kind, r.value): r.org_id for r in names.link_to_register(values.unionAll(values), register).collect()}
    assert {v: got.get(("company", v)) for v in said} == said
    assert got[("institution", "Rudamere, Univ. of")] == 9


def test_large_registers_are_joined(spark, monkeypatch):
    """The way for registers that are not broadcast gives the same links."""
    reg = [(1, "company", "Tavormere Systems Inc", "Tavlab", "Durn"), (2, "company", "Tavormere Consulting LLP", None, "Nagpur"), (3, "company", "Wenda Systems", None, None), (4, "company", "Qarlo Systems", None, None), (5, "company", "Holto Systems", None, None), (6, "company", "Holto Systems Ltd", None, None)]
    register = spark.createDataFrame(reg, "org_id bigint, kind string, org_name string, also_known_as string, city string")
    values = spark.createDataFrame([("company", v) for v in ("TAVORMERE SYSTMS", "Tavormere", "Tavlab", "T.S.", "wenda  sys.", "Holto", "Nobody Ltd", "!!")], "kind string, value string")
    small = {tuple(r) for r in names.link_values(values, register).select("value", "org_id", "tie").collect()}
    monkeypatch.setattr(names, "are_small", lambda *_: False)
    assert {tuple(r) for r in names.link_values(values, register).select("value", "org_id", "tie").collect()} == small
    assert {v: (o, t) for v, o, t in small} == {"TAVORMERE SYSTMS": (1, False), "Tavormere": (1, False), "Tavlab": (1, False), "T.S.": (1, False), "Holto": (None, True), "wenda  sys.": (3, False), "Nobody Ltd": (None, False)}


def test_variants_come_together(spark):
    """Through each other: one of many slips by way of one of few; and outside of the register."""
    register = spark.createDataFrame([(1, "company", "Quelstead Bank", None, None), (2, "company", "Ildwick Bank", None, None), (3, "company", "Nor Bank", None, None)], "org_id bigint, kind string, org_name string, also_known_as string, city string")
    values = spark.createDataFrame([("company", v) for v in ("Fenstead Tailors", "fenstead  tailors.", "Fenstead Tailrs", "Tailors Fensteed", "Harbour Tailors", None)], "kind string, value string")
    rows = {r.value: r for r in names.link_values(values, register).collect()}
    assert len({rows[v].cluster for v in ("Fenstead Tailors", "fenstead  tailors.", "Fenstead Tailrs", "Tailors Fensteed")}) == 1
    assert rows["Harbour Tailors"].cluster != rows["Fenstead Tailors"].cluster and not any(r.org_id for r in rows.values())


def test_words_that_are_alike_are_all_found():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abeinrst") for _ in range(rng.randrange(1, 9))) for _ in range(500)} | {"aaaaaaaaab", "aaaaaaaaba", "łódź", "łódżź", "東京大", "東京大学", "technologies", "tech"})
    alike = {(a, b) for a in words for b in words if max(names.jaro_winkler(a, b), names.jaro_winkler(b, a)) >= names.SAME}
    assert set(names.near_pairs(words[:99], words) + names.near_pairs(words[99:], words)) == alike


def test_all_pairs_that_meet_the_threshold_are_linked(spark):
    """Not only those with one representative per phonetic code, and with the entry of the register that has such a code."""
    register = spark.createDataFrame([(1, "company", "Quelstead Bank", None, None), (2, "company", "Ildwick Bank", None, None), (3, "company", "Nor Bank", None, None)], "org_id bigint, kind string, org_name string, also_known_as string, city string")
    said = ["Harrowgate Tailors", "Harrobkdate Tailors", "Mandelstone Ltd", "Mandelsxkfgone", "Mandelsxktone", "Tandelsxkfgone"] + [f"Penbrook{a}{b} Mills" for a in "bdfgk" for b in "lmnrst"]
    rows = {r.value: r for r in names.link_values(spark.createDataFrame([("company", v) for v in said], "kind string, value string"), register).collect()}
    parent = {v: v for v in said}

    def root(v):
        return v if parent[v] == v else root(parent[v])

    for a in said:
        for b in said:
            if names.same_name(names.fold(a), names.fold(b)):
                parent[root(a)] = root(b)
    assert len(rows) == len(said)
    assert {(a, b) for a in said for b in said if rows[a].cluster == rows[b].cluster} == {(a, b) for a in said for b in said if root(a) == root(b)}


@pytest.mark.parametrize("small", [True, False])
def test_every_entry_that_scores_is_looked_at(spark, monkeypatch, small):
    monkeypatch.setattr(names, "are_small", lambda *_: small)
    reg = [(1, "company", "Brightwater Systems", None, None), (2, "company", "Brigthwader Bank", None, None), (3, "company", "National Bank", None, None)] + [(k + 10, "company", f"{w} {t}", None, None) for k, (w, t) in enumerate([("Qarlo", "Systems"), ("Wenda", "Systems"), ("Zubri", "National"), ("Holto", "Bank"), ("Mirsa", "National")])]
    said = ["Prightwater Systems", "Brihtgwaxkr Sys", "Natl. Bnk", "Ltd", "Jarlo Systems", "brightwadef bank"]
    register = spark.createDataFrame(reg, "org_id bigint, kind string, org_name string, also_known_as string, city string")
    got = {r.value: (r.org_id, r.tie) for r in names.link_values(spark.createDataFrame([("company", v) for v in said], "kind string, value string"), register).collect()}
    generic = names.register_words(register)
    for v in said:
        top = sorted(((names.score(names.fold(v), False, names.entry(r[2], r[3], r[4], generic)), r[0]) for r in reg), reverse=True)
        tie = top[0][0] >= names.ACCEPT and top[0][0] - top[1][0] < names.AHEAD
        assert got[v] == (top[0][1] if top[0][0] >= names.ACCEPT and not tie else None, tie), v


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"p{k:02d}", f"p{k + 1:02d}") for k in range(20)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in names.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: root(x) for x in parent}


def test_string_distances():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-4)


# ---- 7: tokens --------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def encoder():
    return bpe.Encoder.parse(bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"))


def test_ids_equal_public_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", " ", "\n\n  x", "It's we'LL", "Größe — “naïve”", "<|endoftext|>", "日本語" * 300, "x" * 5000, "á", "🔔🔔", LONG]
    assert [encoder.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_array_and_heap_agree(encoder):
    rng = random.Random(1)
    for _ in range(200):
        w = "".join(rng.choice("abcdeèß字 ") for _ in range(rng.randrange(1, 200))).encode()
        assert encoder.short(w) == encoder.long(w)


def test_two_tokenizers_on_the_same_workers(spark, tmp_path):
    """A worker that has served one tokenizer must not answer for the next with it."""
    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken") as f:
        lines = f.read().splitlines()
    (tmp_path / "plain.tiktoken").write_text("\n".join(lines[:256]) + "\n")
    df = spark.createDataFrame([(1, "the house")], "doc_id bigint, text string").repartition(1)
    lengths = []
    for _ in range(6):
        lengths.append((len(bpe.encode_texts(df).first().ids), len(bpe.encode_texts(df, name="plain", folder=str(tmp_path)).first().ids)))
    assert set(lengths) == {(2, 9)}


def test_encode_on_spark(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (None, "a b", "x"), (1, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in bpe.encode_texts(df).collect()), key=str)
    assert got == sorted([(1, [64, 275]), (1, [64, 275]), (2, []), (3, []), (0, [64, 275])], key=str)


# ---- 8: containers ----------------------------------------------------------------------------------


def test_plans_are_packings():
    rng = random.Random(3)
    for n in (1, 2, 7, 30, 400):
        counts = Counter(rng.choice([rng.randint(1, 64), rng.randint(20, 40)]) for _ in range(n))
        plan, bound = packing.plan_packing(dict(counts), 64)
        used = Counter()
        for p, k in plan:
            assert sum(s * m for s, m in p) <= 64 and k > 0
            for s, m in p:
                used[s] += m * k
        assert used == counts and sum(k for _, k in plan) >= bound


def test_small_plans_are_best():
    """Against exhaustive search over assignments."""
    rng = random.Random(8)

    def least(items, cap):
        best = len(items)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[k] <= cap:
                    bins[j] += items[k]
                    go(k + 1, bins)
                    bins[j] -= items[k]
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return best

    for _ in range(40):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        plan, _ = packing.plan_packing(dict(Counter(items)), 20)
        assert sum(k for _, k in plan) == least(items, 20)


def test_triplets_are_packed_exactly():
    """Three items to a container without any room left: the least number is known by construction."""
    for seed in (1, 2, 3):
        rng, items = random.Random(seed), []
        for _ in range(60):
            a = rng.randint(380, 490)
            b = rng.randint(250, (1024 - a) // 2)
            items += [a, b, 1024 - a - b]
        plan, bound = packing.plan_packing(dict(Counter(items)))
        assert (sum(k for _, k in plan), bound) == (60, 60)


def test_fillings_are_all_the_undominated_ones():
    """Against all sub-multisets, with dominance tested by exchanging any taken items for any one that was left out."""
    import itertools

    rng = random.Random(4)
    for _ in range(60):
        items = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 7))), reverse=True)
        room, counts = rng.randint(1, 20), Counter(items)
        sets = {c for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room}

        def beaten(c):
            waste, left = room - sum(c), counts - Counter(c)
            parts = [p for n in range(len(c) + 1) for p in itertools.combinations(c, n)]
            return any(sum(p) <= x <= sum(p) + waste and p != (x,) for x in left for p in parts)

        got = [f for f in packing.fillings(room, dict(counts), sorted(counts, reverse=True), room, packing.Effort(10**6))]
        assert [w for _, w in got] == sorted(w for _, w in got)
        assert sorted(tuple(s for s, m in f for _ in range(m)) for f, _ in got) == sorted(c for c in sets if not beaten(c))


def test_counts_far_above_the_bound_are_searched():
    """Sizes that force waste, so that neither the sum nor best fit is near the least number."""
    forced = {1000: 1000, 522: 120, 276: 120, 266: 120, 236: 240}
    plan, bound = packing.plan_packing(forced)
    assert sum(k for _, k in packing.best_fit(forced, 1024)) == 1220
    assert (sum(k for _, k in plan), bound) == (1180, 1180)
    assert packing.plan_packing({600: 40, 500: 3})[1] == 42
    assert packing.plan_packing({400: 40})[1] == 20


def test_pack_on_spark(spark):
    sizes = [(k, n) for k, n in enumerate([0, 1, 5, 10, 10, 10, 25, 7, 3, 0, 10] * 30)] + [(5000, None), (1, 1)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    rows = packing.pack(packing.pieces(df, 10), 10, per_group=50).collect()
    fill = Counter()
    for r in rows:
        fill[r.container_id] += r.tokens
    assert max(fill.values()) <= 10 and sum(fill.values()) == sum(n or 0 for _, n in sizes)
    assert len([r for r in rows if r.doc_id == 6]) == 3
    assert all(r.piece_no == 1 for r in rows if r.tokens < 10 and r.doc_id != 6 and (r.doc_id % 11) != 6)
    assert packing.pack(packing.pieces(df.limit(0), 10), 10).count() == 0


# ---- 9: wrong encodings -----------------------------------------------------------------------------

SAID = {
    "fr": ["Le café était fermé après l’été.", "Nous avons créé une école à Linden.", "Où sont passées les élèves de la forêt ?"],
    "de": ["Die Größe der Zuschüsse überrascht die Bürger.", "Wir hören für die Gemeinden längs der Küste zu.", "Das kostet jährlich mehr – und wächst."],
    "en": ["The auditor’s report – all of it – says nothing.", "The café owners have asked for clarity.", "We called this “naïve” and moved on.", "The slope is ½ in 10, see § 14."],
}


@pytest.fixture(scope="session")
def restorer():
    rng = random.Random(2)
    return garble.Restorer(garble.fit([(g, " ".join(rng.sample(s, 2))) for g, s in SAID.items() for _ in range(60)]))


@pytest.mark.parametrize(("real", "read"), [("utf-8", "cp1252"), ("utf-8", "latin_1"), ("utf-8", "mac_roman"), ("cp1252", "mac_roman"), ("mac_roman", "latin_1"), ("cp1252", "cp850"), ("cp1252", "cp1251")])
def test_round_trips(restorer, real, read):
    table = {b: ch for ch, b in garble._to_bytes(read).items()}
    for lang, lines in SAID.items():
        for text in lines[:2]:
            wrong = "".join(chr(table[b]) for b in text.encode(real))
            v = restorer.judge(wrong, lang)
            # both encodings may have the characters in the same places: then nothing went wrong
            assert v.garbled == (wrong != text) and v.text == text


def test_clean_texts_stay(restorer):
    for lang, lines in SAID.items():
        for text in lines:
            assert restorer.judge(text, None if lang == "de" else lang) == garble.Verdict(text, False, [])
    assert restorer.judge("", "en").garbled is False and restorer.judge(None, None).text is None
    assert restorer.judge("caf�", "fr").garbled is True


def test_one_word_and_twice(restorer):
    assert restorer.judge("The cafÃ© owners have asked for clarity.", "en").text == SAID["en"][1]
    twice = SAID["fr"][0].encode().decode("latin_1").encode().decode("latin_1")
    assert restorer.judge(twice, "fr").text == SAID["fr"][0]


def test_steps_are_tried_once_for_the_same_characters(restorer, monkeypatch):
    """What a step makes of some characters does not depend on the word that holds them."""
    calls, undo = [], garble.undo_byte
    monkeypatch.setattr(garble, "undo_byte", lambda *a: calls.append(a) or undo(*a))
    restorer._readings("nÈÎf")
    first = len(calls)
    got = restorer._readings("ÎÈlot")
    assert len(calls) == first and "éëlot".translate({ord("é"): "ë", ord("ë"): "é"}) in {u for u, *_ in got}
    assert len({(u, k) for u, k, _ in got}) == len(got)


def test_tokens_are_the_words_with_other_than_ascii_letters():
    for text in ("", "a b", "« mot» été", "\xa0\u2009x é", "é\x1fè\u2028ü x", "a\xa0b\xa0c\xa0", " Âge, naïve\n\u3000ö "):
        assert garble._tokens(text) == garble._TOKEN.findall(text)


@pytest.mark.parametrize("read", ["mac_roman", "cp850", "cp1251"])
@pytest.mark.parametrize("copies", [True, False])
@pytest.mark.parametrize("share", [0.33, 0.85])
def test_frequent_garbled_words_do_not_become_usual(read, copies, share):
    """A third or more of the rows the model is fitted on are garbled: one text again and again, or a whole source."""
    rng = random.Random(2)
    good = [(g, " ".join(rng.sample(s, 2))) for g, s in SAID.items() for _ in range(60)]
    table = {b: ch for ch, b in garble._to_bytes(read).items()}
    hit = [("fr", " ".join(SAID["fr"][:2]))] if copies else good
    right = rng.choices(hit, k=int(len(good) * share / (1 - share)))
    bad = [(g, "".join(chr(table[b]) for b in t.encode("cp1252"))) for g, t in right]
    r = garble.Restorer(garble.fit(good + bad))
    assert {r.judge(t, g).text for g, t in bad} == {t for _, t in right}
    assert not any(r.judge(t, g).garbled for g, t in good)


def test_all_rows_are_fitted_on(spark):
    """Long texts, repeated ones and garbled ones too; the same as without Spark, whatever the order of the rows."""
    rng = random.Random(3)
    good = [(g, " ".join(rng.sample(s, 2))) for g, s in SAID.items() for _ in range(40)]
    table = {b: ch for ch, b in garble._to_bytes("mac_roman").items()}
    bad = [(g, "".join(chr(table[b]) for b in t.encode("cp1252"))) for g, t in rng.sample(good, 60)]
    long = [("fr", f"{LONG}{k} Le señor Žižek est là.") for k in range(9)]
    rows = good + good[:50] + bad + long + [(None, "Ungelöst."), ("", "Ungelöst."), ("fr", "caf\ufffd"), ("xx", "Żółw"), ("fr", " \n")]
    df = spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(rng.sample(rows, len(rows)))] + [(0, None, "fr")], "doc_id bigint, text string, lang string")
    got, want = garble.fit_table(df), garble.fit([r for r in rows if r[1].strip()])
    assert (got.words, got.chars, got.content) == (want.words, want.chars, want.content)
    assert {"Žižek", "señor"} <= got.words["fr"] and not any("\ufffd" in w for w in got.all_words)
    assert not any(garble.Restorer(got).judge(t, g).garbled for g, t in good)
    assert garble.fit_table(df.limit(0)).content == {}


def test_texts_without_a_label_are_no_rival_of_a_label():
    own, und = "The café owners have asked for clarity.", "Zwei Höfe. Ein Fußgänger."
    model = garble.Model({"en": frozenset(["café"]), "und": frozenset(["Höfe"])}, frozenset("éöß"), {"en": own.encode() * 9, "und": und.encode() * 9})
    model.prepare()
    assert model.language(und, "en") == "en" and model.language(und, None) == "und"


def test_judged_on_spark(spark):
    docs = [(k, s, g) for k, (g, s) in enumerate((g, " ".join(v)) for g, v in SAID.items() for _ in range(20))]
    docs += [(100, "The cafÃ© owners have asked for clarity.", None), (101, None, "en"), (102, "", None), (103, LONG, "en"), (100, "The cafÃ© owners have asked for clarity.", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in garble.garbled_documents(df).collect()] == [100, 100]
    assert garble.judged(df).count() == len(docs)
    assert garble.judged(df.limit(0)).count() == 0
