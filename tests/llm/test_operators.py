from collections import Counter
from itertools import combinations
from math import log

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kithgraph.llm import canonical, cooccur, distinctive, leaks, mojibake, survivors, tokens


# pairs
def test_pairs_by_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(cooccur, "RUN_CODES", 50)
    baskets = [[str(i % 7), str(i % 3), "x", None, "x"] for i in range(60)] + [["a"], [], None, [None]] + [["x", "0"]] * 40
    df = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, n int")
    clean = [sorted({x for x in b if x}) for b in baskets if b and any(b)]
    one, two = Counter(x for b in clean for x in b), Counter(p for b in clean for p in combinations(b, 2))
    got = {(r.item_a, r.item_b): r for r in cooccur.pair_counts(df, "items").collect()}
    assert {k: r.n_ab for k, r in got.items()} == two
    assert all((r.n_a, r.n_b, r.n) == (one[a], one[b], len(clean)) for (a, b), r in got.items())
    r = got["0", "x"]
    n10, n01 = r.n_a - r.n_ab, r.n_b - r.n_ab
    assert r.odds_ratio == pytest.approx((r.n_ab + 0.5) * (r.n - r.n_ab - n10 - n01 + 0.5) / ((n10 + 0.5) * (n01 + 0.5)))
    some = cooccur.pair_counts(df, "items", least=5, part=10)
    assert {(r.item_a, r.item_b) for r in some.collect()} == {k for k, v in two.items() if v >= 5 and v * 10 >= len(clean)}
    assert all(r.n_ab * r.n >= 2 * r.n_a * r.n_b for r in cooccur.above_chance(cooccur.pair_counts(df, "items"), 2).collect())


def test_codes_of_large_numbers_and_long_lists(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(cooccur, "RUN_CODES", 1_000)
    top = (1 << 32) - 1
    lists = [[0, 1, top - 1, top], [top], [], list(range(300)), [1, top]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), pa.array([1, 1, 1, 2, 5])], ["ids", "weight"])
    want, got = Counter(), Counter()
    for ids, w in zip(lists, (1, 1, 1, 2, 5)):
        want.update({p: w for p in combinations(ids, 2)})
    for run in cooccur._pack(iter([batch, batch.slice(3, 1), batch.slice(5)])):
        code = run.column(0).to_numpy()
        assert (np.diff(code) > 0).all() and len(code) < 1_400
        for c, n in zip(code.view(np.uint64).tolist(), run.column(1).to_pylist()):
            got[c >> 32, c & top] += n
    want.update({p: 2 for p in combinations(range(300), 2)})
    assert got == {p: n for p, n in want.items() if n}


def test_no_pairs(spark):
    df = spark.createDataFrame([(["a"],), (None,)], "items array<string>")
    assert cooccur.pair_counts(df, "items").count() == 0 and cooccur.pair_counts(df.limit(0), "items", 5, 200).count() == 0


# terms
TEXTS = [(1, "Red red fork!"), (2, "red spoon x_y"), (3, ""), (4, None), (5, "... "), (6, "fork " * 3000)]


def test_scores_by_hand(spark, rows):
    df = spark.createDataFrame([(*t, "clash", 1) for t in TEXTS], "id long, t string, term string, tf int")
    got = {(r.id, r.term): (r.tf, r.n_records, round(r.score, 9)) for r in distinctive.term_scores(df, "id", "t", k1=None, b=0.0, idf="ratio").collect()}
    assert got[1, "red"] == (2, 2, round(2 * log(5 / 2), 9)) and got[6, "fork"] == (3000, 2, round(3000 * log(5 / 2), 9)) and (2, "x") in got and (2, "y") in got
    kept = distinctive.term_scores(df, "id", "t", k1=None, b=0.0, idf="ratio", min_records=2)
    assert rows(distinctive.top_term(kept, "id"), "id", "term") == [(1, "red"), (2, "red"), (6, "fork")]
    n, length, average = 5, 3, (3 + 4 + 0 + 0 + 3000) / 5
    bm = {(r.id, r.term): r.score for r in distinctive.term_scores(df, "id", "t").collect()}
    assert bm[1, "red"] == pytest.approx(2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * length / average)) * log(1 + (n - 2 + 0.5) / 2.5))
    assert distinctive.term_scores(df.limit(0), "id", "t").count() == 0


def test_ties_go_to_the_first_term(spark, rows):
    df = spark.createDataFrame([(1, "b a"), (2, "a b"), (3, "c")], "id long, t string")
    assert rows(distinctive.top_term(distinctive.term_scores(df, "id", "t", k1=None, b=0.0, idf="ratio", min_records=2), "id"), "id", "term") == [(1, "a"), (2, "a")]


# survivors
def test_fusion_discounts_copies(spark):
    claims, votes = [], {}
    for i in range(120):
        said = {f"own{s}": f"t{i}" if (i * 7 + s * s * 3) % 10 >= 3 else f"f{i}-{s}" for s in range(6)}
        said |= {f"copy{s}": f"c{i}" if i % 2 else f"t{i}" for s in range(4)}
        counts = Counter(said.values())
        votes[i] = max(counts, key=lambda v: (counts[v], v[0] == "c"))  # a plain vote may as well take the copies' value on ties
        claims += [(i, "f", v, s, 1) for s, v in said.items()]
    claims += [(1, "f", "  ", "own1", 9), (None, "f", "x", "own1", 1), (2, None, "x", "own1", 1), (3, "f", None, "copy1", 9), (5, "f", claims[50][2], "own0", 0)]
    df = spark.createDataFrame(claims, "id long, field string, value string, source string, at long")
    got = {r.id: (r.value, r.probability) for r in survivors.fuse(df).collect()}
    right = sum(v == f"t{i}" for i, (v, _) in got.items())
    assert len(got) == 120 and right > sum(v == f"t{i}" for i, v in votes.items()) and right >= 114 and all(0 < p <= 1 for _, p in got.values())
    assert survivors.fuse(df.limit(0)).count() == 0


@pytest.mark.parametrize("sources, cover", [(12, 0.5), (60, 0.3), (300, 0.1)])
def test_planted_truth_is_found_among_copiers(spark, sources, cover):
    """A third of the sources err seldom, a third often, and a third copy one that is mostly wrong; each speaks of a part of the ids."""
    import random

    random.seed(sources)
    third, claims, plain = sources // 3, [], 0
    for i in range(400):
        truth = f"t{i}"
        bad = truth if random.random() < 0.4 else f"w{i}"
        said = {f"good{s}": truth if random.random() < 0.85 else f"g{i}-{s}-{random.randint(0, 9)}" for s in range(third) if random.random() < cover}
        said |= {f"poor{s}": truth if random.random() < 0.6 else f"p{i}-{random.randint(0, 9)}" for s in range(third) if random.random() < cover}
        said |= {f"copy{s}": bad if random.random() < 0.95 else f"c{i}-{random.randint(0, 9)}" for s in range(third) if random.random() < cover}
        said["copy0"] = bad
        claims += [(i, "f", v, s, 1) for s, v in said.items()]
        counts = Counter(said.values())
        plain += max(counts, key=counts.get) == truth
    df = spark.createDataFrame(claims, "id long, field string, value string, source string, at long")
    right = sum(r.value == f"t{r.id}" for r in survivors.fuse(df).collect())
    print("right of 400: fusion", right, "majority", plain)
    assert right >= 360 and right > plain


def test_latest_claim_of_a_source_counts(spark, rows):
    df = spark.createDataFrame([(1, "f", "old", "s", 1), (1, "f", "new", "s", 2)], "id long, field string, value string, source string, at long")
    assert rows(survivors.fuse(df), "id", "field", "value") == [(1, "f", "new")]


# tokens
ODD = ["", " ", "  a  b ", "it's they'LL", "<|endoftext|> x", "a\n\n b\r\n", "١٢٣ ½ x²", "👩‍💻👍🏽", "á é ​﻿", "\x00\x07\x1b\x85\xa0x", "x" * 20_000, "\U00010d40 new digit", "　　wide", "  ", "\U0001ccf0"]


def encoded(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id long, t string, ids string")
    return tokens.encode(df, "id", "t", **kw)


def test_odd_texts_as_the_library_and_back(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    out = encoded(spark, [*ODD, None, ODD[2]])
    got = {r.id: r.ids for r in out.collect()}
    assert [got[i] for i in range(len(ODD))] == [t.encode(x, add_special_tokens=False).ids for x in ODD]
    assert got[0] == got[len(ODD)] == [] and got[len(ODD) + 1] == got[2]
    back = {r.id: r.text for r in tokens.decode(out, "ids").collect()}
    assert [back[i] for i in range(len(ODD))] == ODD


def test_odd_ids(spark):
    df = spark.createDataFrame([(1, [-1, 10**6, None], "a"), (2, None, "b"), (3, [], "c"), (4, [220, 10**6, 220], "d")], "id long, ids array<int>, text string")
    assert {r.id: r.text for r in tokens.decode(df, "ids").collect()} == {1: "", 2: None, 3: "", 4: "  "}
    half = [i for t, i in tokens.ranks("/opt/tokenizers/byte_bpe_50k.tiktoken").items() if t == b"\xc3"]
    broken = spark.createDataFrame([(half, "x"), ([220], "y")], "ids array<int>, k string")
    assert {r.k: r.text for r in tokens.decode(broken, "ids").collect()} == {"x": "\ufffd", "y": " "} and tokens.decode(df.limit(0), "ids").count() == 0


def test_nothing_to_encode(spark):
    assert encoded(spark, ["x"]).where("id > 5").count() == 0
    assert [r.ids for r in encoded(spark, [None, ""]).collect()] == [[], []]
    assert tokens.encode(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_many_packs(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PACK_CHARACTERS", 40)
    texts = [f"word{i % 5} and number {i}" for i in range(60)]
    out = tokens.decode(encoded(spark, texts), "ids")
    assert {r.id: r.text for r in out.collect()} == dict(enumerate(texts))


# leaks
ITEMS = [(1, "One two three, four five.", "ans wer"), (2, "three four five six", None), (3, "short", "x"), (None, "one two three four", "x"), (4, None, "x"), (1, "One two three, four five.", "ans wer")]


def test_leaks_and_their_places(spark, rows, monkeypatch):
    docs = [(1, "> ONE\n> two -- three... four! fives"), (2, "x one two three four five six ANS-wer"), (3, ""), (4, None), (5, "one two three"), (6, "one_two_three_four"), (2, "x one two three four five six ANS-wer"), (7, "noise " * 20_000 + "three four five six")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "id long, text string, start int")
    items = spark.createDataFrame(ITEMS, "item long, passage string, answer string")
    args = df, "id", "text", items, "item", "passage", "answer", 4
    got = rows(leaks.find_leaks(*args))
    text = docs[1][1]
    assert (2, 1, 2, text.index(" six"), 5, True) in got and got.count((2, 1, 2, text.index(" six"), 5, True)) == 2
    assert {(g[0], g[1]) for g in got} == {(1, 1), (2, 1), (2, 2), (6, 1), (7, 2)}
    first = next(g for g in got if g[0] == 1)
    assert docs[0][1][first[2] : first[3]] == "ONE\n> two -- three... four" and first[5] is False
    monkeypatch.setattr(leaks, "ITEM_BYTES", 10)
    assert rows(leaks.find_leaks(*args)) == got
    assert leaks.find_leaks(df, "id", "text", items.limit(0), "item", "passage").count() == 0 and leaks.find_leaks(df.limit(0), *args[1:]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab c"), max_size=30), st.lists(st.sampled_from("abc"), min_size=3, max_size=8))
def test_automaton_by_brute_force(text, passage):
    words, own = leaks.spoken(" ".join(text)), passage
    hit = any(words[i : i + 3] == own[j : j + 3] for i in range(len(words) - 2) for j in range(len(own) - 2))
    assert bool(leaks.Index([(1, " ".join(passage), None)], 3).find(" ".join(text))) == hit


def test_an_automaton_of_many_items_is_small():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import random, resource
from kithgraph.llm import leaks
random.seed(1)
words = ["".join(random.choices("abcdefghijklmnop", k=random.randint(3, 8))) for _ in range(30_000)]
items = [(i, " ".join(random.choices(words, k=120)), " ".join(random.choices(words, k=3))) for i in range(10_400)]
size = sum(len(p) + len(a) for _, p, a in items)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
index = leaks.Index(items, 13)
print(size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
assert index.find("x " + " ".join(items[77][1].split()[50:64]))[0][::3] == (77, 14)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(leaks.__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    size, held = map(int, done.stdout.split())
    assert size > 7_900_000 and held < 200_000_000


def test_one_word_over_and_over():
    index = leaks.Index([(1, "noise " * 20_000, "noise noise")], 13)
    assert index.find("a " + "noise " * 20_000) == [(1, 2, 2 + 6 * 20_000 - 1, 20_000, True)]


# reference lists
REF = [(1, "Saint Örebro", "Aland", "AL1"), (2, "Orebru Falls", "Bland", "BL2"), (3, "Twinton", "Aland", "AL1"), (4, "Twinton", "Bland", "BL2"), (5, None, "Bland", "BL2"), (None, "Nowhere", "Bland", "BL2"), (6, "Saint Gorlav", "Aland", None), (7, "Saint Mukkel", "Aland", None), (8, "Saint Perrin", "Bland", None)]
LONG = " ".join(f"w{i}" for i in range(20_000))
HABITS = [f"{p} {n}" for p in ("living in", "near") for n in ("Saint Gorlav", "Saint Mukkel", "Saint Perrin", "Orebru Falls")] + ["St. Gorlav", "ST MUKKEL", "st Perrin"]


@pytest.mark.parametrize("deletes", [4_000_000, 300])
def test_places(spark, monkeypatch, deletes):
    monkeypatch.setattr(canonical, "PART_DELETES", deletes)
    want = {"saint orebro": 1, "St. Örebro, Aland": 1, "SAINT  OREBOR": 1, "living in Saint Orebro (AL1)": 1, "Saint Orebro / BL2": -1, "Aland, Twinton": 3, "Twinton - BL2": 4, "Twinton BL2": 4, "Twinton": 4, "Elsewhere": -1, "near orebru  falls!": 2}
    want |= {"🌍": -1, "x" * 50_000: -1, LONG: -1, "beside Saint Gorlav": -1, "St Carolina": -1, "near": -1, "st": -1, "near st Perrrin": 8}
    values = [*want, *HABITS, "  ", None, ""]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(values)], "line long, v string, ref_id int")
    ref = spark.createDataFrame(REF, "id long, name string, country string, code string")
    got = {values[r.line]: r.ref_id for r in canonical.match(df, "line", "v", ref, "id", "name", qualifiers=("country", "code")).collect()}
    assert {v: got[v] for v in want} == want and set(got) == {*want, *HABITS} and all(got[v] > 0 for v in HABITS)


def test_companies(spark):
    names = ["Acme Data Works", "Fish & Chip", "Zeta Software", "Bolt Software", "Oak Software", "Night & Day", "Salt & Pepper"]
    habits = [f"{n}{p}" for n in names for p in (", Inc.", " GmbH")] + ["Bolt sw", "Oak SW", "zeta sw (inc)", "zeta sw", "Fish and Chip", "night and day", "salt and pepper"]
    want = {"@acmedataworks, Inc.": 0, "Acme Data Wroks GmbH": 0, "A.D.W.": 0, "Fish and Chip GmbH": 1, "acme school": -1, "zeta sw inc": 2, "bolt sw and": -1}
    values = [*want, *habits]
    df = spark.createDataFrame(list(enumerate(values)), "line long, v string")
    ref = spark.createDataFrame([(i, n, {0: "ADW", 2: "ZS"}.get(i)) for i, n in enumerate(names)], "id long, name string, short string")
    got = {values[r.line]: r.ref_id for r in canonical.match(df, "line", "v", ref, "id", "name", alias="short").collect()}
    assert {v: got[v] for v in want} == want and -1 not in [got[v] for v in habits]
    assert {r.ref_id for r in canonical.match(df, "line", "v", ref.limit(0), "id", "name").collect()} == {-1}
    assert canonical.match(df.limit(0), "line", "v", ref, "id", "name").count() == 0


def test_habits_of_another_domain(spark):
    titles = ["Senior Gardener", "Senior Welder", "Senior Baker", "Master Plumber", "Deputy Clerk"]
    said = [f"{p} {t}" for t in titles for p in ("werde bald", "je suis")] + [f"{t} m w d" for t in titles] + ["Snr Gardener", "snr welder", "SNR baker"]
    odd = {"je suis snr gardner m w d": 0, "werde bald Deputy Clrek": 4, "je suis": -1, "was Master Plumber": -1, "snr clerk": -1}
    values = [*said, *odd]
    df = spark.createDataFrame(list(enumerate(values)), "line long, v string")
    ref = spark.createDataFrame(list(enumerate(titles)), "id long, name string")
    got = {values[r.line]: r.ref_id for r in canonical.match(df, "line", "v", ref, "id", "name").collect()}
    assert {v: got[v] for v in odd} == odd and all(titles[got[v]].split()[-1].lower() in v.lower() for v in said)


def test_distance():
    assert canonical.distance("abcd", "abcd") == (0, 0) and canonical.distance("abcd", "abdc")[0] == 1 and canonical.distance("ca", "abc")[0] == 2 and canonical.distance("", "ab")[0] == 2
    assert canonical.distance("abbc", "abc") == (1, canonical.DOUBLE) and canonical.distance("abxc", "abc") == (1, canonical.EDIT) and canonical.distance("abc", "xyz") is None


def whole_table(a, b):
    """Damerau-Levenshtein distance with any edits between swapped letters."""
    last, d = {}, {(i, j): 99 for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            match = j if a[i - 1] == b[j - 1] else match
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1, d[k - 1, m - 1] + i - k + j - m - 1 if k and m else 99)
        last[a[i - 1]] = i
    return d[len(a), len(b)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_distance_by_the_whole_table(a, b):
    want, got = whole_table(a, b), canonical.distance(a, b)
    assert (got[0] if got else None) == (want if want <= 2 else None)


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=6, max_size=9), st.lists(st.tuples(st.sampled_from("dis"), st.integers(0, 8), st.sampled_from("abc")), max_size=2))
def test_two_edits_are_found(name, edits):
    key = name
    for kind, i, c in edits:
        i %= len(key)
        key = key[:i] + key[i + 1 :] if kind == "d" else key[:i] + c + key[i + (kind == "s") :]
    if canonical.reach(key) == 2:
        found = canonical.Dictionary([(1, name, False, [], 0, 0)]).matches(key, False)
        assert [e[0] for _, e in found] == [1]


def test_a_large_dictionary_is_small(monkeypatch):
    import random

    random.seed(1)
    names = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(8, 22))) for _ in range(2_000)]
    index = canonical.Dictionary([(i, n, False, [], 0, 0) for i, n in enumerate(names)])
    assert index.hashes.nbytes + index.of.nbytes <= 12 * sum(1 + len(n) + len(n) * (len(n) - 1) // 2 for n in names) < 12 * 300_000
    assert all(any(e[0] == i for _, e in index.matches(n[:3] + n[4:], False)) for i, n in enumerate(names))


# wrong encodings
GOOD = ["Die Größe für Änderungen wäre schön", "La función está añadida después", "Nous avons été à l’école d’été", "Мы удалили лишний код и добавили проверок", "It isn’t “done” — naïve café", "plain words only", "keys for Ã, ð, ¿ and €", "INFORMAÇÕES NÃO SÃO", "├── a\n└── b"]


def spoil(text, encoding, times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())
    return text


def test_finds_and_restores(spark):
    bad = {
        100: (GOOD[0], spoil(GOOD[0], "cp1252")),
        101: (GOOD[1], spoil(GOOD[1], "latin-1")),
        102: (GOOD[4], spoil(GOOD[4], "mac_roman")),
        103: (GOOD[4], spoil(GOOD[4], "cp1252", 2)),
        104: (GOOD[1], spoil(GOOD[1], "cp437")),
        105: (GOOD[3], GOOD[3].encode("cp1251").decode("latin-1")),
        106: (GOOD[3], GOOD[3].encode("koi8_r").decode("cp1251")),
        107: (GOOD[0], GOOD[0].encode("latin-1").decode("utf-8", "replace")),
        108: (GOOD[4] + " x", GOOD[4][:10] + spoil(GOOD[4][10:] + " x", "cp1252")),
    }
    texts = [(i, GOOD[i % len(GOOD)] + ("." if i % 2 else "")) for i in range(90)] + [(k, v[1]) for k, v in bad.items()] + [(200, None), (201, ""), (None, bad[100][1])]
    df = spark.createDataFrame([(*t, "c", 0.0) for t in texts], "id long, text string, token string, gain double")
    found = {r.id for r in mojibake.garbled(df, "id", "text").collect()}
    assert found == set(bad)
    back = {r.id: r.text for r in mojibake.restored(df, "id", "text").collect()}
    for k in (100, 101, 102, 103, 104, 107, 108):
        assert back[k] == bad[k][0]
    assert "удалили" in back[105] and "проверок" in back[106]
    assert mojibake.garbled(df.limit(0), "id", "text").count() == 0


def test_lattice():
    likely = mojibake.likelihood({c: 5 for c in "üà”éШ"})
    best = lambda t, enc="cp1252": (mojibake.likeliest(x, likely) if (x := mojibake.decoded(mojibake.plain(t), enc)) else None)
    assert best("fÃ¼r")[1:] == ("für", 0) and best("für") is None
    assert best("â€�")[1:] == ("”", 1) and best("Ã")[1:] == ("à", 1)
    three = mojibake.decoded(mojibake.plain("xâ€�Ã�é-â€�"), "cp1252")
    assert mojibake.fits(three, "x”Áé-”") == 3 and mojibake.fits(three, "x”Áé-") is None and mojibake.fits(three, "xâ€�Ã�é-â€�") is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["Ã", "¼", "©", "�", "â", "€", "x", "Ð", "й"]), min_size=1, max_size=7).map("".join), st.sampled_from(["cp1252", "latin-1", "cp1251"]), st.integers(1, 3))
def test_likeliest_path_by_enumeration(text, encoding, depth):
    likely = mojibake.likelihood({c: i + 1 for i, c in enumerate("éüàй”Ã©")})
    lattice = mojibake.plain(text)
    for _ in range(depth):
        lattice = lattice and mojibake.decoded(lattice, encoding)
    if lattice is None:
        return
    paths, done = [(0, "", 0, False)], []
    while paths:
        i, r, n, new = paths.pop()
        if i == len(text):
            done += [(sum(likely(c) for c in r if c >= "\x80") - mojibake.LOST * n, r)] * new
            continue
        paths += [(to, r + c, n + m, new or k) for to, c, m, k in lattice[i]]
        if len(paths) + len(done) > 20_000:
            return
    found = mojibake.likeliest(lattice, likely)
    assert (found is None) == (not done)
    if done:
        assert found[0] == pytest.approx(max(done)[0])
        assert all(mojibake.fits(lattice, r) is not None for _, r in done[:50])
        keys, least, most, _ = mojibake.ends(lattice)
        ends = [(int(k[0]), *k[1:].split("\n")) for k in keys]
        assert all(least <= len(r) <= most and (not ends or any(len(a) == n and r.startswith(a) and r.endswith(b) and len(a + b) <= len(r) for n, a, b in ends)) for _, r in done)


def test_viterbi_prefers_one_channel():
    spots = [[("a", 2.0), ("b", 2.5)], [("a", 2.0)], [("b", 0.1)]]
    score, picks = mojibake.best_path(spots)
    assert picks == [0, 0, -1] and score == pytest.approx(4.0 - mojibake.SWITCH)
    assert mojibake.best_path([]) == (0.0, []) and mojibake.best_path([[("a", 1.0)]]) == (0.0, [-1])


def test_long_runs_are_read_whole(spark):
    long = "漢" * 30_000 + " " + "&Atilde;&curren;" * 5_000 + " " + "1" * 100_000 + "A" * 30_000 + "&" * 3_000
    end = spoil(GOOD[0], "cp1252")
    df = spark.createDataFrame([(i, GOOD[i % 5]) for i in range(40)] + [(99, long + " " + end)] + [(k, "a" * k + "Ã©") for k in (198, 199, 200, 201, 399)], "id long, text string")
    back = {r.id: r.text for r in mojibake.restored(df, "id", "text").collect()}
    assert set(back) == {99, 198, 199, 200, 201, 399} and back[99].endswith(GOOD[0]) and len(back[99]) < len(long) + len(end)
    assert all(back[k] == "a" * k + "é" for k in back if k != 99)


def test_words_that_do_not_fit_are_not_put_in(spark):
    said = ["мир", "мир", "привет мир", "español", "über uber", "тест"] * 8
    odd = {100: ("пр�вет мир", "привет мир"), 101: ("пр��ет", "привет"), 102: ("м�р�к �", "м�р�к �"), 103: ("espa��ol", "español"), 104: ("���� ���", "���� ���"), 105: ("пр\u0440\ufffd", "пр\u0440\ufffd")}
    df = spark.createDataFrame(list(enumerate(said)) + [(k, v[0]) for k, v in odd.items()], "id long, text string")
    back = {r.id: (r.text, r.whole) for r in mojibake.restored(df, "id", "text").collect()}
    assert {k: v[0] for k, v in back.items()} == {k: v[1] for k, v in odd.items()}
    assert [back[k][1] for k in sorted(back)] == [True, True, False, True, False, False]


def test_several_lost_bytes_of_a_word(spark):
    word = "сессия"
    bad = "".join(bytes([b]).decode("cp1252", "replace") for b in word.encode())
    assert bad.count("�") == 4
    df = spark.createDataFrame([(i, f"наша {word} работает дома") for i in range(30)] + [(99, bad), (98, "ðŸ™‚ only here"), (97, "É°, Ø³ and x²y")], "id long, text string")
    back = {r.id: r.text for r in mojibake.restored(df, "id", "text").collect()}
    assert back[99] == word and back[98] == "🙂 only here" and 97 not in back


def test_planted_damage_is_restored(spark):
    import random

    random.seed(3)
    words = ["Größe", "schön", "für", "Änderung", "español", "añadida", "después", "été", "l’école", "naïve", "удалили", "проверок", "слиянием", "старый", "“done”", "isn’t", "café", "plain", "words", "here"]
    texts = {i: " ".join(random.choices(words, k=12)) for i in range(400)}
    ways = [lambda t: spoil(t, "cp1252"), lambda t: spoil(t, "latin-1"), lambda t: spoil(t, "mac_roman"), lambda t: spoil(t, "cp1252", 2), lambda t: spoil(t, "cp437"), lambda t: spoil(t, "cp1251"), lambda t: "".join(bytes([b]).decode("cp1252", "ignore") for b in t.encode())]
    bad = {i: ways[i % len(ways)](texts[i]) for i in range(0, 400, 8)}
    df = spark.createDataFrame(list((texts | bad).items()), "id long, text string")
    back = {r.id: r.text for r in mojibake.restored(df, "id", "text").collect()}
    assert set(back) == {i for i in bad if bad[i] != texts[i]}
    assert sum(back[i] == texts[i] for i in back) >= 0.9 * len(back)
