"""Nulls, empty tables, repeats, hot groups and clashing columns for every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import canonical, groups, language, leaks, names, neighbours, packing, pairs, spans

DOCS = "doc_id long, text string, h long, th int, item_id long"
ITEMS = "item_id long, question string, gold_answer string, context string, doc_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1) for i, t in rows], DOCS)


# --- 1 ---


def entities(spark, rows):
    return spark.createDataFrame([(i, n, t, "x", "y") for i, n, t in rows], "id string, name string, entity_type string, type string, words string")


def test_names_link_variants(spark):
    base = [f"{f} {line}" for f in ("Kelvorin", "Darmatesh", "Pilodrana", "Sumbekiro", "Trovachel", "Yandrupasi", "Molhatrube", "Brishokane") for line in ("Steel", "Cement", "Insurance")]
    given = [f"{g} {s}" for g in ("Venkatesh", "Madhavi", "Upendra") for s in ("Tarbolika", "Shendrupo", "Gromanithu", "Palverusa", "Chidromela", "Hastrukobi", "Nilvedrasho", "Wexbonaru")]
    rows = [(f"c{i}", n + " Ltd", "Company") for i, n in enumerate(base)] + [(f"p{i}", n, "Person") for i, n in enumerate(given)]
    rows += [("v1", "STEEL (KELVORIN) LIMITED", "Company"), ("v2", "Kelvroin Steel", "Company"), ("v3", "Kelvorin Insur.", "Company"), ("w1", "Tarbolika, Venky", "Person"), ("w2", "Mr. V. Tarbolika", "Person"), ("w3", "Tarbolika, Madhavi", "Person"), ("e1", "Kelvorin Steel", "Event"), ("o1", "Quindrabel Steel Ltd", "Company"), ("o2", "QUINDRABEL GROUP", "Company"), ("o3", "Darmatesh Group", "Company")]
    rows += [("c0", base[0] + " Ltd", "Company"), ("n1", None, "Company"), ("n2", "  ", "Person"), (None, "Kelvorin Steel", "Company"), ("t1", "Mr.", "Person"), ("t2", "Dr.", "Person")]
    found = {tuple(r) for r in names.same_entity_pairs(entities(spark, rows)).collect()}
    want = {("c0", "v1"), ("c0", "v2"), ("v1", "v2"), ("c2", "v3"), ("p0", "w1"), ("p0", "w2"), ("w1", "w2"), ("p8", "w3"), ("o1", "o2")}
    assert found == want


def test_names_empty(spark):
    assert names.same_entity_pairs(entities(spark, [])).count() == 0
    assert names.same_entity_pairs(entities(spark, [("a", "Solo", "Company")])).count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "acb", 1), ("abc", "abc", 0), ("kitten", "sitting", 3), ("ab", "", 2), ("abcd", "abxcd", 1)])
def test_typos(a, b, d):
    assert names.typos(a, b, 3) == d == names.typos(b, a, 3)


# --- 2 ---


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "id string, embedding array<float>, key int, cell int")


def brute_neighbours(rows, k, bound):
    import numpy as np

    own = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = set()
    for a, x in own.items():
        near = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), b) for b, y in own.items() if a != b)
        out |= {(a, b) for s, b in near[:k] if -s >= bound}
    return out


def test_neighbours_recall_and_bad_vectors(spark):
    r = random.Random(1)
    rows = []
    for c in range(12):
        centre = [r.gauss(0, 1) for _ in range(16)]
        rows += [(f"v{c:02d}{j:02d}", [x + r.gauss(0, 0.25) for x in centre]) for j in range(12)]
    same = [("d%d" % i, rows[0][1]) for i in range(8)]
    bad = [("z0", None), ("z1", [0.0] * 16), ("z2", [1.0] * 15), ("z3", [float("nan")] + [1.0] * 15), (None, [1.0] * 16)]
    found = {tuple(x) for x in neighbours.nearest(vectors(spark, rows + same + bad + rows[:5]), dim=16).select("id", "neighbour_id").collect()}
    want = brute_neighbours(rows + same, 5, 0.8)
    assert len(found & want) / len(want) >= 0.95 and len(found - want) <= len(want) * 0.05
    assert ("d7", "d0") in found and ("d7", "d6") not in found  # ties go to the smaller id
    split = {tuple(x) for x in neighbours.nearest(vectors(spark, rows + same), dim=16, block=7).select("id", "neighbour_id").collect()}
    assert split == found
    assert len({b for a, b in found if a == "d7"} & {"d0", "d1", "d2", "d3", "d4"}) == 5  # nine copies, the least five ids


def test_neighbours_of_a_vector_a_third_of_all_rows_have(spark):
    r = random.Random(5)
    rows = [(f"c{i:03d}", [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(f"e{i:03d}", [1.0, 2.0, 3.0, 4.0 + r.random() / 9]) for i in range(60)] + [(f"f{i:03d}", [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    found = {tuple(x) for x in neighbours.nearest(vectors(spark, rows), dim=4, miss=1e-6, block=16).select("id", "neighbour_id").collect()}
    want = brute_neighbours(rows, 5, 0.8)
    assert len(found & want) >= 0.98 * len(want) and len(found - want) <= 0.02 * len(want)
    assert {b for a, b in found if a == "c030"} == {f"c{i:03d}" for i in range(5)}


def test_neighbours_empty(spark):
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    assert neighbours.nearest(vectors(spark, [("a", [1.0] * 64)])).count() == 0


# --- 3 ---

WORDS = {"en": "the price of the share fell because the company said it will invest in new shops today".split(), "hi": "कंपनी ने कहा कि शेयर का भाव क्यों गिरा और नए कारखाने में निवेश करेगी".split(), "mr": "कंपनीने सांगितले की समभागाची किंमत का घसरली आणि नवीन कारखान्यात गुंतवणार आहे".split(), "ta": "நிறுவனம் புதிய தொழிற்சாலையில் முதலீடு செய்யும் என்று தெரிவித்தது".split()}


def test_language_segments(spark):
    r = random.Random(2)
    labelled = [(" ".join(r.choice(w) for _ in range(8)), lang) for lang, w in WORDS.items() for _ in range(60)]
    labelled += [(" ".join(r.choice(WORDS["en"]) for _ in range(8)), "ta")] * 2  # wrong labels
    model = language.fit(labelled)
    en, hi = " ".join(WORDS["en"][:9]), " ".join(WORDS["hi"][:9])
    rows = [(1, f"{en}. {hi}।", "x"), (2, en.upper() + "?", "x"), (3, None, "x"), (4, "", "x"), (5, "12.5 ... !!", "x"), (6, f"{hi}\n{hi} | {en}", "x"), (7, " ".join(WORDS["mr"][:9]), "x"), (7, " ".join(WORDS["mr"][:9]), "x")]
    df = spark.createDataFrame(rows, "request_id long, message string, seg_no string")
    got = [(x["request_id"], x["seg_no"], x["lang"]) for x in language.segments(df, model).collect()]
    assert sorted(got) == sorted([(1, 0, "mixed"), (1, 1, "en"), (1, 2, "hi"), (2, 0, "en"), (2, 1, "en"), (6, 0, "mixed"), (6, 1, "hi"), (6, 2, "en")] + [(7, 0, "mr"), (7, 1, "mr")] * 2)
    assert language.segments(df.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, (en + ". ") * 3000, "x")], df.schema)
    assert {x["lang"] for x in language.segments(long, model).collect()} == {"en"}


def test_probabilities_sum_to_one():
    import numpy as np

    texts = [(" abca ", 0), (" abba ", 0), (" cab ", 0)]
    m = language.train(texts, order=3)
    letters = sorted({c for t, _ in texts for c in t}) + ["?"]
    total = 0.0
    for c in letters:
        flat, starts = language._flat(["ab" + c], 2)
        h = m.cross_entropy(["ab" + c])[0, 0] * 3 - m.cross_entropy(["ab"])[0, 0] * 2
        total += np.exp(-h)
    assert abs(total - 1) < 1e-4


def test_corrected_labels_empty(spark):
    chats = spark.createDataFrame([], "request_id long, message string, lang string, detected_lang string, is_mixed boolean")
    rows = spark.createDataFrame([], "lang string, src string, tgt string")
    assert language.corrected_labels(chats, rows).count() == 0


# --- 4 ---


def test_pair_defects(spark):
    say = "कंपनी {} ने नए कारखाने में {} करोड़ रुपये का निवेश किया है।"
    rows = [(i, "hi", f"The company Ab{i} invested {i} crore rupees in a new factory.", say.format(f"Ab{i}", i), "f") for i in range(60)]
    src = "The company Zed invested 77 crore rupees in a new factory."
    odd = [
        (100, "hi", src, None, "empty"), (101, "hi", src, "   ", "empty"), (102, "hi", src, "N/A", "empty"), (103, "hi", src, "I'm sorry, but I can't translate this. " + src, "refusal"), (104, "hi", src, "Translation: " + src.upper(), "copied"),
        (105, "hi", src, "कंपनी Zed ने नए कारखाने में", "truncated"), (106, "hi", src, "Zed நிறுவனம் புதிய தொழிற்சாலையில் 77 கோடி முதலீடு செய்தது.", "wrong_language"), (107, "hi", src, say.format("Zed", 77)[:-1], None), (108, "hi", None, say.format("Zed", 77), None),
        (109, "hi", src, "Something else was reported by other people today.", "wrong_language"),
    ]
    df = spark.createDataFrame(rows + odd + odd[:1], "pair_id long, lang string, src string, tgt string, defect string")
    found = [(r["pair_id"], r["defect"]) for r in pairs.defective_pairs(df).collect()]
    assert dict(found) == {r[0]: r[4] for r in odd if r[4]} and len(found) == len(set(found)) + 1
    assert pairs.defective_pairs(df.limit(0)).count() == 0


def test_truncation_is_judged_by_more_than_known_endings(spark):
    say = ["कंपनी {} ने नए कारखाने में {} करोड़ रुपये का निवेश किया है।", "{} के शेयर आज {} प्रतिशत गिर गए हैं।", "सरकार ने {} पर कर {} प्रतिशत घटा दिया है।"]
    ask = ["The company {} invested {} crore rupees in a new factory.", "The shares of {} fell by {} percent today.", "The government cut the tax on {} by {} percent."]
    rows = [(i, "hi", ask[i % 3].format(f"Ab{i}", i + 10), say[i % 3].format(f"Ab{i}", i + 10)) for i in range(240)]
    odd = [
        (900, "hi", "The workers of Zed planted 77 trees near the factory.", "Zed के कर्मचारियों ने कारखाने के पास 77 पेड़ लगाए हैं।", None),  # an ending never seen
        (901, "hi", ask[0].format("Zed", 77), "कंपनी Zed ने नए कारखाने में ७७ करोड़ रुपये का निवेश किया है।", None),  # other digits
        (902, "hi", "Zed said it regrets the delay of 77 days.", "Zed ने कहा कि उसे 77 दिन की देरी पर खेद है।", None),  # reports a regret
        (903, "hi", ask[0].format("Zed", 77), "कंपनी Zed ने नए कारखाने में", "truncated"), (904, "hi", ask[1].format("Zed", 77), "Zed के शेयर आज...", "truncated"), (905, "hi", ask[1].format("Zed", 77), "खेद है, मैं इसका अनुवाद नहीं कर सकता।", "refusal"),
        (906, "hi", ask[1].format("Zed", 77), "Unfortunately I'm not able to complete this task.", "refusal"),
    ]
    df = spark.createDataFrame(rows + [r[:4] for r in odd], "pair_id long, lang string, src string, tgt string")
    assert {r["pair_id"]: r["defect"] for r in pairs.defective_pairs(df).collect()} == {r[0]: r[4] for r in odd if r[4]}


def many_pairs(spark, n, terse):
    say = ["कंपनी {} ने नए कारखाने में {} करोड़ रुपये का निवेश किया है।", "{} के शेयर आज {} प्रतिशत गिर गए हैं।", "सरकार ने {} पर कर {} प्रतिशत घटा दिया है।"]
    ask = ["The company {} invested {} crore rupees in a new factory.", "The shares of {} fell by {} percent today.", "The government cut the tax on {} by {} percent."]
    rows = [(i, "hi", ask[i % 3].format(f"Ab{i}", i + 10), say[i % 3].format(f"Ab{i}", i + 10)) for i in range(n)]
    # a language whose few answers are one word, unmarked, to long questions
    rows += [(n + k, "te", f"Could you please tell all of us in one short word what the board of directors decided on item {chr(97 + k // 26)}{chr(97 + k % 26)} of the long agenda", "".join(chr(0xC15 + k * m % 34) for m in (1, 3, 5, 7))) for k in terse]
    return spark.createDataFrame(rows, "pair_id long, lang string, src string, tgt string")


def test_truncation_is_fitted_on_all_pairs(spark):
    df = many_pairs(spark, 12000, (0, 2, 4, 6, 7, 8, 9, 10))  # none of these was in a sample of 4,000
    assert [tuple(r) for r in pairs.defective_pairs(df.repartition(5)).collect()] == []


def test_truncation_fit_agrees_with_one_in_memory(spark):
    df = many_pairs(spark, 500, range(30)).repartition(7)
    known, stopwords = pairs.corpus_words(df)
    langs = {"en": 0, "hi": 1, "te": 2}
    judged = pairs.judged_pairs(df, known, stopwords, langs)
    x = np.concatenate([np.frombuffer(bytes(r["x"]), "<f4").reshape(pairs.WIDTH, -1) for r in judged.where("x is not null").collect()], 1)
    assert x.shape[1] == 530
    model = pairs.fitted(judged, langs)
    assert np.allclose(model.length, [0, *(np.median(x[2 + pairs.RATIO, x[0] == k].astype(float)) for k in (1, 2)), 0])
    every = pairs.Model(langs, model.length)
    every.fit(lambda f: f(x))
    assert np.allclose(every.weights, model.weights, atol=1e-4) and abs(every.cut - model.cut) < 1e-4
    # one pair alone is judged as in the table
    known.model = model
    texts = [(r["pair_id"], r["lang"], r["src"], t) for r in df.orderBy("pair_id").limit(6).collect() for t in (r["tgt"], r["tgt"][:9])]
    x = pairs.judged_pairs(spark.createDataFrame(texts, df.schema).coalesce(1), known, stopwords, langs).collect()[0]["x"]
    broken = model.broken(np.frombuffer(bytes(x), "<f4").reshape(pairs.WIDTH, -1)).tolist()
    assert [pairs.defect(src, tgt, lang, known, pairs._automaton(), stopwords)[0] for _, lang, src, tgt in texts] == ["truncated" if b else None for b in broken] and any(broken)


@pytest.mark.parametrize("seed", range(5))
def test_suffix_automaton(seed):
    r = random.Random(seed)
    a, b = ("".join(r.choice("ab") for _ in range(30)) for _ in range(2))
    covered = {k for i in range(30) for j in range(i + 4, 31) if b[i:j] in a for k in range(i, j)}
    assert pairs.SuffixAutomaton(a).copied(b, 4) == len(covered)
    assert pairs.SuffixAutomaton("").copied("abc", 1) == 0


# --- 5 ---

EDGE = "edge_no long, source string, target string, predicate string, name string, custom string, h1 long, copy_no long"


def edges(spark, rows):
    return spark.createDataFrame([(i, *r, 0, 0) for i, r in rows], EDGE)


VARIANTS = [
    ("E1", "E2", "LED_BY", "rose 1.5 percent", '{"a": "x", "b": "-2"}'),
    (" e1 ", "E2", "led by", "ROSE  1.5 percent!", '{"b":"-2","A":"X "}'),
    ("E1", "e2", "LedBy.", "rose 1.5_percent", '{\n "a": "x",\n "b": "-2"\n}'),
]
OTHERS = [("E1", "E2", "LED_BY", "rose 15 percent", '{"a": "x", "b": "-2"}'), ("E1", "E2", "LED_BY", "rose 1.5 percent", '{"a": "x", "b": "2"}'), ("E1", "E2", "LED_BY", "rose -1.5 percent", '{"a": "x", "b": "-2"}'), (None, "E2", None, None, None), ("E1", "E2", "LED_BY", "rose 1.5 percent", '{"a": "-2", "b": "x"}')]


def test_collapse(spark):
    rows = list(enumerate(VARIANTS + OTHERS + [(" ", "E2", "", "", "")], 1))
    rows += [(20, ("É1", "x", "Über", "naïve—x", '{"k\\"": "v"}')), (21, ("é1", "x", "über ", "naïve x", '{ "K\\"" : "V" }')), (22, ("E1", "E2", "p", "t" * 50_000, "not json")), (23, ("E1", "E2", "P", "T" * 50_000 + "!", "NOT, json"))]
    want = {(1, 2), (1, 3), (7, 9), (20, 21), (22, 23)}
    for options in ({}, {"hash_bits": 2, "salt_rows": 2}):
        assert {tuple(r) for r in canonical.collapse(edges(spark, rows + rows[:2]), **options).collect()} == want
    assert canonical.collapse(edges(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_hashes_follow_the_canonical_form(seed):
    r = random.Random(seed)
    junk = ["", " ", "_", ".", ",", "-", " ", "!", "  ", "é", '"', "1", "2"]
    text = lambda: "".join(r.choice(["a", "B", "7", "0", *junk]) for _ in range(r.randint(0, 6)))
    rows = [(text(), text(), text(), text(), r.choice(['{"a": "%s", "b": "%s"}' % (r.choice("xX1"), r.choice(["-1", "1", "y"])), '{"b":"%s"}' % r.choice("yY"), text(), None])) for _ in range(400)]
    a, b = canonical.row_hashes([list(c) for c in zip(*rows)])
    by_hash, by_form = {}, {}
    for i, row in enumerate(rows):
        by_hash.setdefault((a[i], b[i]), []).append(i)
        by_form.setdefault(canonical.canonical(row), []).append(i)
    assert sorted(by_hash.values()) == sorted(by_form.values())
    for i in range(0, 400, 7):
        for j in range(0, 400, 11):
            assert canonical.same_row(rows[i], rows[j]) == (canonical.canonical(rows[i]) == canonical.canonical(rows[j]))


def test_collapse_folds_and_compares_alike(spark):
    words = ["Straße", "STRASSE", "strasse", "ﬁne", "FINE", "İstanbul", "i̇stanbul", "ΣΊΣΥΦΟΣ", "σίσυφος", "１.5", "1.5", "−2", "-2", "a-b", "ab"]
    rows = [(i, ("E1", "E2", w, "n", None)) for i, w in enumerate(words, 1)]
    forms = {}
    for i, row in rows:
        forms.setdefault(canonical.canonical(row), []).append(i)
    want = {(g[0], c) for g in forms.values() for c in g[1:]}
    assert {(1, 2), (1, 3), (4, 5)} <= want
    for options in ({}, {"hash_bits": 2, "salt_rows": 2}):
        assert {tuple(r) for r in canonical.collapse(edges(spark, rows), **options).collect()} == want
    for x in words:
        for y in words:
            assert canonical.same_text(x, y) == (canonical.fold(x) == canonical.fold(y))


# --- 6 ---


def test_groups(spark):
    r = random.Random(3)
    ids = [f"m{i:04d}" for i in range(400)]
    r.shuffle(ids)
    rows = list(zip(ids, ids[1:])) + [("hub", f"s{i}") for i in range(300)] + [("z", "z"), (None, "q"), ("q", None), ("hub", "s1"), ("s1", "hub")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "left_id string, right_id string, label string")
    got = {}
    for g, m in groups.linked_groups(df).collect():
        assert m not in got
        got[m] = g
    assert {got[i] for i in ids} == {"m0000"} and {v for k, v in got.items() if k[0] in "hs"} == {"hub"} and got["z"] == "z" and "q" not in got
    assert groups.linked_groups(df.limit(0)).count() == 0


# --- 8 ---


def check_packed(rows, capacity):
    places = {}
    for r in rows:
        if r["container_id"] is not None:
            places.setdefault(r["container_id"], []).append((r["container_start"], r["n_tokens"]))
    for p in places.values():
        p.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(p, p[1:])) and p[-1][0] + p[-1][1] <= capacity
    return places


def test_packing(spark):
    r = random.Random(4)
    texts = [(i, " ".join("word" for _ in range(r.choice([1, 3, 20, 60, 90, 130, 300])))) for i in range(400)] + [(900, None), (901, ""), (902, "tiny"), (902, "tiny")]
    df = docs(spark, texts).repartition(5)
    rows = packing.pack(df, 64, (64, 32, 16), step_containers=10).collect()
    check_packed(rows, 64)
    want = {row["doc_id"]: row["n"] for row in packing.sized(df, 64, packing.TOKENIZER).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    total = {}
    for row in rows:
        total[row["doc_id"]] = total.get(row["doc_id"], 0) + row["n_tokens"]
        assert row["n_tokens"] <= 64
    assert total == want
    assert {row["piece"] for row in rows if want[row["doc_id"]] <= 64} == {0}
    assert [row["container_id"] for row in rows if row["doc_id"] in (900, 901)] == [None, None]
    report = packing.fill_report(spark.createDataFrame(rows, packing.pack(df, 64, (64, 32, 16)).schema), 64).first()
    assert report["over_capacity"] == 0 and report["fill"] > 0.95
    assert packing.pack(df.limit(0), 64, (64, 32)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_uses_every_piece(seed):
    r = random.Random(seed)
    cap = r.choice([16, 100, 2048])
    sizes = {r.randint(1, cap): r.choice([1, 2, 7, 10**9]) for _ in range(r.randint(1, 50))}
    used = {}
    for n, windows in packing.plan(sizes, cap, (cap, cap // 2, cap // 4)):
        assert n > 0 and sum(k * w for k, w, _ in windows) <= cap
        for k, w, inside in windows:
            assert sum(s * per for s, per in inside) <= w
            for s, per in inside:
                used[s] = used.get(s, 0) + n * k * per
    assert used == sizes


def test_tiers_change_the_plan():
    sizes = {1500: 40, 900: 60, 500: 100, 300: 300, 100: 2000, 30: 4000, 7: 5000}
    tiers, plain = (packing.plan(sizes, 2048, t) for t in ((2048, 1024, 512, 256), (2048,)))
    assert tiers != plain
    lengths = {w for _, windows in tiers for _, w, _ in windows}
    assert {2048, 1024, 512} <= lengths
    # a window of a tier is opened by its own pieces and filled by shorter tiers' only
    for _, windows in tiers:
        for _, w, inside in windows:
            if w < 2048:
                assert inside[0][0] > (w // 2 if w > 256 else 0) and all(s <= w // 2 for s, _ in inside[1:])
    need = sum(s * n for s, n in sizes.items()) / 2048
    assert sum(n for n, _ in tiers) <= need * 1.02 + 1


def test_packing_invariants(spark):
    r = random.Random(6)
    texts = [(i, " ".join("word" for _ in range(r.choice([1, 3, 20, 60, 90, 130, 300])))) for i in range(300)] + [(900, None), (901, "")]
    row = packing.invariants(docs(spark, texts), 64, tiers=(64, 32, 16), step_containers=10).first().asDict()
    assert row.pop("texts") == 302 and set(row.values()) == {0}
    assert set(packing.invariants(docs(spark, texts).limit(0), 64, tiers=(64, 32)).first()) == {0}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_tokenizers(name):
    count = packing.encoder("/opt/tokenizers/" + name)
    assert count("") == 0 and count("hello world") >= 2


# --- 9 ---


def brute_leaks(texts, items, n=10):
    grams = {}
    for i, *fields in items:
        for f in fields[:3]:
            w = leaks.words(f)
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in texts:
        w = leaks.words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    word = lambda: r.choice("aa bb cc dd ee 12 ff".split())
    items = [(i, " ".join(word() for _ in range(r.randint(5, 14))), None if i % 3 else "", " ".join(word() for _ in range(20)), 0) for i in range(12)]
    texts = [(d, None if d % 11 == 0 else "" if d % 11 == 1 else " ".join(word() for _ in range(r.randint(5, 200)))) for d in range(60)]
    texts += [(100, "x " * 30_000 + (items[0][3] or "").upper().replace(" ", "-- ") + " y" * 10), (100, "x"), (101, items[1][3] + " " + items[2][3])]
    df, it = docs(spark, texts), spark.createDataFrame(items, ITEMS)
    want = brute_leaks(texts, items)
    assert (100, 0) in want
    assert {tuple(x) for x in leaks.leaked_items(df, it).collect()} == want
    found = leaks.find_leaks(df, it, block_words=60)
    assert {(x["doc_id"], x["item_id"]) for x in found.where("exact_run >= 10").collect()} == want
    assert leaks.leaked_items(df.limit(0), it).count() == 0 and leaks.leaked_items(df, it.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "size", "blank"), [(300, 40, False), (1000, 160, False), (300, 60, True)])
def test_leaks_of_fields_longer_than_documents(spark, n, size, blank):
    field = [f"w{k}" for k in range(n)]
    texts = [(d, "" if blank and d % 2 else " ".join(f"d{d}x{k}" for k in range(size))) for d in range(40)]
    texts[20] = (20, " ".join([f"d20x{k}" for k in range(size - 15)] + field[:15]))
    texts[26] = (26, " ".join(field[-15:] + [f"d26x{k}" for k in range(size - 15)]))
    items = [(1, None, None, " ".join(field), 0)]
    want = brute_leaks(texts, items)
    assert want == {(20, 1), (26, 1)}
    df = docs(spark, texts).coalesce(1)
    assert {tuple(x) for x in leaks.leaked_items(df, spark.createDataFrame(items, ITEMS)).collect()} == want


def test_leaks_tolerate_substitutions(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    changed = passage.replace("four ", "4 ").replace("eleven", "11")
    it = spark.createDataFrame([(1, passage, None, None, 0)], ITEMS)
    row = leaks.find_leaks(docs(spark, [(1, "before " + changed + " after")]), it).first()
    assert (row["n_words"], row["n_substituted"], row["doc_start"]) == (15, 2, 1) and row["exact_run"] < 10


@pytest.mark.parametrize("n", [10, 11, 12, 15])
def test_seeds_hit_every_overlap_with_two_substitutions(n):
    words = [f"w{i}" for i in range(n)]
    index = leaks.TestIndex([(1, " ".join(words), None, None)])
    for i in range(1, n - 1):
        for j in range(i, n - 1):
            if j != i + 1:
                changed = ["x" if k in (i, j) else w for k, w in enumerate(words)]
                rows = leaks.scan_texts(index, [7], ["w3 w4 before " + " ".join(changed) + " after"], n, 2)
                assert [(r[0], r[1], r[4], r[5]) for r in rows] == [(7, 1, n, 1 + (i != j))]


# --- 4, copies ---


@pytest.mark.parametrize(("src", "tgt", "want"), [
    ("is it the one?", "is it the one?", "copied"), ("Gold Up", "Gold Up", "copied"), ("RBI", "आज RBI ने ब्याज दर में कोई बदलाव नहीं किया", None),
    ("Infosys Limited Posts Record Quarterly Profit", "यह रहा उत्तर और इसका अनुवाद है: Infosys Limited Posts Record Quarterly Profit", "copied"), ("Infosys Limited Posts Record Quarterly Profit", "Infosys Limited ने रिकॉर्ड तिमाही लाभ दर्ज किया है", None), ("What did Lachinonu Infrastructure announce this week?", "Lachinonu Infrastructure ने इस हफ्ते क्या घोषणा की?", None),
])
def test_pairs_copy_short_and_headline_prompts(src, tgt, want):
    assert pairs.defect(src, tgt, "hi", {}, pairs._automaton())[0] == want


# --- 10 ---


def brute_shared(texts, length):
    grams = {}
    for d, t in texts:
        for i in range(len(t or "") - length + 1):
            grams.setdefault(t[i : i + length], set()).add(d)
    out = {}
    for d, t in texts:
        hit = {k for i in range(len(t or "") - length + 1) if len(grams[t[i : i + length]]) > 1 for k in range(i, i + length)}
        if hit:
            out[d] = max(out.get(d, 0), len(hit))
    return out


@pytest.mark.parametrize("options", [{}, {"group_cap": 1}, {"shard_chars": 50}])
def test_spans_equal_brute_force(spark, options):
    r = random.Random(6)
    rand = lambda n: "".join(r.choice("abcdé़ 😀") for _ in range(n))
    shared = [rand(n) for n in (23, 24, 25, 60, 200)]
    texts = [(d, None if d % 9 == 0 else rand(r.randint(0, 40)) + r.choice(shared)[r.randint(0, 3) :] + rand(r.randint(0, 30)) + r.choice(shared)) for d in range(40)]
    texts += [(100, "a" * 90), (101, "b" + "a" * 70), (102, texts[1][1]), (103, ""), (104, rand(300) * 2)]
    texts.append(texts[5])
    got = {x["doc_id"]: x["shared_chars"] for x in spans.shared_chars(docs(spark, texts), 24, k=8, **options).collect()}
    assert got == brute_shared(texts, 24)


@pytest.mark.parametrize("options", [{}, {"group_cap": 1}, {"shard_chars": 50}])
def test_spans_of_passages_a_document_repeats(spark, options):
    r = random.Random(8)
    rand = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage, other = rand(120), rand(120)
    texts = [(1, rand(50) + passage + rand(50) + passage + rand(50)), (2, rand(50) + passage[45:75] + rand(50))]
    texts += [(3, rand(30) + other + rand(30)), (3, rand(60) + other + other), (4, rand(50) + other[40:80] + rand(50)), (4, rand(9)), (5, "ab" * 40), (6, "c" + "ab" * 15)]
    want = brute_shared(texts, 24)
    assert want[1] >= 60 and want[3] >= 80
    assert {x["doc_id"]: x["shared_chars"] for x in spans.shared_chars(docs(spark, texts), 24, k=8, **options).collect()} == want


def test_spans_of_long_and_no_texts(spark):
    assert spans.shared_chars(docs(spark, [])).count() == 0
    assert spans.shared_chars(docs(spark, [(1, "short"), (2, None)])).count() == 0
    r = random.Random(7)
    long = "".join(r.choice("abcdefgh") for _ in range(1_300_000))
    got = {x["doc_id"]: x["shared_chars"] for x in spans.shared_chars(docs(spark, [(1, long), (2, long[700_000:701_000]), (3, long[523_900:524_700])])).collect()}
    assert got == {1: 1800, 2: 1000, 3: 800}

