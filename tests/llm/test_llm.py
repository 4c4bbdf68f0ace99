"""Training-data operators on small literal tables and, where there is one, against brute force on the smallest test tables."""

import itertools
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.llm import common, confusables, consensus, grouping, history, language, mixing, overlap, packing, pairs, subjects, tokens, wordsets
from lodestone.llm.confusables import canonical

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1
@pytest.mark.parametrize("a, b, same", [
    ("ｆｕｌｌ　width", "full width", True), ("café", "café", True), ("раypal", "paypal", True), ("ﬁne", "fine", True), ("a​b­c", "abc", True), ("x y", "x y", True),
    ("well‑known", "well-known", True), ("Ёлка", "Ёлка", True), ("cобака", "собака", True), ("ЅОЅ", "SOS", True), ("ё", "ë", True),
    ("Full", "full", False), ("cafe", "café", False), ("x²", "x2", False), ("a.b", "a,b", False), ("x  y", "x y", False), ("собака", "co6aka", False), ("", " ", False),
])
def test_look_alikes(a, b, same):
    assert (canonical(a) == canonical(b)) is same


def test_published_look_alikes(spark):
    confusables.prepare(spark)
    for x, y in (("ⲟne", "one"), ("ꓐank", "Bank"), ("Ьank", "bank"), ("ꮃest", "west"), ("paypaⅼ", "paypal"), ("ցood", "good"), ("ⲟⲣⲥ", "opc"), ("ᏔᎬᏚᎢ", "WEST")):
        assert canonical(x) == canonical(y), (x, canonical(x))
    for x, y in (("l", "I"), ("rn", "m"), ("0", "O"), ("1", "l"), ("κаt", "kat"), ("かな", "カナ"), ("а1", "a l")):
        assert canonical(x) != canonical(y)
    assert canonical("Вот гора и ось, он пьёт сок") == "Вот гора и ось, он пьёт сок" and canonical("東京タワーへ行く") == "東京タワーへ行く"
    assert [r[0] for r in spark.createDataFrame([("ꓐank",), (None,), ("",)], "t string").select(confusables.canonical_text(F.col("t"))).collect()] == ["Bank", None, ""]


def test_mixed_tokens_take_the_settled_script():
    assert canonical("Она сказала: cобака и со мной") == "Она сказала: собака и со мной"
    assert canonical("the раypal со account") == "the paypal co account"
    assert canonical(None) is None and canonical("") == ""
    assert [k for _, k, _ in confusables.tokens_report("раypal сор plain")] == ["mixed", "whole"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcоеaсhнzйé́​ １ﬁ-‑", max_size=30))
def test_canonical_form_is_stable(t):
    assert canonical(canonical(t)) == canonical(t)


def test_pairs_of_copies_need_no_comparison(spark):
    s = spark.createDataFrame([(i, "abc") for i in range(50)] + [(99, "аbc"), (100, None), (101, ""), (102, "​")], "sample_no long, text string")
    k = confusables.keyed_forms(s, "sample_no", "text")
    got = confusables.look_alike_pairs(k, k, []).where("key_a < key_b")
    assert rows(got) == sorted([(i, 99) for i in range(50)] + [(101, 102)], key=str)


# shared
def test_keys_and_records(spark):
    df = spark.createDataFrame([(1, " ABC ", "SHA256:" + "a" * 64, "hexal/Tolva-2", "Dev"), (2, "abc\n", "0" * 64, " tolva-2 ", "n/a"), (3, None, common.EMPTY_HASH.upper(), None, None), (4, None, " ", "", "TRAIN")], "sample_no long, id string, f string, m string, s string")
    got = df.select(common.hash_key(F.col("f")), common.model_key(F.col("m")), common.split_key(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("a" * 64, "tolva-2", "val"), (None, "tolva-2", None), (None, None, None), (None, None, "train")]
    assert [r[0] for r in common.records(df.select("sample_no", "id")).orderBy("sample_no").collect()] == [1, 3, 4]


def multiset(t):
    return Counter(re.findall(r"\w+", canonical(t).lower()))


def near(a, b):
    n, m, o = sum(a.values()), sum(b.values()), sum((a & b).values())
    return n and m and 9 * o >= 4 * (n + m)


def varied(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
    return " ".join(w)


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 20, 30, 60, 120]))]
        out += [" ".join(w), varied(rng, w, max(1, len(w) // 12)), varied(rng, w, max(1, len(w) // 4))]
    return [*out, out[0], "", None, "...", out[5].upper()]


# 2
def test_overlap_is_brute_force(spark):
    t = corpus()
    split = ["train", "Val", "TEST", "training", None, "dev "]
    data = [(i, x, split[(i * 7) % 6], "s", 1) for i, x in enumerate(t)]
    df = spark.createDataFrame(data, "sample_no long, text string, split string, source string, key int")
    side = [None if s is None else "t" if s.lower().startswith("train") else "o" for s in (r[2] for r in data)]
    m = [multiset(x) if x else Counter() for x in t]
    want = {(i, j) for i, j in itertools.combinations(range(len(t)), 2) if side[i] and side[j] and side[i] != side[j] and near(m[i], m[j])}
    got = overlap.cross_split_overlaps(df)
    assert {(r["a"], r["b"]) for r in got.collect()} == want and len(want) > 10
    rep = overlap.overlap_report(got, df)
    assert sum(r["n_pairs"] for r in rep.collect()) == len(want)
    assert overlap.cross_split_overlaps(df.limit(0)).count() == 0


def test_sketch_bounds_never_drop_a_near_copy():
    rng = random.Random(3)
    for _ in range(300):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))]
        a, b = " ".join(w), varied(rng, w, rng.randrange(0, 1 + len(w) // 8))
        s = wordsets.Sketch([a, b])
        if near(multiset(a), multiset(b)):
            n, m = map(int, s.n)
            assert 5 * min(n, m) >= 4 * max(n, m)
            for x in (s.bits, s.more):
                assert 9 * bin(int(x[0] ^ x[1]) & (2**64 - 1)).count("1") <= n + m


# 3
def test_consensus_follows_the_reliable(spark):
    rng = random.Random(7)
    classes = ["a", "b", "c"]
    truth = {f"i{i}": rng.choice(classes) for i in range(400)}
    skill = {**{f"good{i}": 0.95 for i in range(3)}, **{f"bad{i}": 0.35 for i in range(5)}, "rare": 0.95}
    data = []
    for item, c in truth.items():
        for w, p in skill.items():
            if rng.random() < (0.05 if w == "rare" else 0.7):
                data.append((item, w, c if rng.random() < p else rng.choice([x for x in classes if x != c])))
    labels = spark.createDataFrame(data, "item string, worker string, label string")
    model, items = consensus.fit(labels)
    got = {r["item"]: r["label"] for r in consensus.consensus(model, items).collect()}
    votes = defaultdict(Counter)
    for i, _, c in data:
        votes[i][c] += 1
    right = sum(got[i] == truth[i] for i in got) / len(got)
    majority = sum(votes[i].most_common(1)[0][0] == truth[i] for i in got) / len(got)
    assert right > majority + 0.03 and right > 0.9
    r = {x["worker"]: x["reliability"] for x in consensus.reliabilities(model, labels).collect()}
    assert min(r["good0"], r["good1"], r["rare"]) > 0.7 > max(r[f"bad{i}"] for i in range(5))


def test_weight_of_an_annotator_in_its_types():
    """A busy annotator's type isn't its record alone, which however stays its own."""
    flat = np.concatenate([np.array([[900.0, 100.0], [100.0, 900.0]]).T.ravel(), np.array([[9.0, 1.0], [1.0, 9.0]]).T.ravel(), [1010.0, 1010.0]])
    small, large = (consensus.Community(["a", "b"], ["x", "y"], 1, weight=w) for w in (100.0, 1e9))
    for m in (small, large):
        m.update(flat)
    assert (small.shared.sum() - large.shared.sum()) < -1500 and np.allclose(small.matrix[0], large.matrix[0], atol=0.01)


def test_labels_latest_and_empty(spark):
    df = spark.createDataFrame([("x", "m", "a", 1.0, 1), ("x", "m", "b", 2.0, 2), ("x", "m", None, 3.0, 3), (None, "m", "a", 1.0, 4), ("x", "n", "c", 1.0, 5), ("x", "n", "d", 1.0, 6)], "i string, w string, l string, t double, n long")
    lab = consensus.latest_labels(df, F.col("i"), F.col("w"), F.col("l"), F.col("t"), F.col("n"))
    assert rows(lab) == [("x", "m", "b"), ("x", "n", "d")]
    assert consensus.consensus(*consensus.fit(lab.limit(0))).count() == 0
    assert abs(consensus.digamma(np.array(1.0)) + 0.5772156649) < 1e-9


# 4
def test_components_and_splits(spark):
    rng = random.Random(2)
    n = 400
    data = [(i, None if rng.random() < 0.4 else f"f{rng.randrange(150)}", None if rng.random() < 0.7 else f"c{rng.randrange(60)}" if i % 3 else "hot", rng.choice(["x", "y", None])) for i in range(n)]
    df = spark.createDataFrame(data, "id long, f string, c string, label string")
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, f, c, _ in data:
        for k in (("f", f), ("c", c)):
            if k[1] is not None:
                a, b = find(i), find(seen.setdefault(k, i))
                parent[max(a, b)] = min(a, b)
    size = Counter(find(i) for i in range(n))
    got = {r["node"]: r["component"] for r in grouping.related(df, "id", [F.col("f"), F.col("c")]).collect()}
    assert got == {i: find(i) for i in range(n) if size[find(i)] > 1}
    group = spark.createDataFrame([(i, find(i), data[i][3]) for i in range(n)], "id long, component long, label string")
    out = grouping.grouped_splits(group, [("train", 0.8), ("val", 0.1), ("test", 0.1)]).collect()
    assert len(out) == n and all(len({r["split"] for r in out if r["component"] == c}) == 1 for c in size)
    small = [r for r in out if size[r["component"]] == 1]
    assert len({r["split"] for r in small}) == 3
    assert grouping.grouped_splits(group.limit(0), [("train", 1.0)]).count() == 0


def test_equal_components_are_placed_as_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        need = [[rng.randrange(0, 40), rng.randrange(0, 40)] for _ in range(3)]
        v, m = [rng.randrange(1, 4), rng.randrange(3)], rng.randrange(1, 30)
        want, left = [0] * 3, [list(x) for x in need]
        for _ in range(m):
            s = max(range(3), key=lambda s: (left[s][0], -s))
            want[s] += 1
            left[s] = [a - b for a, b in zip(left[s], v)]
        got = grouping._allotted(need, 0, v, m)
        assert sum(got) == m and max(abs(a - b) for a, b in zip(got, want)) <= 1, (need, v, m, got, want)


def test_small_components_are_stratified_by_their_labels(spark):
    """Pairs of labels, a rare one and few vectors: each split has its share of each label, however vectors are rounded."""
    rng = random.Random(6)
    data, n = [], 0
    for c in range(3000):
        for label in rng.choices(["a", "b", "c", "rare"], [10, 6, 3, 0.3], k=rng.choice([1, 2, 2, 3, 9])):
            data.append((n, c, label))
            n += 1
    df = spark.createDataFrame(data, "id long, component long, label string")
    share = {"train": 0.8, "val": 0.1, "test": 0.1}
    for most in (50_000, 20):
        out = grouping.grouped_splits(df, list(share.items()), most).collect()
        assert len(out) == n and all(len({r["split"] for r in g}) == 1 for _, g in itertools.groupby(sorted(out, key=lambda r: r["component"]), key=lambda r: r["component"]))
        total, got = Counter(r["label"] for r in out), Counter((r["label"], r["split"]) for r in out)
        for (x, s), k in got.items():
            assert abs(k - share[s] * total[x]) <= max(4, 0.02 * total[x]), (x, s, k, total[x])


def test_splits_do_not_depend_on_how_many_label_vectors_there_are(spark):
    """Each vector is planned as it is, in the order of the labels' turns, as a plan made in one list has it."""
    rng = random.Random(7)
    data = [(c, x) for c in range(600) for x in rng.choices(["a", "b", "c", "rare"], [10, 6, 3, 0.3], k=rng.choice([1, 2, 3, 9, 30]))]
    targets, labels = [("train", 0.8), ("val", 0.1), ("test", 0.1)], sorted("abc") + ["rare"]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "id long, component long, label string")
    got = [{r["component"]: r["split"] for r in grouping.grouped_splits(df, targets, most).collect()} for most in (20, 50_000)]
    assert got[0] == got[1] and len(got[0]) == 600
    count = Counter(data)
    vector = {c: tuple(count[c, x] for x in labels) for c in range(600)}
    kinds, total = Counter(vector.values()), [sum(v[i] for v in vector.values()) for i in range(4)]
    assert len(kinds) > 100
    place = Counter((vector[c], s) for c, s in got[0].items())
    need, waiting = [[s * x for x in total] for _, s in targets], set(kinds)
    mixed = {tuple(r["v"]): r["h"] for r in spark.createDataFrame([(list(k),) for k in kinds], "v array<long>").select("v", F.xxhash64(*[F.col("v")[i] for i in sorted(range(4), key=lambda i: (total[i], labels[i]))]).alias("h")).collect()}
    while waiting:
        out = [sum(v[i] * kinds[v] for v in waiting) for i in range(4)]
        i = min((i for i in range(4) if out[i]), key=lambda i: (out[i], total[i], labels[i]))
        for v in sorted((v for v in waiting if v[i]), key=lambda v: (-sum(v), mixed[v])):
            n = grouping._allotted(need, i, list(v), kinds[v])
            need = [[a - k * b for a, b in zip(x, v)] for x, k in zip(need, n)]
            assert [place[v, s] for s, _ in targets] == n, v
            waiting.remove(v)


def test_long_chain_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r["component"] for r in grouping.connected(e).collect()} == {0}


# 5
EN = ["The committee will open the archive and read every report before the meeting.", "Please send the copied notes to the other office tomorrow morning.", "Nobody asked why these three letters were never answered."]
DE = ["Der Ausschuss wird das Archiv öffnen und jeden Bericht vor der Sitzung lesen.", "Bitte schicke die kopierten Notizen morgen früh an das andere Büro.", "Niemand fragte, warum diese drei Briefe nie beantwortet wurden."]
FR = ["Le comité ouvrira les archives et lira chaque rapport avant la réunion.", "Merci d'envoyer les notes copiées à l'autre bureau demain matin.", "Personne n'a demandé pourquoi ces trois lettres sont restées sans réponse."]


def test_languages_and_segments(spark):
    model = language.LanguageModel.train([(" ".join(x), lang) for lang, x in (("en", EN), ("de", DE), ("fr", FR)) for _ in range(4)] + [(" ".join(DE), "en")])
    texts = [(1, EN[0], "English"), (2, DE[0] + " " + DE[2], "en-GB"), (3, EN[0] + " " + EN[1] + " " + FR[0] + "\n" + EN[2], "en"), (4, "", None), (5, None, "de"), (6, "12345 !!", "en"), (7, FR[1], "??")]
    df = spark.createDataFrame(texts, "id long, t string, l string")
    got = [(r["id"], r["segment_no"], r["lang"]) for r in language.segments(df, "id", "t", model).orderBy("id", "segment_no").collect()]
    assert got == [(1, 0, "en"), (2, 0, "de"), (3, 0, "en"), (3, 1, "fr"), (3, 2, "en"), (4, 0, None), (5, 0, None), (6, 0, None), (7, 0, "fr")]
    wrong = language.relabelled(df, "id", "t", "l", model)
    assert sorted({r["id"] for r in wrong.collect()}) == [2, 3, 7]
    codes = spark.createDataFrame([("de_AT",), (" Deutsch ",), ("und",), ("klingon",), (None,)], "l string").select(language.language_code(F.col("l")))
    assert [r[0] for r in codes.collect()] == ["de", "de", None, None, None]


def test_rare_languages_stay_and_unknown_ones_are_named():
    rng = random.Random(1)
    rows_ = [(" ".join(rng.sample(x, 2)), lang) for lang, x in (("en", EN), ("de", DE)) for _ in range(300)]
    ru = ["Комиссия откроет архив и прочитает каждый отчёт.", "Пожалуйста, отправь записи в другой отдел завтра утром.", "Никто не спросил, почему эти письма остались без ответа."]
    rows_ += [(" ".join(rng.sample(ru, 2)), "ru") for _ in range(2)] + [(EN[0] + " " + EN[1], "nl"), (EN[2], "nl")]
    model = language.LanguageModel.train(rows_)
    assert model.langs == ["de", "en", "ru"]  # the two texts labelled nl are English
    got = [x[0][:2] for x in model.texts([ru[0], "世界の言葉はとても多いのです。", "12 3"])]
    assert got[0][0] == "ru" and got[1] == ("und", 0.0) and got[2] == (None, 0.0)


# 6
def copied(prompt, response):
    return pairs.is_copy(pairs.Prompt(prompt), response, pairs.masked(response))


def test_defect_parts():
    assert all(pairs.is_empty(x) for x in (None, "", " \n", "N/A", "(no response)", "[empty]", "-", "\u200b", "-" * 300))
    assert not pairs.is_empty("No.") and not pairs.is_empty("None of the rows match.")
    p = "Copy the shared folder index into the comment field and publish it before noon. Then rename the old plan."
    assert copied(p, p.upper()) and copied(p, "> " + p) and copied(p, f"You wrote: {p} {p}")
    assert not copied(p, "You asked to copy the shared folder index. I counted forty rows instead and found nothing odd in any of them.") and not copied(None, p)
    assert copied("Send the file today", "send the file today!") and copied("Stop", "Stop") and not copied("Send the file today", "Sent.") and not copied("1234", "5678") and not copied(p, "the comment field")
    assert pairs.last_open('{"a": "b') is True and pairs.last_open('{"a": "b"}') is False and pairs.last_open("Nine points.") is False and pairs.last_open("One. Nine points in the") == "Nine points in the"
    assert pairs.last_open("See:\n```\nx = 1\nfor") is True and pairs.last_open("See:\n```\nx = 1\n```") is False
    assert pairs.asked("Do it now. Please answer in French.") == {"fr"} and pairs.asked("Bitte antworte auf Russisch.") == {"ru"} and pairs.asked("") == set()
    assert pairs.masked("Ask file_12, it's Über-klar (v2) x") == ["ask", "#", "it's", "über", "klar", "#", "x"]


def test_openings_cluster_as_the_pipeline_cuts_them(spark):
    def cut(x):
        return pairs.opening(pairs.split_sentences(x))

    base, other = cut("I regret that this request is one that I will not help with. Ever."), cut("I regret that your request is one that I will not help with.")
    op = spark.createDataFrame([(base, True), (other, True), (other, False), ("something else entirely", False), ("short", True)], "opening string, short boolean")
    got = {r["opening"]: r["cluster"] for r in pairs.clusters(op).collect()}
    assert got == {base: base, other: base, "something else entirely": "something else entirely", "short": "short"} and len(base.split()) == pairs.OPENING


def test_links_of_openings_are_found_and_nothing_else(spark):
    """Recall of links of at least SIMILAR against brute force, openings cut as the pipeline cuts them."""
    rng = random.Random(3)
    base = [rng.choices("abcdefghijklmnopqrstuvwxyz", k=14) for _ in range(60)]
    said = []
    for w in base:
        for _ in range(6):
            x = list(w)[: rng.choice([4, 5, 8, 9, 10, 14])]
            for _ in range(rng.randrange(3)):
                rng.choice([lambda: x.pop(rng.randrange(len(x))), lambda: x.insert(rng.randrange(len(x)), rng.choice("äöüß")), lambda: x.__setitem__(rng.randrange(len(x)), rng.choice("äöüß"))])()
            said.append(" ".join(x) + ".")
    own = sorted({pairs.opening([x]) for x in said} - {""})
    to = {x: x for x in own}

    def top(x):
        return x if to[x] == x else top(to[x])

    links = []
    for a, b in itertools.combinations(own, 2):
        x, y = Counter(a.split()), Counter(b.split())
        if 5 * (x & y).total() >= 4 * (x | y).total():
            links.append((a, b))
            u, v = sorted((top(a), top(b)))
            to[v] = u
    got = {r["opening"]: r["cluster"] for r in pairs.clusters(spark.createDataFrame([(x, True) for x in own], "opening string, short boolean")).collect()}
    assert len(got) == len(own) and len(links) > 50
    assert all(top(x) == top(c) for x, c in got.items())  # nothing else
    found = sum(got[a] == got[b] for a, b in links) / len(links)
    assert found >= 0.97, found


def test_refusals_may_be_a_third_of_all_rows(spark):
    # 60 answers of three or four sentences, each with an opening of its own; 40 refusals with two openings
    own = [(i, f"answer {i} begins", 3 + i % 2, i) for i in range(60)]
    no = [(100 + i, ("i must decline this", "no i will not")[i % 2], 1 + i % 2, i) for i in range(40)]
    op = spark.createDataFrame(own + no, "result_no long, opening string, n_sentences int, prompt long")
    usual = pairs.usual_length(op)
    assert usual == 3
    assert {r["opening"] for r in pairs.templates(op, usual).collect()} == {"i must decline this", "no i will not"}


TOPICS = ["archive", "budget", "calendar", "draft", "engine", "forecast", "garden", "harbour", "invoice", "journal"]


def answers(n):
    rng = random.Random(8)
    verbs, things = ["shows", "lists", "holds", "misses", "repeats"], ["rows", "notes", "names", "dates", "gaps"]
    return [" ".join(f"The {rng.choice(TOPICS)} {rng.choice(verbs)} {rng.choice(things)} that the {rng.choice(TOPICS)} {rng.choice(verbs)} {rng.choice(['today', 'twice', 'again'])}." for _ in range(rng.choice([3, 3, 4]))) for _ in range(n)]


def test_one_sentence_refusals_are_found_though_they_are_a_third(spark):
    model = language.LanguageModel.train([(" ".join(EN), "en"), (" ".join(DE), "de"), *[(x, "en") for x in answers(40)], *[(" ".join(DE), "de")] * 5])
    data = [(i, f"What does the {TOPICS[i % 10]} say about item {i}?", x, None) for i, x in enumerate(answers(140))]
    no = ["I must decline this request.", "Sorry, but I will not take part in that."]
    data += [(1000 + i, f"Copy the {TOPICS[i % 10]} to place {i}.", no[i % 2], None) for i in range(60)]
    data += [(2000, "Tell me.", "I must decline this request. The archive lists rows that the budget holds today.", None), (2001, "Tell me more.", None, "timeout"), (2002, "Send the file today", "Send the file today", None),
             (2003, "Tell me now.", " ".join(DE), None), (2004, "And now?", answers(1)[0] + " The archive lists rows that the", None), (2005, "And then?", answers(1)[0][:-1], None), (2006, None, answers(2)[1], None)]
    df = spark.createDataFrame(data, "no long, p string, r string, e string")
    got = {r["no"]: r["defect"] for r in pairs.defective(df, "no", "p", "r", "e", model).collect()}
    assert {k for k, v in got.items() if v == "refusal"} == set(range(1000, 1060))
    assert {k: v for k, v in got.items() if v != "refusal"} == {2001: "empty", 2002: "copy", 2003: "wrong_language", 2004: "truncated"}
    assert pairs.defective(df.limit(0), "no", "p", "r", "e", model).count() == 0


def test_ends_are_counted_over_all_responses(spark):
    said = [f"Row {i} is about item{chr(97 + i % 26)} word{''.join(chr(97 + int(c)) for c in str(i))}. More of it follows here. That is all there is." for i in range(3000)]
    said.append("x " * 12_000 + "and so it ends with zebras. More of it follows here. That is all there is.")
    last = [x.split(".")[0] for x in said[::75]] + ["It ends with zebras", "More of it", "nothing like this was ever said"]

    def tail(x):
        return [pairs.START, pairs.START, *pairs.codes(pairs.masked(x)).tolist()][-3:]

    rows_ = [(i, None, pairs.coded(pairs.split_sentences(x)).tolist()) for i, x in enumerate(said)] + [(10_000 + i, tail(x), []) for i, x in enumerate(last)]
    df = spark.createDataFrame(rows_, "no long, tail array<int>, codes array<int>").repartition(8)
    got = {r["no"] - 10_000: r["ended"] for r in pairs.ends(df, "no", df.where("tail is null")).collect()}
    ends_, inner = Counter(), Counter()
    for x in said:
        for s in pairs.split_sentences(x)[:-1]:
            w = ["^", "^", *pairs.masked(s)]
            for i in range(2, len(w)):
                for n in (1, 2, 3):
                    (ends_ if i == len(w) - 1 else inner)[tuple(w[i - n + 1 : i + 1])] += 1

    def ended(x):
        w = ["^", "^", *pairs.masked(x)]
        for n in (3, 2, 1):
            k = tuple(w[-n:])
            if ends_[k] + inner[k] >= 4 or (n == 1 and ends_[k] + inner[k]):
                return ends_[k] >= 0.1 * (ends_[k] + inner[k])
        return False

    assert got == {i: ended(x) for i, x in enumerate(last)} and sum(got.values()) > 30 and not got[len(last) - 1]


# 7
def test_history_is_brute_force(spark):
    t = [x for x in corpus(4, 30)]
    old = [(i, x, f"id{i}", None) for i, x in enumerate(t)]
    new = [(1000 + i, x, f"id{i}" if i % 9 == 0 else f"n{i}", i // 20) for i, x in enumerate(t[1:60:2] + ["unseen words only here", None, ""] + t[90:100])]
    new += [(2000, new[5][1], "copy", 9)]
    h = spark.createDataFrame([(n, x, k) for n, x, k, _ in old], "no long, text string, id string")
    inc = spark.createDataFrame(new, "no long, text string, id string, batch int")
    m = {n: (multiset(x) if x else Counter(), k) for n, x, k, _ in old + new}
    exact, edits = {}, {}
    for n, *_ in new:
        for o in sorted(m):
            if o >= n:
                break
            if m[o][1] == m[n][1] or near(m[o][0], m[n][0]):
                exact[n] = o
                break
    got = {r["no"]: r["match_no"] for r in history.repeats(h, inc, "batch", [F.col("id")]).collect()}
    assert got == exact
    assert history.repeats(h, inc.limit(0), "batch", [F.col("id")]).count() == 0


def test_history_finds_scattered_and_reordered_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    old, new = [], []
    for i in range(120):
        n = (40, 80, 120)[i % 3]
        w = [word() for _ in range(n)]
        old.append((i, " ".join(w)))
        if i % 4 == 0:  # deletions, n / 5
            gone = set(rng.sample(range(n), n // 5))
            x = [y for j, y in enumerate(w) if j not in gone]
        elif i % 4 == 1:  # insertions, n / 4
            x = list(w)
            for _ in range(n // 4):
                x.insert(rng.randrange(len(x) + 1), word())
        elif i % 4 == 2:  # halves swapped and one word replaced
            x = w[n // 2 :] + w[: n // 2]
            x[3] = word()
        else:
            x = rng.sample(w, n)[1:]
        new.append((1000 + i, " ".join(x), 0))
    found = history.repeats(spark.createDataFrame(old, "no long, text string"), spark.createDataFrame(new, "no long, text string, batch int"), "batch", [])
    assert {r["no"]: r["match_no"] for r in found.collect()} == {1000 + i: i for i in range(120)}


def test_wide_sketches_keep_near_copies_and_few_others(spark):
    """Texts of one template, which share half of their words: the 64 bits that entries have say nothing of long texts."""
    rng = random.Random(8)
    data, want = [], set()
    for i in range(300):
        n = rng.choice([3, 20, 63, 64, 65, 130, 250, 520, 1300])
        w = [f"t{j}" if j % 2 else f"x{i}y{j}" for j in range(n)]
        x = list(w)
        for j in rng.sample(range(n), n // 9):  # o / (n + m - o) is 4/5 at least
            x[j] = f"z{j}"
        if i % 3 == 0:
            x += [f"a{j}" for j in range(max(0, (9 * (n - n // 9) - 8 * n) // 4))]
        elif i % 3 == 1:
            x = w[: n - n // 5]
        data += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(x))]
        want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame(data, "no long, text string")
    index = history.SegmentIndex(spark)
    index.append(df, [])
    a, b = df.select(F.col("no").alias("probe_no")), df.select("no")
    pairs = a.join(b, F.col("probe_no") < F.col("no"))
    got = {(r[0], r[1]) for r in index.narrowed(pairs).select("probe_no", "no").collect()}
    index.drop()
    m = {n: multiset(x) for n, x in data}
    assert all(near(m[x], m[y]) for x, y in want) and want <= got
    alike = {(x, y) for x, y in itertools.combinations(m, 2) if 5 * min(m[x].total(), m[y].total()) >= 4 * max(m[x].total(), m[y].total()) and m[x].total() > 50} - want
    assert {p for p in itertools.combinations(m, 2) if near(m[p[0]], m[p[1]])} <= got and len(alike & got) < 0.05 * len(alike)


def test_index_is_opened_by_name(spark):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(700))
    df = spark.createDataFrame([(i, words(i), f"id{i}") for i in range(3)], "no long, text string, id string")
    history.SegmentIndex(spark, name="kept").append(df, [F.col("id")])
    # in a long text two far segments are left whole
    w = words(2).split()
    far = " ".join(w[:14] + [f"n{j}" for j in range(70)] + w[84:])
    new = spark.createDataFrame([(10, far, "x"), (11, "something new", "id1"), (12, None, None)], "no long, text string, id string")
    index = history.SegmentIndex(spark, name="kept")
    assert {(r["probe_no"], r["no"]) for r in index.probe(new, [F.col("id")]).collect()} == {(10, 2), (11, 1)}
    index.drop()
    assert history.SegmentIndex(spark, name="kept").tables == []


# 8
@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_fills_no_container_beyond_its_capacity(hist):
    fill, seen = Counter(), Counter()
    for length, first, n, container, each in packing.plan(hist, 50):
        for i in range(n):
            fill[container + i // each] += length
            seen[length, first + i] += 1
    assert all(v <= 50 for v in fill.values()) and set(seen.values()) <= {1}
    assert Counter(k for k, _ in seen) == Counter(hist)
    total = sum(k * v for k, v in hist.items())
    # two containers half full would have been one
    assert len(fill) <= 2 * -(-total // 50) and sum(2 * v <= 50 for v in fill.values()) <= 1


def test_pack_places_every_piece_once(spark):
    rng = random.Random(5)
    size = {i: rng.choice([0, 7, 7, 7, rng.randrange(1, 250)]) for i in range(500)}
    df = spark.createDataFrame(list(size.items()), "item long, size int")
    got = packing.pack(df, 100).collect()
    back, fill = Counter(), Counter()
    for r in got:
        back[r["item"]] += r["length"]
        fill[r["container"]] += r["length"]
    assert {k: v for k, v in size.items() if v} == dict(back) and max(fill.values()) <= 100
    assert all(r["length"] == size[r["item"]] for r in got if size[r["item"]] <= 100)
    assert len(fill) <= 1.05 * sum(size.values()) / 100 + 1
    assert packing.pack(df.limit(0), 100).count() == 0


def test_token_counts(spark):
    e = tokens.encoding()
    t = ["hello world", "", None, "<|endoftext|> x", "é" * 5000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(tokens.count_tokens(F.col("t"))).collect()]
    assert got == [len(e.encode_ordinary(x)) if x else 0 for x in t] and e.decode(e.encode_ordinary(t[0])) == t[0]


# 9
def test_mixture_meets_shares_within_repeats(spark):
    rng = random.Random(3)
    docs = [(i, "abc"[i % 3] if i % 50 else "tiny", rng.choice(["en", "de"]), rng.choice(["x", None]), rng.randrange(0, 300)) for i in range(3000)]
    df = spark.createDataFrame(docs, "item long, source string, language string, topic string, tokens int")
    share, most = {"a": 0.5, "b": 0.3, "tiny": 0.2}, {"a": 2, "b": 1, "tiny": 4}
    got = mixing.mixed(df, share, most).collect()
    total = sum(r["tokens"] * r["uses"] for r in got)
    for s in share:
        assert abs(sum(r["tokens"] * r["uses"] for r in got if r["source"] == s) / total - share[s]) < 0.01
    assert all(0 <= r["uses"] <= most[r["source"]] for r in got) and len({r["item"] for r in got}) == len(got)
    assert mixing.mixed(df.limit(0), share, most).count() == 0
    w, size = mixing.rake({("a", "en", ""): 100.0, ("b", "en", ""): 10.0}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    assert size == 60.0 and abs(w["a", "en", ""] - 0.3) < 1e-9 and w["b", "en", ""] == 3


def test_small_weights_are_met_too(spark):
    """Of a large source only a thousandth is used: its order is cut at quantiles, the share is met."""
    docs = [(i, "web" if i % 100 else "tiny", "en", None, 10 + i % 7) for i in range(40_000)]
    df = spark.createDataFrame(docs, "item long, source string, language string, topic string, tokens int")
    got = mixing.mixed(df, {"web": 0.2, "tiny": 0.8}, {"web": 1, "tiny": 1}).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("n")).collect()
    n = {r["source"]: r["n"] for r in got}
    assert abs(n["web"] / sum(n.values()) - 0.2) < 0.01


def test_profile_is_one_reading_of_the_text(spark):
    lang = language.LanguageModel.train([(" ".join(x), k) for k, x in (("en", EN), ("de", DE)) for _ in range(4)])
    model = subjects.SubjectModel.train([(" ".join(EN), "a", True)], ["a"])
    df = spark.createDataFrame([(1, "s", EN[0]), (2, "s", None), (3, "s", ""), (4, "t", DE[1] + "\n" + DE[0])], "item long, source string, text string")
    got = {r["item"]: (r["tokens"], r["language"]) for r in mixing.profiled(df, "item", "text", lang, model).collect()}
    assert got[2] == got[3] == (0, None) and got[1][1] == "en" and got[4][1] == "de" and got[1][0] == len(tokens.encoding().encode_ordinary(EN[0]))


# 10
def test_subjects_by_paragraph(spark):
    cook = ["Simmer the broth with onion and garlic.", "Whisk the eggs with sugar until pale.", "Bake the loaf in a hot oven.", "Fold the cream into the pastry."]
    law = ["The judge adjourned the trial.", "The defendant was acquitted by the court.", "The lawyer filed an appeal.", "A witness signed the statute."]
    filler = ["This page was stored on disk.", "A summary follows below."]
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(60):
        own = cook if i % 2 else law
        docs.append((i, " ".join(rng.sample(filler, 1)) + "\n" + " ".join(rng.sample(own, 4))))
        labels.append((i, ("cooking" if i % 2 else "law") if i % 10 else None))
    docs += [(100, "\n".join([" ".join(cook[:3]), " ".join(law[:3])])), (101, " ".join([*cook[:3], law[0]])), (102, " ".join(filler * 3)), (103, ""), (104, None), (105, " ".join(cook[:2]))]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    model = subjects.fit(df, lab, ["cooking", "law"])
    got = {(r["doc_id"], r["subject"]) for r in subjects.document_subjects(df.where("doc_id >= 100"), "doc_id", "text", model).collect()}
    assert got == {(100, "cooking"), (100, "law"), (101, "cooking")}
    assert subjects.document_subjects(df, "doc_id", "text", subjects.fit(df.limit(0), lab.limit(0), ["law"])).count() == 0


def test_subjects_count_all_documents(spark, monkeypatch):
    monkeypatch.setattr(subjects, "LABELLED", 4)
    monkeypatch.setattr(subjects, "OTHERS", 4)
    docs = [(i, f"Whisk the eggs well. Bake the loaf slowly. Stir the pan {'abcdefghij'[i % 10]}.") for i in range(60)] + [(99, "Rare words are here. " * 1500), (100, ""), (101, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, "cooking") for i in range(30)], "doc_id long, subject string")
    model = subjects.fit(df, lab, ["cooking", "law"])
    u, b, _ = subjects._codes([s for _, t in docs for p in subjects.paragraphs(t) for s in p])
    assert (model.all_words == np.bincount(u, minlength=subjects.SIZE)).all() and (model.all_pairs == np.bincount(b, minlength=subjects.PAIRS)).all()
    assert (model.words.sum(0) <= model.all_words).all()


# queries
@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
class TestQueries:
    def test_found_columns(self, spark):
        want = {
            "p1_found": ["kind", "key_a", "key_b"], "p2_found": ["sample_no_a", "sample_no_b"], "p3_found": ["attack_id", "outcome"], "p4_found": ["sample_no", "group_no"],
            "p5_found": ["sample_no", "segment_no", "lang"], "p6_found": ["result_no", "defect"], "p7_found": ["match_no", "sample_no"], "p10_found": ["doc_id", "subject"],
        }
        for k, cols in want.items():
            df = entry.queries()[k](spark, D)
            assert df.columns == cols, k
            assert df.count() > 0, k

    def test_p2_is_brute_force(self, spark):
        r = duckdb.sql(f"select sample_no, id, text, split from '{D}/attack_samples.parquet' order by sample_no").fetchall()
        seen, side, m = set(), {}, {}
        for n, i, t, s in r:
            if i.strip().lower() not in seen:
                seen.add(i.strip().lower())
                k = (s or "").strip().lower()
                side[n] = {"train": "t", "training": "t", "val": "o", "validation": "o", "dev": "o", "test": "o"}.get(k)
                m[n] = multiset(t)
        want = {(a, b) for a, b in itertools.combinations(sorted(m), 2) if side[a] and side[b] and side[a] != side[b] and near(m[a], m[b])}
        assert {tuple(x) for x in entry.queries()["p2_found"](spark, D).collect()} == want

    def test_p4_matches_sql(self, spark):
        c = duckdb.connect()
        c.execute(f"create view attack_samples as select * from '{D}/attack_samples.parquet'")
        assert sorted(tuple(x) for x in entry.queries()["p4_found"](spark, D).collect()) == sorted(c.execute(entry.oracle_sql()["p4_found"]).fetchall())

    @pytest.mark.parametrize("name", ["p8_unused", "p9_shares"])
    def test_reports(self, spark, name):
        assert entry.queries()[name](spark, D).count() > 0
