"""The text operators against brute force, on small and awkward tables."""

import os
import random
import sys

import numpy as np
import pytest

pytest.importorskip("xspace.llm.queries")
sys.path.insert(0, os.path.dirname(__file__))

import public_tokenizers  # noqa: E402
from helpers import check_packing, counts, near_classes, repeated  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from xspace.llm import language, lm, pieces, quality, rules  # noqa: E402
from xspace.llm.exact_dedup import exact_dedup  # noqa: E402
from xspace.llm.graph import components  # noqa: E402
from xspace.llm.jaccard_join import jaccard_groups  # noqa: E402
from xspace.llm.packing import pack, plan_windows  # noqa: E402
from xspace.llm.pii import KINDS, pseudonymise  # noqa: E402
from xspace.llm.substring_dedup import substring_dedup  # noqa: E402
from xspace.llm.tokens import ByteTokens  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
# extra columns named as the operators' own
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, kept boolean, _t string"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = sentence(rng, 120)
    passage = sentence(rng, 25)
    out = [base, base, base.upper(), None, "", " \n\t", "one", "One two", "one two", "é ☃ 🎉 a b", "x" * 5000]
    for k in range(12):  # near copies of each other, few of them of the first
        ws = base.split()
        for j in range(k % 5):
            ws[(7 * k + 31 * j) % 120] = f"z{k}{j}"
        out.append(" ".join(ws))
    out += [sentence(rng, 40) + " " + passage + "\n" + sentence(rng, 30) for _ in range(6)]
    out += [sentence(rng, 3000), "a b " * 600, "same line here\n" * 30]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", 1, 7, 8, True, "t") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, repeated rows."""
    rows = [(None, "t one", None, None), (None, None, None, None), (5, "t one", None, None), (5, "t one", None, None), (6, None, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# 1
@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan", [1, 3])
def test_exact_dedup(docs, keep, fan):
    import hashlib

    plain = pairs(docs)
    groups = {}
    for d, t in plain:
        groups.setdefault(t or "", []).append(d)
    pick = min if keep == "smallest" else max
    expected = {
        (d, pick(groups[t or ""]), len(groups[t or ""]), d == pick(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for d, t in plain
    }
    assert {tuple(r) for r in exact_dedup(docs, keep=keep, fan_bits=fan).collect()} == expected


def test_exact_dedup_awkward(awkward, empty):
    got = exact_dedup(awkward, keep="largest").collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2
    assert {r.keep_id for r in got if r.group_size == 3} == {5}
    assert exact_dedup(empty).count() == 0


# 2
def test_quality_counts(docs):
    got = {r[0]: tuple(r[1:6]) for r in quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {d: counts(t) for d, t in pairs(docs)}


def test_quality_outliers(spark, empty, awkward):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        t = ". ".join(sentence(rng, 12) for _ in range(rng.randint(4, 30)))
        rows.append((i, t if i % 10 else " ".join(w + "$$$" for w in t.split()), "en", "s"))
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in got)
    assert quality.quality_rules(empty).count() == 0
    assert not any(r.kept for r in quality.quality_rules(awkward).collect())


def test_quality_judges_small_groups(spark):
    rng = random.Random(4)
    rows = []
    for i in range(340):
        t = ". ".join(sentence(rng, 12) for _ in range(rng.randint(4, 30)))
        junk = i % 10 == 0
        rows.append((i, " ".join(w + "$$$" for w in t.split()) if junk else t, "en" if i < 300 else None, "s" if i % 4 else "t"))
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for table in (few, few.where("doc_id >= 240")):  # also fewer than 200 texts in all
        got = quality.quality_rules(table).collect()
        assert all(r.kept == (r.doc_id % 10 != 0) and r.distance2 is not None for r in got)


def test_mcd_ignores_outliers(spark):
    rng = np.random.default_rng(0)
    clean = rng.normal([1.0, -2.0], [0.5, 0.2], (800, 2))
    x = np.vstack([clean, rng.normal([9.0, 9.0], 0.1, (150, 2))])
    rows = [("g", [int(round(v * quality.GRID)) for v in r]) for r in x]
    root = quality.mcd(spark.createDataFrame(rows, "_g string, x array<long>"), [0.01, 0.01]).head()
    assert abs(root.m0 - 1) < 0.1 and abs(root.m1 + 2) < 0.05
    assert 0.3 < root.l0_0 < 0.7 and 0.1 < root.l1_1 < 0.3


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 2) - 5.991464547) < 1e-6
    assert abs(quality.chi2_cdf(11.0705, 5) - 0.95) < 1e-5


# 3
def test_substring_dedup(docs, empty, awkward):
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs).collect()}
    assert got == repeated(pairs(docs))
    assert substring_dedup(empty).count() == 0
    assert substring_dedup(awkward).count() == 5


# 4
def test_pseudonyms(spark, docs, empty):
    rows = [
        (0, "mail a.b-1@mail5.example.com### and a.b-1@mail5.example.com"),
        (1, "4539 1488 0343 6467; 4539148803436467; 4539148803436468"),
        (2, "2020-02-29 31.12.1999 99/99/2000 ip 233.233.171.252!! 999.1.1.1"),
        (3, "123-45-6789 000-12-3456 +1 (743) 555-3824"),
        (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
        (5, "DE89370400440532013000 DE00370400440532013000"),
        (6, None), (7, ""), (8, "9" * 20000 + "@"), (9, "a@" * 3000),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonymise(table, "key", counts=True).collect()}
    for d, t in rows:
        assert (t is None) == (got[d].text is None)
        if t is not None and "ip" not in t:  # numbers of an address have one to three digits
            assert len(got[d].text) == len(t)
    tally = {d: [getattr(got[d], f"n_{k}") for k in KINDS] for d, _ in rows[:6]}
    assert tally == {0: [2, 0, 0, 0, 0, 0, 0, 0], 1: [0, 0, 0, 0, 0, 0, 2, 0], 2: [0, 0, 0, 2, 1, 0, 0, 0],
                     3: [0, 0, 0, 0, 0, 1, 0, 1], 4: [0, 1, 0, 0, 0, 0, 0, 0], 5: [0, 0, 1, 0, 0, 0, 0, 0]}
    a, b = got[0].text.split("###")[0].split()[1], got[0].text.split()[-1]
    assert a == b != "a.b-1@mail5.example.com"
    one, two, bad = got[1].text.split("; ")
    assert one.replace(" ", "") == two and bad == "4539148803436468"
    assert "99/99/2000" in got[2].text and "999.1.1.1" in got[2].text and "2020-02-29" not in got[2].text
    # a pseudonym is valid and of its kind again; another key gives another one
    twice = pseudonymise(pseudonymise(table, "key"), "other", counts=True)
    again = {r.doc_id: [r[f"n_{k}"] for k in KINDS] for r in twice.collect()}
    assert all(again[d] == tally[d] for d in tally)
    assert pseudonymise(empty, "k").columns == empty.columns
    assert pairs(pseudonymise(docs, "k").orderBy("doc_id")) == pairs(docs.orderBy("doc_id"))


def test_pseudonyms_are_a_permutation(spark):
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1990-01-01"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pseudonymise(days, "k").distinct().count() == 3000


def test_dates_stay_apart_and_keep_their_form(spark):
    days = spark.range(0, 73049, 7).select(F.date_add(F.lit("1900-01-01"), F.col("id").cast("int")).alias("d"))
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "d.M.yyyy", "M.d.yyyy", "d/MM/yyyy"]
    texts = days.select(F.explode(F.array(*[F.date_format("d", f) for f in forms])).alias("text")).distinct()
    got = pseudonymise(texts.withColumn("old", F.col("text")), "k", counts=True).collect()
    assert len({r.text for r in got}) == len(got) > 30000 and all(r.n_date == 1 for r in got)
    shape = lambda t: "".join("0" if c.isdigit() else c for c in t)
    assert all(shape(r.text) == shape(r.old) for r in got)
    assert sum(r.text == r.old for r in got) < 40


def test_plain_numbers_are_no_phones(spark):
    rows = [
        "+1 000 000 users", "+3.14159265", "1700000000", "(2019) 2020 2021", "see (123) 456 789 rows", "0306406152",
        "id 4155552671", "100 200 3000 rows", "+12345678 points", "rows 1234567890123", "f(123) 4567 8901", "+999 12",
    ]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in pseudonymise(table, "key", counts=True).collect():
        assert r.text == rows[r.doc_id] and r.n_phone == 0, r
    yes = ["(020) 7946 0958", "212 555 0123", "212.555.0123", "+49 30 901820", "+33 1 42 68 53 00", "Tel.: 0306406152", "phone number (123) 456 789"]
    table = spark.createDataFrame(list(enumerate(yes)), "doc_id long, text string")
    once = pseudonymise(table, "key")
    for r in pseudonymise(once, "other", counts=True).collect():
        assert r.n_phone == 1 and r.text != yes[r.doc_id], r


def test_pseudonyms_with_clashing_columns(spark):
    row = spark.createDataFrame([(1, "a@b.example.com", "own", 7, "x")], "doc_id long, text string, _known string, N_email long, _known_ string")
    got = pseudonymise(row, "key").first()
    assert (got["_known"], got["N_email"], got["_known_"]) == ("own", 7, "x") and got.text != "a@b.example.com"
    counted = pseudonymise(row, "key", counts=True)
    assert len({c.lower() for c in counted.columns}) == len(counted.columns)
    assert counted.first().n_email == 1 and counted.first()["_known"] == "own"
    twice = pseudonymise(row.unionAll(row).drop("N_email"), "key").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_phones_of_any_form(spark):
    phones = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+14155552671", "4155552671", "+44 20 7946 0958", "(020) 7946 0958", "1-415-555-2671"]
    table = spark.createDataFrame([(i, f"tel {p}, x") for i, p in enumerate(phones)], "doc_id long, text string")
    for r in pseudonymise(table, "key", counts=True).collect():
        p, new = phones[r.doc_id], r.text[4:-3]
        assert r.n_phone == 1 and p != new and len(p) == len(new), p
        assert [c if not c.isdigit() else "0" for c in p] == [c if not c.isdigit() else "0" for c in new]
        assert new.startswith({"+1": "+1", "+4": "+44"}.get(p[:2], ""))


def test_values_within_failing_candidates(spark):
    cases = [
        ("call 212-555-0123 212-555-0199", {"phone": 2}, "call "),
        ("order 12 4111 1111 1111 1111", {"card": 1}, "order 12 "),
        ("ref 2024 4539 1488 0343 6467", {"card": 1}, "ref 2024 "),
        ("tel 743-555-3824 4539 1488 0343 6467", {"phone": 1, "card": 1}, "tel "),
        ("BE68 5390 0754 7034 CALL", {"iban": 1}, "BE"),
        ("4111 1111 1111 1112 99/99/2000", {}, "4111 1111 1111 1112 99/99/2000"),
    ]
    table = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    for r in pseudonymise(table, "key", counts=True).collect():
        text, kinds, head = cases[r.doc_id]
        assert {k: r[f"n_{k}"] for k in KINDS if r[f"n_{k}"]} == kinds, text
        assert r.text.startswith(head) and len(r.text) == len(text) and (r.text != text) == bool(kinds)


# 5
def test_jaccard_groups(docs, empty, awkward):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(docs).collect()}
    assert got == near_classes(pairs(docs))
    assert jaccard_groups(empty).count() == 0
    assert jaccard_groups(awkward).count() == 5


def test_jaccard_groups_chain_and_common_words(spark):
    # long chains of near copies whose ends differ, of several sizes, all behind one common passage
    rng = random.Random(5)
    rows = []
    for size in (12, 70, 300, 1200):
        ws = sentence(rng, size, 10**6).split()
        for step in range(14):
            rows.append((len(rows), " ".join(ws)))
            for j in range(max(1, size // 60)):
                ws[(step * max(1, size // 60) + j) * 5 % size] = f"n{rng.random()}"
    common = sentence(rng, 12)
    rows += [(len(rows) + k, common + " " + sentence(rng, 60, 10**6)) for k in range(150)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(table).collect()}
    assert got == near_classes(rows)


def test_jaccard_groups_of_a_template_in_parts(spark, monkeypatch):
    # one block of many documents that mostly do not link, cut into small parts
    monkeypatch.setattr("xspace.llm.jaccard_join.BLOCK_PART", 7)
    rng = random.Random(8)
    base = sentence(rng, 100, 10**6).split()
    rows = []
    for d in range(90):
        ws = list(base)
        for j in rng.sample(range(100), rng.choice((2, 3, 4))):
            ws[j] = f"n{rng.random()}"
        rows.append((d, " ".join(ws)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(table).collect()}
    assert got == near_classes(rows)


def test_substring_dedup_with_a_passage_in_most_documents(spark):
    rng = random.Random(9)
    common = sentence(rng, 40, 10**6)
    rows = [(d, f"{sentence(rng, 20, 10**6)} {common if d % 5 else ''} {sentence(rng, 15, 10**6)}") for d in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(table).collect()}
    expected = repeated(rows)
    assert {d: v[1] for d, v in got.items()} == {d: v[1] for d, v in expected.items()}
    assert sum(v[1] for v in got.values()) == 159 * 40


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 100), (300, 300)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}


# 6
def test_packing(docs, empty, awkward):
    check_packing(pack(docs, RANKS).collect(), pairs(docs), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    check_packing(pack(docs, RANKS, window=64).collect(), pairs(docs), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 64)
    assert pack(empty, RANKS).count() == 0
    assert sum(r.length for r in pack(awkward, RANKS).collect()) == sum(n for n in (3, 1, 3, 3, 1))


def test_planned_windows_are_full():
    rng = np.random.default_rng(1)
    hist = rng.integers(0, 50, 64)
    hist[0] = 0
    slots, first, sequences = plan_windows(hist, 64)
    assert (first <= hist).all() and sequences > 0.6 * (hist @ np.arange(64)) / 64
    filled = np.zeros(sequences, dtype=int)
    for length, low, high, sequence, _ in slots:
        filled[sequence : sequence + high - low] += length
    assert (filled == 64).all()


def test_tokens_equal_the_tokenizer():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = ByteTokens(RANKS)
    rng = random.Random(2)
    odd = ["a  b", "a \n b", " a", "a ", "it's 12's", "x  y z", "́ ́a", "日本 語。 テスト", "a\r\n\r\n b\n", "'s 's"]
    odd += ["".join(rng.choice(" \n\ta'1.é ​s") for _ in range(30)) for _ in range(300)]
    for t in odd + [t for t in texts() if t]:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


# 7
def test_pieces_round_trip(docs, empty):
    odd = docs.select("doc_id", "text", F.col("lang").alias("piece_ids"))
    got = pieces.decode(pieces.encode(odd, MODEL), MODEL).collect()
    assert len(got) == docs.count() and all(r.decoded == r.text for r in got)
    assert pieces.encode(empty, MODEL).count() == 0


def test_viterbi_is_best():
    vocabulary = pieces.Pieces(MODEL)
    rng = random.Random(4)
    some = [pieces.MARK + "".join(rng.choice("etaonshr▁é☃") for _ in range(rng.randint(0, 7))) for _ in range(300)]

    def best(word):
        scores = [0.0]
        for end in range(1, len(word) + 1):
            plain = [scores[s] + vocabulary.score[word[s:end]][0] for s in range(end)
                     if word[s:end] in vocabulary.score and (s == 0 or word[s] != pieces.MARK)]
            raw = scores[end - 1] + len(word[end - 1].encode()) * (vocabulary.worst - 10)
            scores.append(max(plain) if plain else raw)
        return scores[-1]

    for word, ids in vocabulary.encode_words(list(set(some))).items():
        ids = np.frombuffer(ids, "<i4").tolist()
        total = sum(vocabulary.worst - 10 if i in vocabulary.byte_of else vocabulary.score[vocabulary.text[i]][0] for i in ids)
        assert abs(total - best(word)) < 1e-6 and vocabulary.decode(np.array(ids, "<i4").tobytes()) == word[1:]


# 8
def test_lm(spark, docs, empty):
    network, frequent, history = lm.train(docs, epochs=15)
    assert history[-1] > history[0]
    got = {r.doc_id: r for r in lm.score(docs, network, frequent).collect()}
    logs = network.table()
    from xspace.llm.hashing import word_hashes

    for d, t in pairs(docs):
        hashes, _ = word_hashes([(t or "").encode()])
        classes = [lm.CLASSES, *lm._classes(hashes, frequent).tolist(), lm.CLASSES]
        total = sum(float(logs[classes[i - 1], classes[i + 1], classes[i]]) for i in range(1, len(classes) - 1))
        assert got[d].n_words == len(hashes) and abs(got[d].pll - total) < 1e-3
        assert (got[d].pll_per_word is None) == (len(hashes) == 0)
    network, frequent, history = lm.train(empty)
    assert history == [] and lm.score(empty, network, frequent).count() == 0


def test_lm_gradient():
    rng = np.random.default_rng(0)
    network = lm.Network()
    left, right = rng.integers(0, lm.CLASSES + 1, 30), rng.integers(0, lm.CLASSES + 1, 30)
    n = rng.poisson(0.1, (30, lm.CLASSES)).astype(float)
    grads, value = network.gradient(left, right, n)
    for p, g in zip(network.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-5
        assert abs((network.gradient(left, right, n)[1] - value) / 1e-5 - g[at]) < 1e-2 * max(1, abs(g[at]))
        p[at] -= 1e-5


def test_lm_words(spark, docs, empty):
    from xspace.llm.hashing import word_hashes

    rng = random.Random(9)
    rows = [(i, sentence(rng, 60, 3000)) for i in range(300)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train_words(corpus, epochs=6)
    # the table holds every word, and with the rest the words of a class add up to one
    distinct = {w for _, t in rows for w in t.split()}
    known = {r.word: r.log_p for r in model.words.collect()}
    assert len(known) == len(distinct) - model.own
    assert np.isclose(sum(map(np.exp, known.values())) + np.exp(model.rest).sum(), lm.HASHED)
    assert lm.OWN_PER_ROOT * (2 * 10**6) ** (1 / 3) > lm.FREQUENT  # classes grow with the words
    common = " ".join(rows[0][1].split()[:20])
    odd = [(1000, common), (1001, " ".join(f"qx{k}" for k in range(20))), (1002, None), (1003, ""), (None, common), (1000, common)]
    asked = spark.createDataFrame([*rows[:5], *odd], "doc_id long, text string")
    got = lm.score_words(asked, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1001].pll_per_word < by_id[1000].pll_per_word - 2  # words never seen
    assert len(got) == 11 and by_id[None].pll == by_id[1000].pll
    assert by_id[1002].pll == by_id[1003].pll == 0 and by_id[1002].pll_per_word is None
    # brute force: mixed class probability of windows of two words a side, times the word's share
    tables = [n.table() for n in model.networks]
    edge = model.own + lm.HASHED
    for d, t in [*rows[:5], *odd[:2]]:
        hashes, _ = word_hashes([t.encode()])
        c = [edge, edge, *lm._classes(hashes, model.frequent, model.own).tolist(), edge, edge]
        total = 0.0
        for i, h in enumerate(hashes.view(np.int64).tolist(), 2):
            p = sum(s * np.exp(float(t_[c[i - k], c[i + k], c[i]])) for k, (s, t_) in enumerate(zip(model.shares, tables), 1))
            word = 0.0 if c[i] < model.own else known.get(h, model.rest[c[i] - model.own])
            total += np.log(p) + word
        assert abs(by_id[d].pll - total) < 1e-3 * len(hashes)
    # the join gives the same
    spark.conf.set("spark.xspace.broadcastBytes", "100")
    try:
        joined = sorted(lm.score_words(asked, model).collect(), key=str)
    finally:
        spark.conf.unset("spark.xspace.broadcastBytes")
    for a, b in zip(sorted(got, key=str), joined):
        assert (a.doc_id, a.n_words) == (b.doc_id, b.n_words) and abs(a.pll - b.pll) < 1e-6
    model = lm.train_words(empty)
    assert lm.score_words(empty, model).count() == 0
    assert {r.pll for r in lm.score_words(docs.where("text = ''"), model).collect()} == {0.0}


# 9
def test_language(spark, empty, awkward):
    rng = random.Random(6)
    kinds = {"aa": "the of and ing tion", "bb": "der und ein ich keit", "cc": "que los ado cion ez"}
    rows = [
        (i, " ".join("".join(rng.choices(kinds[k].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(3, 80))), k)
        for i, k in enumerate(rng.choices(list(kinds), k=500))
    ]
    rows += [(900, None, "aa"), (901, "12 34", "bb"), (902, "", None), (903, "und der", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(table, language.train(table)).collect()}
    import zlib

    held = [(d, k) for d, _, k in rows[:500] if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(got[d].lang_pred == k for d, k in held) > 0.97 * len(held)
    assert [got[d].lang_pred for d in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.train(empty) is None and language.identify(empty, None).count() == 0
    assert language.identify(awkward, None).count() == 5


# 10
def test_rules(spark, empty):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(600):
        t, bad = sentence(rng, rng.randint(30, 90)), rng.random() < 0.4
        rows.append((i, t.upper() + "!!" if bad else t))
        marks.append((i, None if i % 50 == 0 else int(not bad), i))
    table = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, n_words long")
    got = {r.doc_id: r for r in rules.classify(table, labels).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values())
    held = [(d, q) for d, q, _ in marks if q is not None and got[d].held_out]
    assert sum(got[d].predicted == q for d, q in held) > 0.97 * len(held)
    assert rules.classify(empty.select("doc_id", "text"), labels).count() == 0
    none = rules.classify(table, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_rule_columns_equal_the_matrix(spark):
    rng = np.random.default_rng(3)
    names = list(rules.STATISTICS)
    x = rng.random((200, len(names)))
    found = rules.grow_rules(x, (x[:, 0] + x[:, 3] > 1).astype(float), names)
    w = rng.normal(size=len(found))
    rows = spark.createDataFrame([[i, *map(float, r)] for i, r in enumerate(x)], ["k", *names])
    got = [r[0] for r in rows.orderBy("k").select(rules.RuleEnsemble(found, w.tolist(), 0.2).score()).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(rules.holds(found, x, names) @ w + 0.2))))


# pipeline
def test_pipeline(spark, awkward, empty):
    rng = random.Random(8)
    good = [". ".join(sentence(rng, 12, 10**5) for _ in range(12)) for _ in range(40)]
    near = good[0].split()
    near[50] = "other"
    texts_ = [*good, good[1], " ".join(near), "short", good[2] + " 4539148803436467"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts_)] + [(41, " ".join(near), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = corpus_pipeline.settle(stage(spark, docs, ""))
    ids = {n: sorted(r.doc_id for r in out[n].collect()) for n in names}
    assert 42 not in ids["quality_rules"]
    assert 1 not in ids["exact_dedup"] and ids["exact_dedup"].count(41) == 1
    assert set(ids["near_dedup"]) == set(ids["exact_dedup"]) - {41, 43}
    for n in names[:-1]:
        assert out[n].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    pieces_ = out["packing"].collect()
    check_packing(pieces_, pairs(out["pii"]), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    for table in (awkward.withColumn("n_chars", F.lit(1)), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            table = corpus_pipeline.settle(stage(spark, table, ""))
        assert table.count() >= 0
