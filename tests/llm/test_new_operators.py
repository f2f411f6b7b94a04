"""Filter audit, prefix BPE and importance resampling against brute force."""

import hashlib
import math
import random
import zlib
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("xspace.llm.queries")

import base64  # noqa: E402

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from xspace.llm import filter_audit as audit  # noqa: E402
from xspace.llm import prefix_bpe as bpe  # noqa: E402
from xspace.llm import resampling as draw  # noqa: E402

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
# extra columns named as the operators' own
SCHEMA = "doc_id long, text string, lang string, id long, n long, mask int, part string, rank long, weight long, score long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, 2, 3, "p", 4, 5, 6) for i, t, g in rows], SCHEMA).repartition(3)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def corpus(seed=3):
    """Copies, hot texts, long and empty texts, null ids, languages and texts, repeated rows."""
    rng = random.Random(seed)
    base = prose(rng, 250)
    rows = [(i, base, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100 + i, prose(rng, rng.randint(0, 400), rng.choice([20, 3000])), rng.choice(["en", "de", None, ""])) for i in range(40)]
    rows += [(200 + i, prose(rng, 210).upper() + " #", "en") for i in range(3)]
    rows += [(300, None, "en"), (301, "", None), (302, " \n\t\x0b", "fr"), (303, "é ☃ 🎉 ½ 'll we've  x\n\n  y ", "fr")]
    rows += [(None, base, "en"), (None, None, None), (None, prose(rng, 30), "en"), (7, base, "en"), (7, base, "en"), (7, "other", "fr")]
    rows += [(400, prose(rng, 60_000, 5000), "en"), (401, "x" * 300_000, "en"), (402, "äß" * 2000 + " a", "en")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 350, 2)] + [(0, 1, 0), (None, 1, 1), (999, 1, 1), (4, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 11


def failures(rows):
    """Failure mask of each row, row by row."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        ws = t.encode().split()
        fails = [
            len(ws) < 200,
            100 * len(set(ws)) < 50 * len(ws),
            100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        ]
        out.append(sum(f << k for k, f in enumerate(fails)))
    return out


def audited(rows, labels):
    """Every order applied filter by filter to the documents themselves."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    masks, out = failures(rows), {}
    for part in {g or "" for _, _, g in rows}:
        own = [(i, m) for (i, _, g), m in zip(rows, masks) if (g or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [d for d in left if d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                fail = [d for d in own if d[1] & bit]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(fail) - len(gone), sum(m == bit for _, m in own),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
                total[name] += len(gone)
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                out[part, "".join(order), step].append(total[name])
    return out


def test_filter_audit(docs, rows, labels):
    got = audit.filter_audit(docs, labels).collect()
    marked = [tuple(r) for r in labels.collect()]
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in got}
    assert len(got) == len(found) == 600 * 4
    assert found == audited(rows, marked)


def test_gray_walk_states_are_the_subset_counts():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5, 7):
        cells = rng.integers(0, 50, (3, 1 << k, 2))
        states = audit.gray_walk(cells)
        masks = np.arange(1 << k)
        for s in masks:
            assert (states[:, s] == cells[:, (masks & s) == 0].sum(axis=1)).all()


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("a", 0, 5, 1), ("a", 3, 2, 2), ("a", 3, 1, 0), ("b", 1, 4, 4)], "part string, mask int, n long, odd long")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.odd_lost, r.shapley) for r in audit.subset_audit(cells, "XY", ["odd"]).collect()}
    assert got["a", "XY", 1] == (5, 3, 0, 0, 2, 3) and got["a", "XY", 2] == (5, 0, 3, 0, 0, 3)
    assert got["b", "YX", 1] == (4, 0, 0, 0, 0, 0) and got["b", "YX", 2] == (0, 4, 0, 4, 4, 8)
    with pytest.raises(ValueError, match="filters"):
        audit.subset_audit(cells, "XX", [])


def test_filter_audit_of_nothing(spark, docs, labels):
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    assert audit.filter_audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


# 12


@pytest.fixture(scope="module")
def tokens():
    return bpe.loaded(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_prefix_bpe_query_columns(docs, rows, library):
    encoded = bpe.encode(docs, RANKS, PATTERN)
    got = bpe.digests(bpe.decode(encoded, RANKS, PATTERN).withColumn("at", F.col("doc_id"))).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert bpe.encode(docs.limit(0), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError, match="token_ids"):
        bpe.encode(encoded, RANKS, PATTERN)


def test_pieces_of_any_bytes(tokens, library):
    rng = random.Random(5)
    vocabulary = list(tokens.rank)
    for k in range(4000):
        raw = (
            b"".join(rng.choices(vocabulary, k=rng.randint(1, 6)))
            if k % 3 == 0
            else bytes(rng.choices(b"aabbcdehnrst ", k=rng.randint(1, 40)) if k % 3 == 1 else rng.choices(range(256), k=rng.randint(1, 12)))
        )
        assert tokens.encode_piece(raw) == library._encode_single_piece(raw)


def test_every_prefix_has_its_own_encoding(tokens, library):
    piece = "unvorstellbarkeitsgefühlsmässigstes".encode()
    table = bpe.PrefixTable(tokens, piece)
    for n in range(1, len(piece) + 1):
        if piece[:n] not in tokens.rank:
            assert tokens.trace(table.last[:n]) == library._encode_single_piece(piece[:n])


def test_prefix_table_appends_and_edits(tokens, library):
    rng = random.Random(8)
    table = bpe.PrefixTable(tokens)
    for _ in range(300):
        new = bytes(rng.choices(b"abcdeinrst", k=rng.randint(0, 4)))
        if rng.random() < 0.6:
            before = table.worked
            table.append(new)
            assert table.worked - before == len(new)
        else:
            start = rng.randint(0, len(table.piece))
            end = rng.randint(start, min(len(table.piece), start + 5))
            before, tail = table.worked, len(table.piece) - end
            table.replace(start, end, new)
            assert table.worked - before == len(new) + tail
        if table.piece and table.piece not in tokens.rank:
            assert table.ids() == library._encode_single_piece(table.piece)


def test_long_texts_in_stretches(tokens, library, monkeypatch):
    monkeypatch.setattr(bpe, "CUT_CHARS", 50)
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices(["word", " ", "  ", "\n", "\t ", "'ll", "12", "é", "!?", " \x1c", "\xa0", " Ünï"], k=200))
        assert "".join(bpe.stretches(text)) == text
        assert tokens.encode(text).tolist() == library.encode_ordinary(text)


def test_long_unbroken_piece_is_linear(tokens):
    import time

    seconds = []
    for n in (100_000, 400_000):
        start = time.perf_counter()
        assert tokens.decode(tokens.encode_piece(b"abcdefghij" * (n // 10))) == b"abcdefghij" * (n // 10)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 12 * seconds[0]


def test_reencode_near_edits(spark, library):
    rng = random.Random(4)
    parts = ["word", " ", "  ", "\n", " the", "'", "'l", "l", "12", "é", "!?", " \x1c", "\xa0", " Ünï", " end"]
    rows = []
    for k in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        start = rng.randint(0, len(text))
        end = rng.randint(start, min(len(text), start + 6))
        if k % 4 == 0:
            start = end = len(text)  # an append
        rows.append((k, text, start, end, "".join(rng.choices(parts, k=rng.randint(0, 4)))))
    rows += [(500, None, None, None, "a b"), (501, "a b", 0, 99, None), (502, "to be " * 50_000, 150_000, 150_003, "x")]
    table = spark.createDataFrame(rows, "id long, text string, start int, end int, new string")
    changed = bpe.reencode(bpe.encode(table, RANKS, PATTERN), RANKS, PATTERN)
    for r in changed.collect():
        _, text, start, end, new = next(x for x in rows if x[0] == r.id)
        text = text or ""
        start, end = len(text) if start is None else start, len(text) if end is None else end
        expected = text[:start] + (new or "") + text[end:]
        assert r.text == expected and r.token_ids == library.encode_ordinary(expected)
        assert r.id != 502 or r.encoded_bytes < 100


# 13


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws, word = [], ""
    for c in low + " ":
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            ws, word = ws + [word] * bool(word), ""
        else:
            word += c
    return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def resampled(rows, target, percent=10, least=20, buckets=10_000, longest=1):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: np.bincount([bucket(f) for t in texts for f in features(t, longest)[1]], minlength=buckets)
    s, t = count([x for _, x in rows]), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        ws, own = features(x, longest)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(own), weight, score, len(ws) >= least))
    able = sorted((-o[3], (o[0] is not None, o[0] or 0), o[1], o[2]) for o in out if o[4])
    ranks = [None if k >= percent * len(able) // 100 else k + 1 for k in range(len(able))]
    placed = [(a[1][1] if a[1][0] else None, a[2], a[3], -a[0], k) for a, k in zip(able, ranks)]
    return placed + [(*o[:4], None) for o in out if not o[4]]


@pytest.mark.parametrize("percent, buckets, longest", [(10, 10_000, 1), (60, 10_000, 1), (100, 50, 3)])
def test_resampling(spark, docs, rows, percent, buckets, longest):
    rng = random.Random(9)
    target = [prose(rng, 50, 60) for _ in range(5)] + [None, "", "É☃ ABC-def"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    small = [(i, t) for i, t, _ in rows if not t or len(t) < 20_000 or longest == 1]
    own = docs if longest == 1 else make(spark, [r for r in rows if (r[0], r[1]) in small])
    got = draw.resample(own, table, percent=percent, buckets=buckets, longest=longest).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(resampled(small, target, percent, buckets=buckets, longest=longest), key=repr)


def test_crcs_of_any_spans():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, 6_000_000, dtype=np.uint8)
    lengths = np.array([1, 2, 3, 4, 5, 255, 256, 257, 258, 511, 512, 513, 1024, 100_003, 3_000_001, *rng.integers(1, 40, 500)])
    starts = rng.integers(0, len(codes) - lengths)
    got = draw.span_crcs(codes, starts, lengths)
    assert got.tolist() == [zlib.crc32(codes[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert len(draw.span_crcs(codes, starts[:0], lengths[:0])) == 0


def test_resampling_of_nothing(spark, docs):
    target = spark.createDataFrame([("a b",)], "text string")
    assert draw.resample(docs.limit(0), target).count() == 0
    assert draw.resample(docs, target.limit(0)).where("rank IS NOT NULL").count() > 0
    assert draw.resample(docs, target, min_words=10**9).where("rank IS NOT NULL").count() == 0


def test_one_id_on_a_third_of_all_rows(spark):
    rows = [(5 if k % 3 == 0 else k, "same words here " * 10) for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = draw.resample(table, table.limit(1), percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 301))
    assert sorted(map(tuple, got), key=repr) == sorted(resampled(rows, [rows[0][1]], 50), key=repr)


def test_pieces_share_the_tables_of_their_starts(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STARTS", 20)
    own = bpe.PrefixBpe(RANKS, PATTERN)
    known, extend = [], own.extend
    own.extend = lambda last, piece: (known.append(len(last)), extend(last, piece))
    rng = random.Random(4)
    ends = [bytes(rng.choices(b"aeinrst\xc3\xa9", k=rng.randint(5, 20))) for _ in range(50)]
    for start in [b" unver", b" \xc3\xa9trang", b"xy"] + [b"abcde%c" % c for c in range(97, 123)]:
        for end in ends:
            piece = start + end
            expected = library._encode_single_piece(piece)
            assert (own.encode_piece(piece) if piece not in own.rank else expected) == expected
    assert len(own._starts) <= 20
    assert known.count(bpe.START_BYTES) > 0.9 * 50 * 29  # only what follows the start is new
    assert known.count(0) < 200
