import numpy as np
import pytest

from xspace.operators.lookup import word_index
from xspace.sources import sinks, text


def lines_of(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "line_no bigint, value string")


@pytest.fixture
def small_splits(spark):
    # several splits per file, so that numbering has to cross them
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_in_file_order(spark, tmp_path, small_splits):
    for name, n in (("b.txt", 150), ("a.txt", 90)):
        (tmp_path / name).write_text("".join(f"{name}-{i}\n" for i in range(n)))
    got = text.ordered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    expected = [f"a.txt-{i}" for i in range(90)] + [f"b.txt-{i}" for i in range(150)]
    assert [r["value"] for r in got] == expected
    assert [r["line_no"] for r in got] == list(range(240))
    each = text.ordered_lines(spark, str(tmp_path), per_file=True).collect()
    assert all(r["value"].endswith(f"-{r['line_no']}") for r in each)


def test_vectors_round_trip_through_files(spark, vectors_of, rng, tmp_path, small_splits):
    m = rng.normal(size=(60, 4))
    m[0] = [1.0, 1e-7, 0.1234567891, -2.5e10]
    words = [f"w{i}" for i in range(60)]
    words[7] = "naïve"
    sinks.write_word2vec(vectors_of(m, words), str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    whole = "".join(p.read_text(encoding="utf-8") for p in parts).splitlines()
    assert whole[0] == "60 4"
    assert whole[1] == "w0 1 1e-07 0.123457 -2.5e+10"
    assert [line.split(" ")[0] for line in whole[1:]] == words
    got = text.read_word2vec(spark, str(tmp_path / "out")).orderBy("idx").collect()
    assert [r["word"] for r in got] == words
    assert [r["idx"] for r in got] == list(range(60))
    expected = [[float("%.6g" % x) for x in row] for row in m]
    assert [r["vec"] for r in got] == expected
    few = text.read_word2vec(spark, str(tmp_path / "out"), threshold=5, precision="fp32")
    assert few.count() == 5
    assert few.schema["vec"].dataType.simpleString() == "array<float>"


def test_other_encodings(spark, tmp_path):
    (tmp_path / "v.txt").write_bytes("1 2\ncafé 0.5 1\n".encode("latin-1"))
    emb = text.read_word2vec(spark, str(tmp_path / "v.txt"), encoding="latin-1")
    assert emb.first()["word"] == "café"
    sinks.write_word2vec(emb, str(tmp_path / "out"), "latin-1")
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part*")))
    assert written == "1 2\ncafé 0.5 1\n".encode("latin-1")
    with pytest.raises(ValueError, match="encoding"):
        text.read_word2vec(spark, str(tmp_path / "v.txt"), encoding="utf-16")


def test_bytes_outside_the_encoding_survive(spark, tmp_path):
    raw = b"2 2\nab\xff 1 2\nc 3 4\n"
    (tmp_path / "v.txt").write_bytes(raw)
    emb = text.read_word2vec(spark, str(tmp_path / "v.txt"))
    sinks.write_word2vec(emb, str(tmp_path / "out"))
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part*")))
    assert written == raw


WORDS = {
    "gbk": "词语",
    "gb18030": "词𠀀",
    "shift_jis": "表示ソ",  # second bytes that are ASCII letters and backslashes
    "big5": "許功蓋",
    "euc-kr": "단어",
    "iso2022_jp": "言葉",
    "cp1251": "слово",
    "utf-16": "wörd𝔸",
    "utf-16-le": "上਍",  # units with the bytes of line breaks in them
    "utf-16-be": "上਍",
    "utf-32": "wörd𝔸",
}


@pytest.mark.parametrize("encoding", list(WORDS))
def test_lines_of_any_encoding_round_trip(spark, tmp_path, small_splits, encoding):
    words = [f"{WORDS[encoding]}{i}" for i in range(90)]
    raw = ("90 2\n" + "".join(f"{w} {i} 0.5\n" for i, w in enumerate(words))).encode(encoding)
    (tmp_path / "v.txt").write_bytes(raw)
    emb = text.read_word2vec(spark, str(tmp_path / "v.txt"), encoding=encoding)
    rows = emb.orderBy("idx").collect()
    assert [r["word"] for r in rows] == words and [r["idx"] for r in rows] == list(range(90))
    few = text.read_word2vec(spark, str(tmp_path / "v.txt"), 7, encoding=encoding)
    assert [r["word"] for r in few.orderBy("idx").collect()] == words[:7]
    sinks.write_word2vec(emb, str(tmp_path / "out"), encoding)
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part*")))
    assert written == raw


@pytest.mark.parametrize("encoding", ["ascii", "gbk", "euc-kr", "cp1252"])
def test_bytes_outside_any_encoding_survive(spark, tmp_path, encoding):
    raw = b"3 2\nab\xff 1 2\n\x81 5 6\nc 3 4\n"
    (tmp_path / "v.txt").write_bytes(raw)
    emb = text.read_word2vec(spark, str(tmp_path / "v.txt"), encoding=encoding)
    sinks.write_word2vec(emb, str(tmp_path / "out"), encoding)
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part*"))) == raw


def test_line_breaks_of_wide_units(spark, tmp_path, small_splits):
    lines = [f"line {i} \ud800" if i % 7 == 0 else f"line {i}" for i in range(120)]
    for name, mark, codec in (("a.txt", "\ufeff", "utf-16-be"), ("b.txt", "", "utf-16-le")):
        joined = mark + "".join(x + ("\r\n", "\n", "\r")[i % 3] for i, x in enumerate(lines))
        (tmp_path / name).write_bytes(joined.encode(codec, "surrogatepass"))
    got = text.ordered_lines(spark, str(tmp_path), "utf-16").selectExpr("line_no", "CAST(value AS binary) AS v")
    expected = [x.encode("utf-8", "surrogatepass") for x in lines] * 2
    assert [bytes(r["v"]) for r in got.orderBy("line_no").collect()] == expected


@pytest.mark.parametrize("encoding", ["cp037", "hz", "no such codec"])
def test_encodings_whose_lines_cannot_be_found_are_refused(spark, tmp_path, encoding):
    (tmp_path / "v.txt").write_text("1 1\na 1\n")
    with pytest.raises(ValueError, match="encoding"):
        text.read_word2vec(spark, str(tmp_path / "v.txt"), encoding=encoding)


def test_header_and_line_checks(spark):
    good = lines_of(spark, ["2 3", "a 1 2 3 ", "b 4  5 6", "c 7 8"])
    got = text.parse_word2vec_lines(good).orderBy("idx").collect()
    assert [(r["word"], r["vec"]) for r in got] == [("a", [1, 2, 3]), ("b", [4, 5, 6])]
    short = lines_of(spark, ["5 3", "a 1 2 3"])
    with pytest.raises(ValueError, match="promises 5"):
        text.parse_word2vec_lines(short)
    assert text.parse_word2vec_lines(short, threshold=1).count() == 1
    with pytest.raises(ValueError, match="first line"):
        text.parse_word2vec_lines(lines_of(spark, ["a b"]))
    bad = lines_of(spark, ["3 2", "a 1 2", "b 1", "c x 2"])
    with pytest.raises(Exception, match="malformed vector line"):
        text.parse_word2vec_lines(bad).collect()
    kept = text.parse_word2vec_lines(bad, mode="PERMISSIVE").orderBy("idx").collect()
    assert [r["_corrupt_record"] for r in kept] == [None, "b 1", "c x 2"]


def test_vocabulary_filter_renumbers(spark):
    lines = lines_of(spark, ["4 1", "a 1", "b 2", "c 3", "b 4"])
    words = spark.createDataFrame([("b",), ("c",), ("z",)], "word string")
    got = text.parse_word2vec_lines(lines, vocabulary=words).orderBy("idx").collect()
    assert [(r["idx"], r["word"], r["vec"]) for r in got] == [
        (0, "b", [2]),
        (1, "c", [3]),
        (2, "b", [4]),
    ]
    emb = text.parse_word2vec_lines(lines)
    assert dict(word_index(emb).collect())["b"] == 3


def test_dictionary_lines(spark):
    got = text.parse_dictionary_lines(lines_of(spark, [" a\tb ", "c d", "e   f"]))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [
        ("a", "b"),
        ("c", "d"),
        ("e", "f"),
    ]
    for line in ("a", "a b c", ""):
        with pytest.raises(Exception, match="not two words"):
            text.parse_dictionary_lines(lines_of(spark, [line])).collect()


def test_similarity_files(spark, tmp_path):
    (tmp_path / "en-de.rg.v2.txt").write_text("Car\tAuto\t3.5\nA b\tC\t 1e1\n")
    (tmp_path / "other+set").write_text("x\ty\t0\n")
    paths = [str(p) for p in tmp_path.iterdir()]
    got = sorted(tuple(r) for r in text.read_similarity(spark, paths, True).collect())
    assert got == [
        ("en-de.rg.v2", 0, "car", "auto", 3.5),
        ("en-de.rg.v2", 1, "a b", "c", 10.0),
        ("other+set", 0, "x", "y", 0.0),
    ]
    lines = spark.createDataFrame([("d", 0, "a\tb")], "dataset string, line_no int, value string")
    with pytest.raises(Exception, match="not word, word, score"):
        text.parse_similarity_lines(lines).collect()


def test_analogy_lines(spark):
    rows = [": Capitals x", "A b c d", "a b c", ": gram1", "e f g h", "a b c d e"]
    got = text.parse_analogy_lines(lines_of(spark, rows), lowercase=True)
    got = [tuple(r) for r in got.orderBy("line_no").collect()]
    assert got == [
        (1, "Capitals x", False, "a", "b", "c", "d", None),
        (2, "Capitals x", False, None, None, None, None, "a b c"),
        (4, "gram1", True, "e", "f", "g", "h", None),
        (5, "gram1", True, None, None, None, None, "a b c d e"),
    ]
    with pytest.raises(Exception, match="before any category, line 0"):
        text.parse_analogy_lines(lines_of(spark, ["a b c d", ": x"])).collect()


def test_training_log_lines(spark):
    rows = [(1, 50.0, 90.0, None, None, None, 2.0), (2, 60.0, 80.0, 1.0, 2.0, 3.0, 0.5)]
    log = sinks.training_log(spark, rows)
    got = [r["value"] for r in sinks.format_training_log(log).orderBy("iteration").collect()]
    assert got == [
        "1\t50.000000\t\t2.000000",
        "2\t60.000000\t1.000000\t2.000000\t3.000000\t0.500000",
    ]


def test_set_precision(vectors_of):
    emb = text.set_precision(vectors_of(np.eye(2)), "fp32")
    assert emb.schema["vec"].dataType.simpleString() == "array<float>"


def test_no_line_is_lost_when_files_are_split_anew(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        lines = text.ordered_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        got = lines.orderBy("line_no").collect()
    finally:
        for key in ("openCostInBytes", "maxPartitionBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert [(r["line_no"], r["value"]) for r in got] == [(i, f"line {i}") for i in range(3000)]


def test_ranges_hold_every_line_once(spark, tmp_path, small_splits):
    ends, pieces = [b"\n", b"\r\n", b"\r", b"\n\n", b"\n\r"], []
    for k in range(400):
        pieces.append((b"line %d " % k) * (k % 7) + ends[k % 5])
    for name, raw in (("b 1#.txt", b"".join(pieces)), ("a+é.txt", b"".join(pieces[::3]) + b"no end"), ("c.txt", b""), ("_x", b"hidden")):
        (tmp_path / name).write_bytes(raw)
    got = text.ordered_lines(spark, str(tmp_path)).collect()
    expected = (b"".join(pieces[::3]) + b"no end").splitlines() + b"".join(pieces).splitlines()
    assert [r["value"].encode() for r in sorted(got, key=lambda r: r["line_no"])] == expected
    assert sorted(r["line_no"] for r in got) == list(range(len(expected)))
    each = text.ordered_lines(spark, str(tmp_path), per_file=True).orderBy("file", "line_no").collect()
    assert [r["line_no"] for r in each].count(0) == 2
    named = text.ordered_lines(spark, str(tmp_path)).select(text.dataset_name(text.F.col("file")).alias("d")).distinct()
    assert {r["d"] for r in named.collect()} == {"a+é", "b 1#"}


def test_compressed_files_go_through_the_text_reader(spark, tmp_path):
    import gzip

    (tmp_path / "v.txt.gz").write_bytes(gzip.compress(b"2 2\na 1 2\nb 3 4\n"))
    got = text.read_word2vec(spark, str(tmp_path / "v.txt.gz")).orderBy("idx").collect()
    assert [(r["idx"], r["word"], r["vec"]) for r in got] == [(0, "a", [1, 2]), (1, "b", [3, 4])]


def test_threshold_reads_a_prefix_of_bytes(spark, tmp_path, small_splits):
    from xspace.sources import lines

    rows = "".join(f"w{i} {i} {i + 1}\n" for i in range(3000))
    (tmp_path / "v.txt").write_text("3000 2\n" + rows)
    size = (tmp_path / "v.txt").stat().st_size
    few = lines.line_ranges(spark, str(tmp_path / "v.txt"), most=101)
    assert few[-1].end < size / 10 and few[0].first == 0
    everything = lines.line_ranges(spark, str(tmp_path / "v.txt"))
    assert everything[-1].end == size and few == everything[: len(few)]
    # nothing behind the prefix is parsed, or even there
    (tmp_path / "v.txt").write_text("3000 2\n" + rows[: size // 2] + "\nbroken line\n")
    got = text.read_word2vec(spark, str(tmp_path / "v.txt"), threshold=100).orderBy("idx").collect()
    assert [(r["word"], r["vec"]) for r in got] == [(f"w{i}", [i, i + 1]) for i in range(100)]


def test_vocabulary_is_joined_before_numbers_are_parsed(spark, tmp_path):
    rows = [f"w{i} {i} {i + 1}" for i in range(200)]
    rows[50] = "w50 not numbers"
    (tmp_path / "v.txt").write_text("200 2\n" + "\n".join(rows) + "\n")
    words = spark.createDataFrame([("w7",), ("w120",), ("w199",), ("zzz",), ("w7",)], "word string")
    emb = text.read_word2vec(spark, str(tmp_path / "v.txt"), vocabulary=words)
    assert [(r["idx"], r["word"], r["vec"]) for r in emb.orderBy("idx").collect()] == [
        (0, "w7", [7, 8]), (1, "w120", [120, 121]), (2, "w199", [199, 200])
    ]
    plan = emb._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("try_cast") < plan.index("LeftSemi")  # nearer to the root: later
    assert "parquet" not in plan.lower()  # no copy of the text
