"""Edges of single operators: letters, long words, strings of special tokens."""

import time

import pytest

pytest.importorskip("xspace.llm.queries")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from xspace.llm import language, pieces  # noqa: E402
from xspace.llm.tokens import ByteTokens  # noqa: E402


def test_number_signs_are_no_letters(spark):
    rows = [(i, ("the and of " if i % 2 else "der und ein ") * 5, "en" if i % 2 else "de") for i in range(200)]
    odd = [(900, "½ ½ ②"), (901, "² ¹ Ⅷ _ 12"), (902, "ª"), (903, "ʰ the and of"), (904, "日")]
    table = spark.createDataFrame([*rows, *[(i, t, None) for i, t in odd]], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(table, language.train(table)).collect()}
    assert [got[i].lang_pred == "und" for i, _ in odd] == [True, True, False, False, False]
    assert got[900].score == 0 and got[903].lang_pred == "en"


def test_long_words_take_linear_time():
    vocabulary = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    seconds = []
    for n in (50_000, 400_000):
        word = pieces.MARK + "abcdefgh☃" * (n // 9)
        start = time.perf_counter()
        (ids,) = vocabulary.encode_words([word]).values()
        seconds.append(time.perf_counter() - start)
        assert vocabulary.decode(ids) == word[1:]
    assert seconds[1] < 16 * seconds[0]


def test_strings_of_special_tokens_are_ordinary_text():
    """As the tokenizer's own documentation sets it up: a text cannot smuggle in an end of text."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    mine = ByteTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext"):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
