from pathlib import Path

import pytest

from cellspindle.llm.lexicon import Lexicon, compile_words
from cellspindle.llm.tokens import TOKENIZER, encode_corpus, token_sizes

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer files")
TEXTS = [
    None,
    "",
    " ",
    "   \n\n\t  x   ",
    "Hello world, hello  world's end. I'VE we'll",
    "<|endoftext|> ordinary <|endoftext|>",
    "naïve café — “quotes” … ① ²³ ½",
    "Привет, мир! 12345 67",
    "没有人知道小实验室为什么把细胞计数保留了692天。" * 20,
    "👩‍👩‍👧‍👦 🇩🇪 é ​﻿  　",
    "नमस्ते दुनिया ไทย العربية",
    "\x00\x01\x7f control",
    "a" * 5_000,
    "word " * 30_000,
    " " * 20_000 + "end",
    "Hello world, hello  world's end. I'VE we'll",
    "AACGTNNNNNACGGT" * 300,
]


def expected():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


@pytest.mark.parametrize("words", [65_536, 3, 0])
def test_equals_the_reference_encoder(spark, words):
    df = spark.createDataFrame([(i, t, 1, [2]) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in encode_corpus(df, df.doc_id, df.text, words=words).collect()}
    assert [got[i] for i in range(len(TEXTS))] == expected()
    if words == 3:
        sizes = {r.doc_id: r.n_tokens for r in token_sizes(df, df.doc_id, df.text, words=words).collect()}
        assert sizes == {i: len(x) for i, x in got.items()}


def test_empty_table_and_null_id(spark):
    df = spark.createDataFrame([(None, "hello")], "doc_id long, text string")
    assert encode_corpus(df, df.doc_id, df.text).first().doc_id is None
    assert encode_corpus(df.limit(0), df.doc_id, df.text).count() == 0


def test_lexicon(tmp_path):
    words = [b"ab", b"abc", b"b", b"bc", "né".encode(), b"xabc", b"yabc", b" the"]
    data = compile_words((w, [i] * (i % 3 + 1)) for i, w in enumerate(words))
    (tmp_path / "l").write_bytes(data)
    lex = Lexicon(str(tmp_path / "l"))
    at = lex.find([*words, b"a", b"abcd", b"", b"zz", b"xab"])
    assert list(at[len(words) :]) == [-1] * 5
    for i, k in enumerate(at[: len(words)]):
        assert list(lex.ids[lex.begin[k] : lex.begin[k + 1]]) == [i] * (i % 3 + 1)
    shared = len(lex.final)
    assert shared < 1 + sum(map(len, words))  # suffixes are shared
    (tmp_path / "e").write_bytes(compile_words([]))
    assert list(Lexicon(str(tmp_path / "e")).find([b"a"])) == [-1]
