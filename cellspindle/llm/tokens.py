"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 6).

The words of the corpus are counted over all documents; the most frequent ones, with the ids the merges give them, are
compiled into a minimal acyclic transducer (``lexicon``), which is written to the shared folder, fetched once per
executor and memory-mapped by its Python workers. A batch's words are made distinct, looked up together, and only words
the lexicon has not seen are merged, exactly. The result does not depend on the lexicon's size.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspindle.llm.lexicon import Lexicon, compile_words
from cellspindle.session import spread, write_shared_bytes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 65_536
LONGEST_ENTRY = 48  # bytes
BLOCK = 2_000_000  # characters encoded at once


@lru_cache(maxsize=2)
def _merger(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=WORDS, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(WORDS).findall


@lru_cache(maxsize=4)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def _blocks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK characters."""
    lo = held = 0
    for hi, t in enumerate(texts):
        held += len(t or "")
        if held >= BLOCK:
            yield lo, hi + 1
            lo, held = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = _splitter()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lo, hi in _blocks(texts):
            seen = Counter(chain.from_iterable(split(t) for t in texts[lo:hi] if t))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


class CorpusTokenizer:
    """Encoder of one corpus: counts its words, compiles the lexicon and hands out the Arrow functions."""

    def __init__(self, df: DataFrame, text: Column, tokenizer: str = TOKENIZER, words: int = LEXICON_WORDS):
        spark = df.sparkSession
        with open(tokenizer, "rb") as f:
            ranks = f.read()
        frequent = (
            spread(df.select(text.alias("text")))
            .mapInArrow(_count_words, "word string, n long")
            .groupBy("word")
            .agg(F.sum("n").alias("n"))
            .where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST_ENTRY))
            .orderBy(F.desc("n"), "word")
            .limit(words)
            .select("word")
            .collect()  # at most ``words`` rows of at most LONGEST_ENTRY bytes
        )
        encode = _merger(ranks).encode_ordinary
        uri = write_shared_bytes(spark, compile_words((r.word.encode(), encode(r.word)) for r in frequent), "lexicon.bin")
        spark.sparkContext.addFile(uri)
        self.name = os.path.basename(uri)
        self.ranks = spark.sparkContext.broadcast(ranks)

    def rows(self, ids: bool):
        """mapInArrow function: (id, text) -> (id, ids) or (id, n_tokens)."""
        name, ranks = self.name, self.ranks

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon, split, merge = _lexicon(name), _splitter(), _merger(ranks.value).encode_ordinary
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in _blocks(texts):
                    begin, flat = _encode(texts[lo:hi], lexicon, split, merge)
                    out = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat)) if ids else pa.array(np.diff(begin).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), out], names=["doc_id", "ids" if ids else "n_tokens"])

        return encode


def _encode(texts: list, lexicon: Lexicon, split, merge) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts in the ids of the block, and the ids."""
    pieces = [split(t) if t else [] for t in texts]
    codes, words = pd.factorize(np.array([*chain.from_iterable(pieces), ""], object)[:-1])
    ends = np.cumsum([0, *map(len, pieces)])
    at = lexicon.find([w.encode() for w in words])
    unseen = np.flatnonzero(at < 0)
    merged = [merge(words[i]) for i in unseen]
    sizes = np.zeros(len(words), np.int64)
    starts = np.zeros(len(words), np.int64)
    seen = at >= 0
    starts[seen] = lexicon.begin[at[seen]]
    sizes[seen] = lexicon.begin[at[seen] + 1] - starts[seen]
    sizes[unseen] = [len(m) for m in merged]
    starts[unseen] = len(lexicon.ids) + np.cumsum(sizes[unseen]) - sizes[unseen]
    pool = np.concatenate([lexicon.ids, np.fromiter(chain.from_iterable(merged), np.int32)])
    n = sizes[codes]
    stops = np.concatenate([[0], np.cumsum(n)])
    flat = pool[np.repeat(starts[codes] - stops[:-1], n) + np.arange(stops[-1])]
    return stops[ends], flat


def encode_corpus(df: DataFrame, doc_id: Column, text: Column, tokenizer: str = TOKENIZER, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids) of every row.

    Defined cases: a null or empty text has the empty list; the strings of special tokens are ordinary text; repeated
    rows and null ids are kept; very long texts are encoded whole; empty table: no rows; clashing column names do no harm.
    """
    coder = CorpusTokenizer(df, text, tokenizer, words)
    return spread(df.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))).mapInArrow(coder.rows(True), "doc_id long, ids array<int>")


def token_sizes(df: DataFrame, doc_id: Column, text: Column, tokenizer: str = TOKENIZER, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens) of every row, 0 for a null or empty text."""
    coder = CorpusTokenizer(df, text, tokenizer, words)
    return spread(df.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))).mapInArrow(coder.rows(False), "doc_id long, n_tokens int")
