"""Token counts against the library itself."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from token_ledger.llm import token_counts as T
from token_ledger.llm import queries as registered

from ..oracle import SF

FILE = path("byte_bpe_50k.json")
PARTS = [" ", " ", "\n", "\t", "a", "b", "s", "re", "ll", "'", "'s", "1", "2", "!", "-", "<|endoftext|>", "<|", "é", "中", "　", "\xa0", " ", "\x1c", "\x1f", "\u0085", "ſ", "́", "\U0001f600", "\r\n", "don't", "I'll", "\x00", "\x7f", "²", "​", "_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def _want(library, text):
    n = len(library.encode(text or "", add_special_tokens=False).ids)
    return len((text or "").encode()), n, n > 512


def test_pieces_of_odd_texts_add_up(library):
    with open(FILE, encoding="utf-8") as f:
        counter = T.Counter(f.read(), T.LengthTable.build({b" a": 1, b"!": 1}), 5_000)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    first, codes, pieces = T.distinct_pieces(pa.array(texts), T.special_strings(library))
    got = T.K.sum_by(first, counter.lengths(pieces.to_pylist())[codes])
    assert got.tolist() == [_want(library, t)[1] for t in texts]
    assert counter.cache.size <= 2_500 and all(len(k) <= T.LONGEST for k in counter.cache.young)


def test_hard_rows(spark, library):
    long = " ".join(f"w{i % 4999}," for i in range(20_000))
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, long), (4, "x" * 70_000), (5, "中" * 5_000), (6, "end <|endoftext|>\n\n<|endoftext|>x"), (7, " \t\n "), (8, "same"), (9, "same")]
    df = spark.createDataFrame([(*r, "t", 1, 2, "b") for r in rows], "doc_id long, text string, id string, n_tokens int, n_bytes int, body string").repartition(3)
    for entries in (1, 50):
        got = T.token_counts(df, FILE, entries=entries, cache_bytes=20_000).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *_want(library, t))) for i, t in rows)
    assert T.token_counts(df.limit(0), FILE).collect() == []


def test_frequent_pieces_cover_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "FAN", 2)
    rows = [(" often" * 5 + f" once{i}",) for i in range(500)]
    df = spark.createDataFrame(rows, "body string").repartition(7)
    found = T.frequent_pieces(df, [], entries=3)
    assert len(found) <= 3 and 2_000 <= found[b" often"] <= 2_500
    table = T.LengthTable.build({p: n for n, p in enumerate(found)})
    assert table.get([b"", b" never", *found]).tolist() == [-1, -1, *range(len(found))]


def test_table_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(T.K, "hash_bytes", lambda parts, n: np.zeros(n, np.uint64))
    table = T.LengthTable.build({b"a": 1, b"b": 2, b"c": 3})
    assert table.get([b"c", b"d", b"a", b"b", b"a"]).tolist() == [3, -1, 1, 2, 1]


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registered.op13_token_counts(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == _want(library, docs[r["doc_id"]])
