"""Spelling variants against brute force over all pairs and texts."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from token_ledger.llm import queries as registered
from token_ledger.llm import spelling as S

from ..oracle import SF


def _shorter(word):
    """Each word with one code point taken out or replaced by a mark; words that share one are an edit apart or equal."""
    return {(k, word[:k] + "*" + word[k + 1 :]) for k in range(len(word))}, {word[:k] + word[k + 1 :] for k in range(len(word))}


def _want(words, ratio=10):
    """Near words by what is left of words without a letter, then forms and roots."""
    replaced, without = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        a, b = _shorter(w)
        for x in a:
            replaced[x].add(w)
        for x in b:
            without[x].add(w)
    near = {w: set() for w in words}
    for group in replaced.values():
        for w in group:
            near[w] |= group - {w}
    for short, group in without.items():
        if short in near:
            for w in group:
                near[short].add(w), near[w].add(short)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def _rows(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _vocabulary(seed, size):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcdeéÿ\U0001f600") for _ in range(rng.randint(1, 7))): rng.choice([2, 3, 30, 400, 5_000]) for _ in range(size)}
    words |= {"".join(rng.sample("abcdefg", 7)): rng.choice([2, 40]) for _ in range(size // 4)}  # of one vector
    return words | {"": 7, "x" * 400: 2, "x" * 401: 30, "x" * 300 + "y": 2}


@pytest.mark.parametrize("leaf, top", [(16_000, 2_048), (20, 10_000), (3, 10_000), (20, 5)])
def test_variants_by_brute_force(spark, leaf, top):
    words = _vocabulary(leaf, 700)
    df = spark.createDataFrame([(w, n, "c") for w, n in words.items()], "word string, n long, form string")
    assert _rows(S.spelling_variants(df, leaf=leaf, top=top)) == _want(words)


def test_chains_ties_repeats_and_nulls(spark):
    rows = [("aaaaaaa", 5), ("aaaaaab", 20), ("aaaaaab", 30), ("aaaaabb", 500), ("aaaabbb", 50_000), ("aaabbbb", 500_000), ("ccccccc", 2), ("ccccccd", 20), ("cccccca", 20), ("lonely", 3), (None, 9), ("ddddddd", None)]
    got = {r["word"]: r for r in S.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert len(got) == 9
    assert (got["aaaaaaa"]["root"], got["aaaaaab"]["n"], got["aaaabbb"]["form"], got["aaabbbb"]["root"]) == ("aaabbbb", 50, "aaabbbb", "aaabbbb")
    assert (got["ccccccc"]["form"], got["ccccccc"]["form_n"], got["lonely"]["root"], got["lonely"]["n_near"]) == ("cccccca", 20, "lonely", 0)
    assert S.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def _edit(a, b):
    return S.one_edit(a, S.word_code(a), b, S.word_code(b))


def test_one_edit():
    near = [("", "a"), ("ab", "b"), ("ab", "ac"), ("aab", "ab"), ("abc", "abxc"), ("a", "a\0"), ("\0", ""), ("aa", "aaa"), ("é\U0001f600", "é")]
    far = [("", ""), ("a", "a"), ("ab", "ba"), ("ab", "abcd"), ("abc", "xby"), ("a\0\0", "a"), ("ab", "cab\0"), ("abc", "axyc")]
    assert all(_edit(a, b) and _edit(b, a) for a, b in near) and not any(_edit(a, b) or _edit(b, a) for a, b in far)
    rng = random.Random(9)
    for _ in range(20_000):
        a, b = ("".join(rng.choice("ab\0") for _ in range(rng.randint(0, 6))) for _ in range(2))
        inserted = {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in "ab\0"}
        replaced = {a[:k] + c + a[k + 1 :] for k in range(len(a)) for c in "ab\0"} - {a}
        deleted = {a[:k] + a[k + 1 :] for k in range(len(a))}
        assert _edit(a, b) == (b in inserted | replaced | deleted)


def test_reached_leaves_hold_every_vector_in_budget():
    rng = random.Random(1)
    vectors = {bytes(rng.randint(0, 2) for _ in range(4)) for _ in range(60)}
    top = {}
    for v in vectors:
        for k in range(2 if v[0] else 1):
            top.setdefault(v[:k], {})[v[k]] = 1
    for v in vectors:
        leaves = {node for node, _ in S.reached_leaves(top, v)}
        for w in vectors:
            off = [a - b for a, b in zip(w, v, strict=True) if a != b]
            if off in ([], [1], [-1], [1, -1], [-1, 1]):
                assert any(w.startswith(node) for node in leaves)


def _counted(docs, least=7):
    words = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                words[w] += 1
    return {w: n for w, n in words.items() if n >= 2}


def test_counts_of_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "Straße STRASSE Ärgernis ärgernis ÄRGERNIS multiplication×sign÷ a1bcdefgh"), (3, "Straße STRASSE Ärgernis ärgernis ÄRGERNIS multiplication×sign÷ a1bcdefgh"), (None, "nothing nothing"), (4, " ".join(f"word{chr(97 + k % 26)}{chr(97 + k % 17)}{chr(97 + k % 5)}" for k in range(20_000)))]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n int, word string")
    got = {r["word"]: r["n"] for r in S.count_words(df, change=registered.planted_typos).collect() if r["n"] >= 2}
    assert got == _counted(docs) and S.count_words(df.limit(0)).collect() == []


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert _rows(registered.op12_spelling_variants(spark, SF)) == _want(_counted(docs))
