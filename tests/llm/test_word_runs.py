"""Periodic runs against brute force over every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from token_ledger.llm import queries as registered
from token_ledger.llm import textkit as K
from token_ledger.llm import word_runs as W

from ..oracle import SF


def _runs(w, least=6, exponent=4):
    """Maximal stretches of equal words q apart, for every q, without those that have a smaller period."""
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def _random(rng):
    w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 70))]
    for _ in range(rng.randint(0, 2)):
        if len(w) > 12:
            s, p = rng.randrange(len(w) - 5), rng.randint(1, 9)
            for i in range(s + p, min(len(w), s + rng.randint(4, 7) * p)):
                w[i] = w[i - p]
    return w


def test_stretches_and_runs_by_brute_force():
    rng = random.Random(4)
    for _ in range(1_500):
        w = _random(rng)
        assert sorted(W.stretch_runs(w), key=lambda r: (r[0], r[2])) == _runs(w)
        words = K.split_words(*K.text_buffers(pa.array(["before x", " ".join(map(str, w)), "0 0 0 0 0 0 0"])))
        found, base = [], int(words.bounds[1])
        for lo, hi in W.stretches(words):
            if words.doc[lo] == 1:
                found += [(lo - base + s, n, q) for s, n, q in W.stretch_runs(w[lo - base : hi - base])]
        assert sorted(found, key=lambda r: (r[0], r[2])) == _runs(w)


def test_last_ends_are_those_of_all_substrings():
    rng = random.Random(5)
    for _ in range(150):
        w = [rng.randrange(2) for _ in range(rng.randint(1, 30))]
        link, longest, ends = W.suffix_links(w)
        paths = W.LastEnds(link)
        for i, state in enumerate(ends):
            segments = list(paths.access(state, i))
            for length in range(1, i + 2):
                before = max((e for e in range(length - 1, i) if w[e - length + 1 : e + 1] == w[i - length + 1 : i + 1]), default=None)
                told = max((e for e, deepest in segments if longest[deepest] >= length), default=None)
                assert before == told


def test_long_texts_take_little_more_than_linear_time():
    for period in (1, 7, 300):
        assert W.stretch_runs([i % period for i in range(40_000)]) == [(0, 40_000, period)]


def test_hard_rows(spark):
    long = [f"w{i}" for i in range(9_000)] + [f"v{i % 100}" for i in range(11_000)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "a b\ta b\na b a b"), (6, " ".join(long)), (7, "é 中 é 中 é 中 é 中 é x" + " x" * 9), (8, "a b" * 3 + " c")]
    df = spark.createDataFrame([(*r, "t", [1], "b") for r in rows], "doc_id long, text string, id string, runs array<int>, body string")
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        runs = _runs(w) if len(w) < 100 else [(9_000, 11_000, 100)]
        want.append(repr((i, len(w), [tuple(r) for r in runs], _collapsed(w, runs).decode())))
    got = [repr((r[0], r[1], [tuple(x) for x in r[2]], r[3])) for r in W.word_runs(df).collect()]
    assert sorted(got) == sorted(want)
    assert W.word_runs(df.limit(0)).collect() == []
    assert [r["runs"] for r in W.word_runs(df.filter("doc_id = 5"), least=7).collect()] == [[], []]
    with pytest.raises(ValueError):
        W.word_runs(df, exponent=3)


def _looped(i, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registered.op11_word_runs(spark, SF).collect()
    assert len(got) == len(docs) and any(r["n_runs"] for r in got)
    for r in got:
        w = _looped(r["doc_id"], docs[r["doc_id"]])
        if len(w) > 1_500:  # every period of every long text is too much to try; its numbers are checked by the others
            continue
        runs = _runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        told = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *told), r["doc_id"]
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(_collapsed(w, runs)).hexdigest()
