"""Periodic runs of words, found with a suffix automaton and link-cut access.

A run is a stretch of consecutive words with smallest period q, of at least ``4 * q`` words
(and six), that cannot be extended. The suffix automaton of the words gives the tree of
suffix links. Words are then appended one by one: appending word i recolours the path from
the node of the prefix that ends there up to the root with i, the last end of every
substring on it. A link-cut forest keeps the paths of one colour together, so recolouring
meets each segment of an older colour e once, and there are O(n log n) of them in all. If
the longest substring of such a segment has at least ``i - e`` words, the last ``2 * (i - e)``
words are a square, and a square is extended to its run. Every square of a primitive word is
met like this, because the last occurrence of the word before i ends exactly a period
earlier.

Documents are independent, so this is one pass without a shuffle. Array work over a whole
batch first sets aside words that no such run can hold: in a run, every four words in a row
occur again within a quarter of it. Only what stays, in stretches, goes to the automaton, and
there words are compared by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .runtime import small_batches

LEAST_WORDS = 6
EXPONENT = 4
#: Words in a row that a run of the least length repeats.
GRAM = 4
#: Rounds of setting words aside; more would only save the automaton work.
ROUNDS = 6


def suffix_links(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of the words: (parent of each state, its longest length, state of each prefix). The root is state 0."""
    after: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], []
    last = 0
    for word in words:
        state = len(length)
        length.append(length[last] + 1)
        after.append({})
        link.append(0)
        p = last
        while p >= 0 and word not in after[p]:
            after[p][word] = state
            p = link[p]
        if p >= 0:
            q = after[p][word]
            if length[q] != length[p] + 1:  # the shorter part of q gets a state of its own
                clone = len(length)
                length.append(length[p] + 1)
                after.append(after[q].copy())
                link.append(link[q])
                link[q] = clone
                while p >= 0 and after[p].get(word) == q:
                    after[p][word] = clone
                    p = link[p]
                q = clone
            link[state] = q
        ends.append(state)
        last = state
    return link, length, ends


class LastEnds:
    """Link-cut forest over the suffix links: preferred paths are those of one last end, kept in splay trees by depth.

    The root is left out, as it stands for no words. A path's colour is kept at the root of
    its splay tree.
    """

    def __init__(self, link: list[int]):
        n = len(link)
        self.up = [p if p > 0 else -1 for p in link]
        self.left, self.right, self.colour = [-1] * n, [-1] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b >= 0:
            up[b] = y
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[x], up[y] = z, x

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                colour[x] = colour[z]  # the root's colour goes on to the next root; the last step sees the root
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            else:
                colour[x] = colour[y]
            self._rotate(x)

    def access(self, x: int, end: int) -> Iterator[tuple[int, int]]:
        """Colours the path from x to its top with ``end``; gives (old end, deepest state) of each segment that had one."""
        up, right, colour = self.up, self.right, self.colour
        last = -1
        while x >= 0:
            self._splay(x)
            if colour[x] >= 0:
                yield colour[x], x
            if right[x] >= 0:
                colour[right[x]] = colour[x]
            right[x] = last
            last, x = x, up[x]
        colour[last] = end


def _primitive(words: list[int], start: int, period: int) -> bool:
    block = words[start : start + period]
    return not any(period % q == 0 and block == block[:q] * (period // q) for q in range(1, period // 2 + 1))


def stretch_runs(words: list[int], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and ``exponent`` periods."""
    n = len(words)
    link, longest, ends = suffix_links(words)
    paths, done, out = LastEnds(link), {}, []
    for i, state in enumerate(ends):
        for end, deepest in paths.access(state, i):
            d = i - end
            if longest[deepest] < d or exponent * d > n or done.get(d, -1) >= i:
                continue
            lo, hi = i - 2 * d + 1, i
            while lo > 0 and words[lo - 1] == words[lo - 1 + d]:
                lo -= 1
            while hi + 1 < n and words[hi + 1] == words[hi + 1 - d]:
                hi += 1
            done[d] = hi
            size = hi - lo + 1
            if size >= max(least, exponent * d) and _primitive(words, lo, d):
                out.append((lo, size, d))
    return out


def _gaps(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far from each of the ascending places the nearest other place with its key is."""
    order = np.argsort(key, kind="stable")
    far = np.iinfo(np.int64).max
    k, a = key[order], at[order]
    step = np.where(k[1:] == k[:-1], a[1:] - a[:-1], far)
    near = np.full(at.size, far)
    near[1:] = step
    near[:-1] = np.minimum(near[:-1], step)
    out = np.empty_like(near)
    out[order] = near
    return out


def stretches(words: K.Words, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """(first word, end word) of stretches of one document that may hold runs; no run lies elsewhere or crosses an end."""
    first, value = K.windows(words, GRAM)
    part, size = words.doc[first], np.diff(words.bounds)
    for _ in range(ROUNDS):
        if not first.size:
            return []
        near = _gaps(value ^ K.mix(part.astype(np.uint64) + np.uint64(1)), first)
        alive = near <= size[part] // exponent
        ended = alive.all()
        first, value, part = first[alive], value[alive], part[alive]
        start = np.ones(first.size, dtype=bool)
        start[1:] = (np.diff(first) != 1) | (np.diff(part) != 0)
        part = np.cumsum(start) - 1
        grams = np.bincount(part)
        size = grams + GRAM - 1
        keep = (size >= least)[part]
        if not keep.all():
            first, value, part = first[keep], value[keep], part[keep]
            ended = False
        if ended:
            break
    if not first.size:
        return []
    lows = np.flatnonzero(np.r_[True, np.diff(part) != 0])
    highs = np.r_[lows[1:], first.size] - 1
    return list(zip(first[lows].tolist(), (first[highs] + GRAM).tolist(), strict=True))


_OUT = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def word_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """``id_col, n_words, runs, collapsed``, one row per input row.

    ``runs`` are (start, length, period) in words from 0, by start and then period;
    ``collapsed`` is the text without what a run repeats, its words joined by one blank: of a
    run, the words after the first period go. ``least`` is at least 6 and ``exponent`` at
    least 4. A null, empty or blank text has no words, no runs and an empty collapsed text.
    Rows are independent: repeated rows and ids give repeated results, a null id stays null.
    A very long text is handled whole, alone; memory grows with its longest stretch of
    repeated words. Other columns are not read, so their names do not matter. An empty table
    gives an empty result.
    """
    if least < LEAST_WORDS or exponent < EXPONENT:
        raise ValueError(f"runs of fewer than {LEAST_WORDS} words or {EXPONENT} periods are not found")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words in K.batch_words(batch.column(1)):
                found: dict[int, list[tuple[int, int, int]]] = {}
                doc = words.doc
                for lo, hi in stretches(words, least, exponent):
                    numbers: dict[bytes, int] = {}
                    told = [numbers.setdefault(words.raw[a:b], len(numbers)) for a, b in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist(), strict=True)]
                    d = int(doc[lo])
                    base = lo - int(words.bounds[d])
                    found.setdefault(d, []).extend((base + s, n, q) for s, n, q in stretch_runs(told, least, exponent))
                runs, texts = [], []
                for d, (lo, hi) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)):
                    own = words.raw[lo:hi].split()
                    spans = sorted(found.get(d, ()), key=lambda r: (r[0], r[2]))
                    if spans:
                        drop = np.zeros(len(own), dtype=bool)
                        for s, n, q in spans:
                            drop[s + q : s + n] = True
                        own = [w for w, gone in zip(own, drop.tolist(), strict=True) if not gone]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in spans])
                    texts.append(b" ".join(own))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(words.counts.astype(np.int64)), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])
        K.release_memory()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, {_OUT}").withColumnRenamed("id", id_col)
