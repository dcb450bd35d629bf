"""Spelling variants: words one edit apart, found in a trie of letter-count vectors.

A word is the vector of how many of its letters fall in each letter group, and the words
stand in a trie of those counts, one level for each group. One inserted, deleted or replaced
letter raises at most one count by one and lowers at most one by one, so the search goes down
the trie depth first with a budget of one surplus and one deficit; the words at the leaves
that it reaches are verified letter by letter.

The top of the trie, nodes of more than so many words, is a small table on every worker.
What hangs below each of its leaves is one task's trie: a word goes to its own leaf, and as
a query to those of the other leaves that its budget reaches and that come later. The
vocabulary is partitioned like this however large it is; no pair is a row, since a leaf gives
one row for each query and each of its own words: how many near words they have there and
which is the most frequent.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .runtime import small_batches, staged

#: A letter's group is its code point modulo this.
GROUPS = 16
#: Words below a leaf of the top, at most; all of a leaf's words may have one vector, then it is dealt in parts.
LEAF = 16_000
#: Nodes of each level of the top, at most.
TOP = 16_384
#: How much more frequent than a word its form is.
RATIO = 10
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: Words of a task that are counted before they are handed on.
HELD = 200_000
#: Words at a leaf of a task's trie.
BUCKET = 12
#: Levels of the top that one job counts.
STEP = 4


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, change: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """``word, n``: words of at least ``least_letters`` code points in all texts and how often they occur.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered. ``change``, if
    there is one, takes a document's id and its distinct words and gives what to count
    instead of each. Null and empty texts have no words; a null id is given as None; repeated
    rows count again. Other columns are not read. Counts are added up in each task first.
    """
    small_batches(df.sparkSession)
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            raw = K.LOWER[data].tobytes()
            for i, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                counts: dict[str, int] = {}
                for word in runs.findall(raw[lo:hi].decode()):
                    counts[word] = counts.get(word, 0) + 1
                words = change(i, list(counts)) if change else counts
                for word, n in zip(words, counts.values(), strict=True):
                    if len(word) >= least_letters:
                        total[word] = total.get(word, 0) + n
            if len(total) > HELD:
                yield told()
                total = {}
        if total:
            yield told()
        K.release_memory()

    counted = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: pa.Array, groups: int = GROUPS) -> np.ndarray:
    """A row for each word: how many of its code points fall in each group, at most 255."""
    texts = words.to_pylist()
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.minimum(np.bincount(row * groups + letters % groups, minlength=len(texts) * groups).reshape(len(texts), groups), 255)


def level_order(words: DataFrame, groups: int = GROUPS) -> list[int]:
    """Letter groups by how much their counts vary over all words, those that part most first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = letter_counts(batch.column(0), groups).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups)), pa.array(counts.sum(axis=0)), pa.array((counts * counts).sum(axis=0)), pa.array(np.full(groups, batch.num_rows))], ["level", "sums", "squares", "words"])

    sums = words.select("word").mapInArrow(run, "level long, sums long, squares long, words long").groupBy("level").agg(F.sum("sums").alias("a"), F.sum("squares").alias("b"), F.sum("words").alias("n"))
    spread = {r["level"]: r["b"] / r["n"] - (r["a"] / r["n"]) ** 2 for r in sums.collect()}
    return sorted(range(groups), key=lambda g: (-spread.get(g, 0), g))


def _with_vectors(words: DataFrame, order: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = letter_counts(batch.column(0), len(order))[:, order].astype(np.uint8).tobytes()
            vectors = pa.Array.from_buffers(pa.binary(len(order)), batch.num_rows, [None, pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], ["word", "n", "vector"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, vector binary")


Top = dict[bytes, dict[int, int]]


def top_of_trie(vectors: DataFrame, groups: int = GROUPS, leaf: int = LEAF, top: int = TOP) -> tuple[Top, int]:
    """(the children, with their words, of each node of more words than a leaf may have; that number).

    At most ``top`` nodes of a level are that large, whatever the size of the vocabulary.
    """
    total = vectors.count()
    leaf = max(leaf, -(-total // top))
    found: Top = {}
    if total <= leaf:
        return found, leaf
    distinct = vectors.groupBy("vector").agg(F.count(F.lit(1)).alias("n"))
    large = None
    for first in range(0, groups, STEP):
        rows = distinct
        if large is not None:  # only what lies below the large nodes so far
            rows = rows.join(F.broadcast(large), F.substring("vector", 1, first) == F.col("parent"), "left_semi")
        level = F.explode(F.sequence(F.lit(first + 1), F.lit(min(first + STEP, groups)))).alias("level")
        nodes = rows.select("vector", "n", level).groupBy(F.expr("substring(vector, 1, level)").alias("node")).agg(F.sum("n").alias("n"))
        parents = nodes.groupBy(F.expr("substring(node, 1, length(node) - 1)").alias("parent")).agg(F.sum("n").alias("n"), F.collect_list(F.struct("node", "n")).alias("children")).filter(F.col("n") > leaf)
        below = []
        for r in parents.collect():  # at most top nodes of each level, with a child for each count
            children = {c["node"][-1]: c["n"] for c in r["children"]}
            found[bytes(r["parent"])] = children
            below += [(bytes(c["node"]),) for c in r["children"] if len(c["node"]) == first + STEP and c["n"] > leaf]
        if not below:
            break
        large = vectors.sparkSession.createDataFrame(below, "parent binary")
    return found, leaf


def reached_leaves(top: Top, vector: bytes) -> Iterator[tuple[bytes, int]]:
    """(leaf of the top, its words) for every leaf within one surplus and one deficit of a vector's counts."""
    stack = [(b"", 1, 1, 0)]
    while stack:
        node, surplus, deficit, n = stack.pop()
        children = top.get(node)
        if children is None:
            yield node, n
            continue
        count = vector[len(node)]
        for child, more, less in ((count, surplus, deficit), (count + 1, surplus - 1, deficit), (count - 1, surplus, deficit - 1)):
            if more >= 0 and less >= 0 and child in children:
                stack.append((node + bytes([child]), more, less, children[child]))


def _dealt(vectors: DataFrame, top: Top, leaf: int) -> DataFrame:
    """``place, query, word, n, vector``: each word at its own place, and as a query at the later places that it reaches.

    Two near words of different places meet at the later one, where both are told.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 2_000):
                part = batch.slice(first, 2_000)
                row, place, query = [], [], []
                for i, (word, vector) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    places, own = [], None
                    for node, n in reached_leaves(nodes, vector):
                        shares = max(1, -(-n // leaf))  # more than one only where all words have one vector
                        found = [node + b"\xff" + str(share).encode() for share in range(shares)]
                        places += found
                        if vector.startswith(node):
                            own = found[zlib.crc32(word.encode()) % shares]
                    for at in places:
                        if at >= own:
                            row.append(i), place.append(at), query.append(at != own)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.binary()), pa.array(query), *(part.column(c).take(take) for c in range(3))], ["place", "query", "word", "n", "vector"])

    return vectors.mapInArrow(run, "place binary, query boolean, word string, n long, vector binary")


def word_code(word: str) -> int:
    """The word's code points in 32 bits each, the first one lowest."""
    return int.from_bytes(word.encode("utf-32-le", "surrogatepass"), "little")


def one_edit(a: str, code_a: int, b: str, code_b: int) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point, from where their codes first differ."""
    more = len(b) - len(a)
    off = code_a ^ code_b
    if not -2 < more < 2 or a == b:
        return False
    at = ((off & -off).bit_length() - 1) & ~31 if off else 32 * min(len(a), len(b))  # equal codes: one has zeros more
    if not more:
        return not off >> (at + 32)
    return code_b >> (at + 32) == code_a >> at if more > 0 else code_a >> (at + 32) == code_b >> at


def _halves(word: str) -> list[tuple[str, str]]:
    """The outer letters by which near words meet, from the front and from the end.

    Of two words one edit apart, of which the shorter has n letters, the first or the last
    n // 2 are the same; a word may be the shorter one or have a letter more.
    """
    n = len(word)
    return [(word[:h], word[n - h :]) for h in {n // 2, max(n - 1, 0) // 2}]


class Bucket:
    """Words at the end of a branch, by their outer letters."""

    __slots__ = ("first", "last")

    def __init__(self, words: list[tuple[str, int]]):
        self.first: dict[str, list[tuple[str, int, int]]] = {}
        self.last: dict[str, list[tuple[str, int, int]]] = {}
        for word, n in words:
            w = (word, n, word_code(word))
            for head, tail in _halves(word):
                self.first.setdefault(head, []).append(w)
                self.last.setdefault(tail, []).append(w)


def near_words(word: str, buckets: list[Bucket]) -> list[tuple[str, int]]:
    """Words of the buckets that are one edit from a word."""
    code, halves, near = word_code(word), _halves(word), {}
    for bucket in buckets:
        for head, tail in halves:
            if (same := bucket.first.get(head)) is not None:
                for other, n, own in same:
                    if one_edit(word, code, other, own):
                        near[other] = n
            if (same := bucket.last.get(tail)) is not None:
                for other, n, own in same:
                    if one_edit(word, code, other, own):
                        near[other] = n
    return list(near.items())


class Trie:
    """Words of one place by their counts on the levels below it; small sets of words end a branch."""

    def __init__(self, words: list[tuple[bytes, str, int]], level: int):
        self.level = level
        self.root = self._grow(words, level)

    @classmethod
    def _grow(cls, words: list[tuple[bytes, str, int]], level: int):
        if len(words) <= BUCKET or level == len(words[0][0]):
            return Bucket([(word, n) for _, word, n in words])
        parts: dict[int, list] = {}
        for w in words:
            parts.setdefault(w[0][level], []).append(w)
        return {count: cls._grow(part, level + 1) for count, part in parts.items()}

    def reached(self, vector: bytes, node: bytes) -> list[Bucket]:
        """Buckets within the budget of a vector, of which this place's node has spent some."""
        off = [node[k] - vector[k] for k in range(self.level)]
        stack, found = [(self.root, self.level, 1 - (1 in off), 1 - (-1 in off))], []
        while stack:
            at, level, surplus, deficit = stack.pop()
            if type(at) is Bucket:
                found.append(at)
                continue
            count = vector[level]
            if (below := at.get(count)) is not None:
                stack.append((below, level + 1, surplus, deficit))
            if surplus and (below := at.get(count + 1)) is not None:
                stack.append((below, level + 1, 0, deficit))
            if deficit and (below := at.get(count - 1)) is not None:
                stack.append((below, level + 1, surplus, 0))
        return found


class Place:
    """A place's own words and what has been found of them; queries come after all of its own words."""

    def __init__(self, name: bytes):
        self.node, self.own, self.trie = name[: name.index(b"\xff")], [], None
        self.found: dict[str, tuple[int, int, str]] = {}
        self.vector, self.buckets = None, []

    def _near(self, word: str, vector: bytes) -> list[tuple[str, int]]:
        if self.trie is None:
            self.trie = Trie(self.own, len(self.node))
        if vector != self.vector:  # words of one vector come one after the other and share the search
            self.vector, self.buckets = vector, self.trie.reached(vector, self.node)
        return near_words(word, self.buckets)

    def ask(self, word: str, n: int, vector: bytes) -> tuple[str, int, int, str] | None:
        """What a word of another place has here; its near words here are told of it as well."""
        near = self._near(word, vector) if self.own else []
        for other, _ in near:
            count, most, best = self.found.get(other, (0, 0, ""))
            self.found[other] = (count + 1, n, word) if (-n, word) < (-most, best) else (count + 1, most, best)
        return _told(word, near)

    def among(self) -> Iterator[tuple[str, int, int, str]]:
        """What its own words have among themselves."""
        for vector, word, _ in self.own:
            if row := _told(word, self._near(word, vector)):
                yield row


def _told(word: str, near: list[tuple[str, int]]) -> tuple[str, int, int, str] | None:
    if not near:
        return None
    best, n = min(near, key=lambda x: (-x[1], x[0]))
    return word, len(near), n, best


#: Rows that a task hands on at once.
ROWS = 20_000


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of every row, place by place; a place's own words come first, then its queries."""

    def rows() -> Iterator[tuple[str, int, int, str]]:
        name, place = None, None

        def end() -> Iterator[tuple[str, int, int, str]]:
            if place is not None:
                yield from place.among()
                yield from ((w, *found) for w, found in place.found.items())

        for batch in batches:
            for at, query, word, n, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != name:
                    yield from end()
                    name, place = at, Place(at)
                if not query:
                    place.own.append((vector, word, n))
                elif row := place.ask(word, n, vector):
                    yield row
        yield from end()

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    for part in itertools.batched(rows(), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), kinds, strict=True)], ["word", "near", "best_n", "best"])
    K.release_memory()


def spelling_variants(words: DataFrame, groups: int = GROUPS, leaf: int = LEAF, top: int = TOP, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary ``word, n``.

    ``n_near`` is the number of other words that differ by exactly one inserted, deleted or
    replaced code point. ``form`` is the near word of largest ``n`` (ties: the smallest in
    code-point order) if it has at least ``ratio`` times the word's own ``n``, and ``form_n``
    its ``n``; else both are null. ``root`` is where following forms ends, the word itself if
    it has none. Repeated words are added up; a null word or count is left out; the empty word
    is a word; a very long word counts at most 255 letters of a group, which loses no pair.
    Other columns are not read. An empty table gives an empty result.
    """
    small_batches(words.sparkSession)
    words = staged(words.filter("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    vectors = staged(_with_vectors(words, level_order(words, groups)), "spelling-vectors")
    nodes, leaf = top_of_trie(vectors, groups, leaf, top)
    dealt = _dealt(vectors, nodes, leaf).repartition("place").sortWithinPartitions("place", "query", "vector")
    found = dealt.mapInArrow(_search, "word string, near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best"))
    joined = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    formed = F.col("form_n") >= ratio * F.col("n")
    variants = staged(joined.select("word", F.when(formed, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n")), "spelling-variants")
    return variants.join(_roots(variants), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(variants: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: every round follows twice as many forms as the one before.

    A form is more frequent than its word, so there is no circle and the rounds end.
    """
    roots = staged(variants.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if roots.join(on, "root", "left_semi").isEmpty():
            return roots
        roots = staged(roots.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
