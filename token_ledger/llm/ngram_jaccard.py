"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A document is its set of five-word shingles. Documents with equal sets form a class, and one
representative of each class goes on. A representative has a MinHash signature, cut into one
label for each tree; a tree is the trie of its labels, kept as tables of label prefixes with
counts. Matching starts at whole labels. A representative that has met others in so many
trees that a neighbour no nearer than those would be missed with at most the probability
``1 - target_recall`` stays at that depth; for the others the prefix is shortened by one, and
so on, down to the depth at which any pair at the threshold meets with that probability. So
lonely documents search the shortest prefixes, where they meet next to nothing, and members
of dense groups the longest.

Representatives that meet form components (of meetings, not of similar pairs). A small
component is verified at once. A larger one whose members met few others each (a
chain of chance meetings) is verified by the groups that met, a pair where it met first; a
larger one that is dense is verified as a whole, which is less work. A block holds 2,000
representatives, and up to 4,000 where that keeps a component within eight blocks, so sets
are sent a bounded number of times until a dense component is larger than 32,000. What is
larger than a block is parted by set size, since similar sets have sizes of one class or of two
neighbouring ones, and then into blocks. Every pair of a block, or of two blocks, is verified
exactly, and pairs are counted where they are found and never become rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from . import textkit as K
from .components import connected_components
from .runtime import small_batches, staged

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 36
MAX_DEPTH = 8
TARGET_RECALL = 0.9999
#: Representatives in a block, and shingles in it; a larger component is verified block against block.
BLOCK, BLOCK_SHINGLES = 2_000, 1 << 21
#: A component of more representatives is verified by the groups that met, where these hold fewer pairs than it has itself.
SPARSE_FROM = 250
#: A component of more than a block has so many blocks, of up to so many times the size; beyond that, more blocks.
BLOCKS, GROWTH = 8, 2
SALTS = 48

_SEED = 20240612
#: Bytes of a label for each of its hashes.
_WIDTH = 2


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair of similarity ``threshold`` meets in some tree with probability ``target``."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def trees_enough(trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """In how many trees a representative has to meet others for its prefixes to be short enough."""
    return next((m for m in range(1, trees + 1) if 1 - (1 - m / trees) ** trees >= target), trees)


def shingle_sets(words: K.Words, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer than k words are one shingle, no words none."""
    first, value = K.windows(words, k)
    cut = np.searchsorted(first, words.bounds)
    for d, n in enumerate(words.counts):
        if n >= k:
            yield np.unique(value[cut[d] : cut[d + 1]])
        elif n:
            lo = words.bounds[d]
            yield np.array([xxh3_64_intdigest(words.hashes[lo : lo + n].tobytes())], dtype=np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a sorted set, as signed numbers."""
    one, two = np.frombuffer(xxh3_128_digest(shingles.tobytes()), dtype=np.int64).tolist()
    return one, two


class Forest:
    """MinHash labels of a set: one string of hashes for each tree, so that a prefix of the string is a prefix of the label."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.RandomState(_SEED)
        self.a = rng.randint(0, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.randint(0, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32)

    def labels(self, shingles: np.ndarray) -> bytes:
        """The labels of all trees in a row, the low 16 bits of each hash."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.a.size, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, x.size, 1024):
            np.minimum(low, (x[at : at + 1024, None] * self.a + self.b).min(axis=0), out=low)
        return low.astype("<u2").tobytes()


def _sketch(trees: int, depth: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees, depth)
        for batch in batches:
            for first, end, words in K.batch_words(batch.column(3)):
                size, key, key2, labels = [], [], [], []
                for s in shingle_sets(words, k):
                    one, two = set_keys(s)
                    size.append(s.size), key.append(one), key2.append(two), labels.append(forest.labels(s) if s.size else b"")
                n, wide, flat = end - first, _WIDTH * depth, b"".join(labels)
                cut = np.array([0, *itertools.accumulate(len(x) // wide for x in labels)], dtype=np.int32)
                flat = pa.Array.from_buffers(pa.binary(wide), len(flat) // wide, [None, pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in range(3)), pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(key2, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), flat)],
                    ["id", "row_key", "salt", "size", "key", "key2", "labels"],
                )
        K.release_memory()

    return run


MEMBER = ("node", "copies", "lows", "places")
PLACES = "array<struct<component:bigint,block:bigint,others:array<bigint>>>"


def _sets_of(k: int):
    """Shingle sets of the representatives; a row whose set is not its class's is another text with the same row key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(MEMBER)
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("node")).to_numpy()
            for first, end, words in K.batch_words(batch.column(batch.schema.get_field_index("body"))):
                sets, keep = [], []
                for i, s in enumerate(shingle_sets(words, k)):
                    if set_keys(s)[0] == wanted[first + i]:
                        keep.append(first + i), sets.append(s.tobytes())
                take = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(take) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])
        K.release_memory()

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted distinct arrays, over the values both lists hold."""
    a, b = np.concatenate(left), np.concatenate(right)
    rows, cols = np.repeat(np.arange(len(left)), [x.size for x in left]), np.repeat(np.arange(len(right)), [x.size for x in right])
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not both.size:
        return out
    ia, ib = np.searchsorted(both, a), np.searchsorted(both, b)
    ina, inb = both[np.minimum(ia, both.size - 1)] == a, both[np.minimum(ib, both.size - 1)] == b
    ia, rows, ib, cols = ia[ina], rows[ina], ib[inb], cols[inb]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    ia, rows, ib, cols = ia[oa], rows[oa], ib[ob], cols[ob]
    for at in range(0, both.size, 2048):
        pa_, pb = slice(*np.searchsorted(ia, (at, at + 2048))), slice(*np.searchsorted(ib, (at, at + 2048)))
        ra, ca = np.unique(rows[pa_], return_inverse=True)
        rb, cb = np.unique(cols[pb], return_inverse=True)
        x, y = np.zeros((ra.size, 2048), dtype=np.float32), np.zeros((rb.size, 2048), dtype=np.float32)
        x[ca, ia[pa_] - at], y[cb, ib[pb] - at] = 1, 1
        out[np.ix_(ra, rb)] += x @ y.T
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, for links i - j."""
    low = np.arange(n)
    while i.size:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _met_before(lows: list[list[int] | None], unit: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs share a group of a smaller number than ``unit``, where they are counted."""
    held = [[x for x in lows[i] or () if x < unit] for i in range(len(lows))]
    at = {x: n for n, x in enumerate(sorted({x for h in held for x in h}))}
    has = np.zeros((len(lows), len(at)), dtype=np.float32)
    for i, h in enumerate(held):
        has[i, [at[x] for x in h]] = 1
    return has[left] @ has[right].T > 0


def _verify(threshold: float):
    """Counts links of one block (or of two blocks against each other) of one component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table["node"].to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in table["shingles"].to_pylist()]
        copies, block = table["copies"].to_numpy(), table["block"].to_numpy()
        lo, hi = table["block_a"][0].as_py(), table["block_b"][0].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        links, root = np.zeros(node.size, dtype=np.int64), np.arange(node.size)
        if left.size and right.size:
            size = np.array([s.size for s in sets], dtype=np.float64)
            shared = intersections([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
            near = shared >= threshold * (size[left][:, None] + size[right][None, :] - shared) - 1e-9
            near &= ~_met_before(table["lows"].to_pylist(), table["component"][0].as_py(), left, right)
            if lo == hi:
                np.fill_diagonal(near, False)
                links[left] = near @ copies[right]
            else:
                links[left] = near @ copies[right]
                links[right] = near.T @ copies[left]
            i, j = np.nonzero(near)
            root = _roots(node.size, left[i], right[j])
        return pa.table({"node": node, "links": links, "root": node[root], "parts": table["parts"]})

    return run


def _shared_prefixes(labels: DataFrame, depths: list[int], extra: dict[str, Column] | None = None) -> DataFrame:
    """``tree, label`` with ``n<d>`` (how many rows), ``low<d>`` (smallest node) and ``extra`` minima of its prefix of each depth.

    Rolled up from whole labels to shorter prefixes, so that a label that many share is one row from the start.
    """
    extra = extra or {}
    trie = labels.groupBy("tree", "label").agg(F.count(F.lit(1)).alias(f"n{depths[0]}"), F.min("node").alias(f"low{depths[0]}"), *(F.min(c).alias(f"{e}{depths[0]}") for e, c in extra.items()))
    leaves = trie
    for d in depths[1:]:
        prefix, top = F.substring("label", 1, _WIDTH * d).alias("prefix"), depths[0]
        short = leaves.groupBy("tree", prefix).agg(F.sum(f"n{top}").alias(f"n{d}"), *(F.min(f"{e}{top}").alias(f"{e}{d}") for e in ("low", *extra)))
        trie = trie.select("*", prefix).join(short, ["tree", "prefix"]).drop("prefix")
    return trie


def forest_meetings(labelled: DataFrame, least: int, depth: int, trees: int, target: float, name: str = "jaccard") -> DataFrame:
    """``node, lows``: for each representative that meets others, the smallest node of each of its prefix groups.

    ``labelled`` has ``node, tree, label``. The prefixes are of the depth at which some member
    of the group stopped shortening; a group is found by all its members, whatever their own depth.
    """
    depths, enough = list(range(depth, least - 1, -1)), trees_enough(trees, target)
    prefix = F.substring("label", 1, _WIDTH * least).alias("prefix")
    met = labelled.groupBy("tree", prefix).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tree", "prefix")
    close = staged(labelled.select("*", prefix).join(met, ["tree", "prefix"], "left_semi").select("node", "tree", "label"), f"{name}-close")
    if depth == least:
        stops = close.select("*", F.lit(depth).alias("stop"))
    else:
        found = close.join(_shared_prefixes(close, depths), ["tree", "label"])
        own = found.groupBy("node").agg(*(F.count_if(F.col(f"n{d}") > 1).alias(f"m{d}") for d in depths[:-1]))
        stop = F.coalesce(*(F.when(F.col(f"m{d}") >= enough, d) for d in depths[:-1]), F.lit(least)).alias("stop")
        stops = staged(close.join(own.select("node", stop), "node"), f"{name}-stops")
    trie = _shared_prefixes(stops, depths, {"stop": F.col("stop")})
    low = F.coalesce(*(F.when((F.col(f"n{d}") > 1) & (F.col(f"stop{d}") <= d), F.col(f"low{d}")) for d in reversed(depths))).alias("low")
    return close.join(trie.select("tree", "label", low), ["tree", "label"]).filter("low IS NOT NULL").groupBy("node").agg(F.collect_set("low").alias("lows"))  # at most one for each tree


def _units(members: DataFrame, block: int) -> DataFrame:
    """``members`` (``component, node, size, lows, ...``) by what is verified together, with ``lows`` null but for groups.

    A component stays one unit if it is small, or if its groups hold more pairs than it has
    itself; otherwise each of its groups is a unit, under the number of its smallest node.
    """
    whole = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter((F.col("n") > block) | (F.col("size") > BLOCK_SHINGLES))
    whole = staged(whole.select("component", "n"), "jaccard-large")
    if whole.isEmpty():
        return members.withColumn("lows", F.lit(None).cast("array<bigint>"))
    groups = members.join(whole, "component").select("component", "n", F.explode("lows").alias("unit")).groupBy("component", "n", "unit").agg(F.count(F.lit(1)).alias("c"))
    sparse = groups.groupBy("component", "n").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).filter(F.col("pairs") < F.col("n").cast("double") * F.col("n")).select("component", F.lit(True).alias("sparse"))
    marked = members.join(sparse, "component", "left").withColumn("lows", F.when(F.col("sparse"), F.col("lows"))).drop("sparse")
    unit = F.explode(F.coalesce("lows", F.array("component"))).alias("component")
    return marked.select(unit, *(c for c in marked.columns if c != "component"))


def _dealt(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """``members`` (``component, node, size, ...``) with their ``block`` and ``others``, the blocks that theirs is verified against.

    A component of more than one block is parted into classes of set size; sets of similarity
    ``threshold`` are in one class or in two neighbouring ones.
    """
    def blocks_of(n: Column, fits: int) -> Column:
        return F.ceil(n / F.least(F.greatest(n / BLOCKS, F.lit(fits)), F.lit(GROWTH * fits)))

    need = F.greatest(blocks_of(F.count(F.lit(1)), block), blocks_of(F.sum("size"), BLOCK_SHINGLES)).cast("int").alias("parts")
    whole = members.groupBy("component").agg(need).select("component", (F.col("parts") > 1).alias("large"))
    by_size = F.floor(F.log("size") / (-math.log(threshold) * (1 + 1e-9))) if threshold < 1 else F.col("size")
    members = members.join(whole, "component").withColumn("size_class", F.when(F.col("large"), by_size).otherwise(0).cast("int"))
    sizes = staged(members.groupBy("component", "size_class").agg(need), "jaccard-sizes")

    def beside(step: int, name: str) -> DataFrame:
        return sizes.select("component", (F.col("size_class") - step).alias("size_class"), F.col("parts").alias(name))

    def blocks(step: int, n: str) -> Column:
        first = F.shiftleft((F.col("size_class") + step).cast("long"), 32)
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: first + i)).otherwise(F.array().cast("array<bigint>"))

    at = ["component", "size_class"]
    members = members.join(sizes, at).join(beside(1, "above"), at, "left").join(beside(-1, "below"), at, "left")
    own = F.shiftleft(F.col("size_class").cast("long"), 32) + F.pmod(F.xxhash64("node"), F.col("parts"))
    return members.withColumns({"block": own, "others": F.concat(blocks(0, "parts"), blocks(1, "above"), blocks(-1, "below"))})


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE_WORDS, trees: int = TREES, max_depth: int = MAX_DEPTH, target_recall: float = TARGET_RECALL, block: int = BLOCK, salts: int = SALTS) -> DataFrame:
    """One row per input row: ``id_col, class_id, links, copies, kept, row_key``.

    ``class_id`` is the smallest id of the connected component of links (similarity of at
    least ``threshold``), null only if all its ids are; ``links`` the number of other rows at
    that similarity; ``copies`` the number of rows with an equal shingle set, itself included;
    ``kept`` marks the one row of each class that stays: that of the smallest id and, among
    rows of one id, of the smallest ``row_key`` (a hash of id and text). Rows that repeat id
    and text are separate rows with equal results. Null and empty texts are copies of each
    other and have no other links. Texts of fewer than ``k`` words are one shingle, so they
    link to equal ones only. Other columns are not read. An empty table gives an empty
    result. Words, shingles and sets are told apart by 64-bit (sets: 128-bit) hashes.
    """
    small_batches(df.sparkSession)
    least = forest_depth(threshold, trees, max_depth, target_recall)
    id_type = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("body"))
    row_key = F.xxhash64("id", "body").alias("row_key")
    keyed = rows.select("id", row_key, F.pmod(row_key, F.lit(salts)).cast("int").alias("salt"), "body")
    sketches = staged(keyed.mapInArrow(_sketch(trees, max_depth, k), f"id {id_type}, row_key long, salt int, size long, key long, key2 long, labels array<binary>"), "jaccard-sketches")

    # Classes of equal sets: combined in each task, by salt, then over the salts.
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row_key")
    salted = sketches.groupBy("key", "key2", "size", "salt").agg(F.min(first).alias("low"), F.min("row_key").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = staged(salted.groupBy("key", "key2", "size").agg(F.min("low").alias("low"), F.min("rep").alias("rep"), F.sum("n").alias("copies"), F.expr("bit_or(shiftleft(1L, salt))").alias("bits")), "jaccard-classes")

    # The forest, over one row for each representative and tree.
    reps = staged(sketches.filter("size > 0").join(classes.select("key", F.col("rep").alias("row_key")), ["key", "row_key"]).select(F.col("key").alias("node"), "labels"), "jaccard-reps")  # spread by row, not by class
    repeated = not reps.groupBy("node").count().filter("count > 1").isEmpty()  # rows that repeat id and text
    once = (lambda df: df.dropDuplicates(["node"])) if repeated else (lambda df: df)
    labelled = once(reps).select("node", F.posexplode("labels").alias("tree", "label"))
    lows = staged(forest_meetings(labelled, least, max_depth, trees, target_recall).withColumn("low", F.array_min("lows")), "jaccard-lows")
    # All groups of a representative hang together: what is left to join are their smallest nodes.
    links = lows.select(F.explode("lows").alias("src"), F.col("low").alias("dst"))
    joined = connected_components(links, "jaccard-candidates").withColumnRenamed("node", "low")
    near = lows.join(joined, "low", "left").select("node", "lows", F.coalesce("component", "low").alias("component"))

    members = _dealt(_units(near.join(classes.select(F.col("key").alias("node"), "rep", "copies", "size"), "node"), min(block, SPARSE_FROM)), threshold, block)
    gathered = members.groupBy("node", "rep", "copies").agg(F.first("lows").alias("lows"), F.collect_list(F.struct("component", "block", "others")).alias("places"))  # at most one place for each tree
    sets = once(gathered.join(rows.select("body", row_key), F.col("rep") == F.col("row_key"))).select(*MEMBER, "body")
    sets = sets.mapInArrow(_sets_of(k), f"node long, copies long, lows array<long>, places {PLACES}, shingles binary")
    parts = F.aggregate("places", F.lit(0), lambda n, p: n + F.size(p["others"])) + F.when(F.col("lows").isNull(), 0).otherwise(1)
    dealt = sets.select("node", "copies", "lows", "shingles", parts.alias("parts"), F.inline("places")).withColumn("other", F.explode("others"))
    dealt = dealt.select("component", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", "node", "copies", "lows", "parts", "shingles")
    verified = staged(dealt.groupBy("component", "block_a", "block_b").applyInArrow(_verify(threshold), "node long, links long, root long, parts int"), "jaccard-verified")

    final = verified.filter("parts = 1").select("node", F.col("root").alias("component"), "links")
    split = verified.filter("parts > 1")  # in several blocks or groups
    if not split.isEmpty():
        # A node hangs on the smallest root that a block gave it; what is left to join are roots of one node.
        counted = staged(split.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("low"), F.collect_set("root").alias("roots")), "jaccard-counted")
        ends = counted.select(F.explode("roots").alias("src"), F.col("low").alias("dst")).filter("src != dst").distinct()
        merged = connected_components(ends, "jaccard-links").withColumnRenamed("node", "low")
        final = final.unionByName(counted.join(merged, "low", "left").select("node", F.coalesce("component", "low").alias("component"), "links"))

    # Back to the rows: the first row of each component, over (class, salt).
    placed = classes.join(final.withColumnRenamed("node", "key"), "key", "left").select("key", "key2", "size", "bits", "copies", "low", F.coalesce("component", "key").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    placed = staged(placed, "jaccard-placed")
    lowest = placed.groupBy("component").agg(F.min("low").alias("lowest"))
    each = placed.join(lowest, "component").select("key", "key2", "size", "lowest", "links", "copies", F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit("bits", s) == 1)).alias("salt"))
    out = sketches.select("id", "row_key", "key", "key2", "size", "salt").join(each, ["key", "key2", "size", "salt"])
    kept = F.col("id").eqNullSafe(F.col("lowest.id")) & (F.col("row_key") == F.col("lowest.row_key"))
    return out.select(F.col("id").alias(id_col), F.col("lowest.id").alias("class_id"), "links", "copies", kept.alias("kept"), "row_key")
