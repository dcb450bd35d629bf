"""Language-model scoring by deleted interpolation of word n-grams.

A token's probability mixes the maximum-likelihood bigram estimate, the unigram estimate and
the uniform one; the weights depend on how often the context word occurs (one set for each
power of two). They are learned by expectation-maximisation on a held-out slice of the
learning documents, against counts that leave that slice out; scores then use the counts of
all learning documents.

Counts are exact and cover every document. Documents are dealt to chunks of about
``CHUNK_BYTES``. A chunk sends its distinct words and word pairs (64-bit hashes, sorted and
delta-packed) with its own counts to ranges of hashes; a range adds them up over all chunks
and sends each chunk the totals of its words and pairs, in the same order, so hashes travel
once and texts once for each pass. Where chunks and ranges are more than ``MOST_FAN``, the
exchange goes in levels: chunks of a group meet in wide ranges first, their sums go on to
narrower ranges of wider groups, and totals come back the same way. A level has a number of
rows in proportion to the number of chunks, a frequent word stands in a group's sum once, and
no task gets more than ``MOST_FAN`` parts. No table of n-grams is ever broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .runtime import staged

#: Document classes by crc32(id) mod 7: one is never learned from, one is the EM slice.
MODULUS, HELD_OUT, EM_SLICE = 7, 2, 3
#: Bytes of text for each chunk, and for each range of hashes.
CHUNK_BYTES, RANGE_BYTES = 7 << 20, 6 << 20
#: Most ranges that one part is cut into, and most parts that are added up in one task.
MOST_FAN = 512
EM_ROUNDS, EM_CHANGE = 1000, 1e-8
#: Likelihood ratios of one step, of this many powers of two, are kept as their mean.
RATIO_STEP = 0.25
MAX_CONTEXT_BUCKETS = 48
LEAST_WEIGHT = 1e-6

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
ARRAYS = ("word_keys", "word_full", "word_kept", "pair_keys", "pair_full", "pair_kept")
TOTALS = ("word_full", "word_kept", "pair_full", "pair_kept")
SUMS = ("tokens", "types", "kept_tokens", "kept_types")


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    import zstandard

    raw = np.ascontiguousarray(values).view(np.uint8).reshape(values.size, values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(blob: bytes, kind=np.uint64) -> np.ndarray:
    import zstandard

    raw, width = zstandard.ZstdDecompressor().decompress(blob), np.dtype(kind).itemsize
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(width, len(raw) // width) if raw else np.zeros((width, 0), np.uint8)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob), dtype=np.uint64)


def token_stream(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, contexts, pair keys, bounds) with one end token after each document's words."""
    docs = words.counts.size
    bounds = words.bounds + np.arange(docs + 1)
    tokens = np.empty(words.hashes.size + docs, dtype=np.uint64)
    is_end = np.zeros(tokens.size, dtype=bool)
    is_end[bounds[1:] - 1] = True
    tokens[is_end], tokens[~is_end] = END, words.hashes
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[bounds[:-1]] = START
    return tokens, contexts, K.mix(contexts * np.uint64(0xC2B2AE3D27D4EB4F) + tokens), bounds


def _tally(parts: list[np.ndarray], full: list[np.ndarray], kept: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts among ``full`` and ``kept``."""
    keys = np.unique(np.concatenate(parts))
    out = [keys]
    for some in (full, kept):
        counts = np.zeros(keys.size, dtype=np.uint64)
        if some:
            own, n = np.unique(np.concatenate(some), return_counts=True)
            counts[np.searchsorted(keys, own)] = n
        out.append(counts)
    return tuple(out)


class Exchange:
    """Levels of the exchange of ``parts`` chunks over ``ranges`` ranges.

    At level k the chunks of a group of ``fan_in ** k`` meet in each of ``fan_out ** k``
    ranges; at the last level all chunks are one group.
    """

    def __init__(self, parts: int, ranges: int, most: int = MOST_FAN):
        self.levels = 1
        while max(parts, ranges) > most**self.levels:
            self.levels += 1
        self.fan_in, self.fan_out = (next(f for f in range(1, most + 1) if f**self.levels >= n) for n in (parts, ranges))

    def cuts(self, keys: np.ndarray, own: int, level: int) -> np.ndarray:
        """Places where sorted keys of range ``own`` of a level pass from one range of the next to another."""
        edges = np.array([((own * self.fan_out + j) << 64) // self.fan_out ** (level + 1) for j in range(1, self.fan_out)], dtype=np.uint64)
        return np.concatenate(([0], np.searchsorted(keys, edges), [keys.size]))

    def parts(self, found: list[np.ndarray], group: int, own: int, level: int) -> pa.Table:
        """Rows for the next level: sums (as ``ARRAYS``) of a group, a row for each range that has any."""
        cut_w, cut_p = self.cuts(found[0], own, level), self.cuts(found[3], own, level)
        used = np.flatnonzero((np.diff(cut_w) > 0) | (np.diff(cut_p) > 0))
        blobs = {}
        for n, (name, values) in enumerate(zip(ARRAYS, found, strict=True)):
            cut, pack = cut_w if n < 3 else cut_p, _pack if n % 3 else _pack_keys
            blobs[name] = pa.array([pack(values[cut[r] : cut[r + 1]]) for r in used], pa.binary())
        ids = {"grp": np.full(used.size, group // self.fan_in), "rng": own * self.fan_out + used, "child": np.full(used.size, group)}
        return pa.table({**{n: pa.array(v, pa.int64()) for n, v in ids.items()}, **blobs})


PARTS = "grp long, rng long, child long, " + ", ".join(f"{a} binary" for a in ARRAYS)
BACK = "grp long, rng long, part long, " + ", ".join(f"{a} binary" for a in TOTALS) + ", " + ", ".join(f"{s} long" for s in SUMS)


def _chunk_counts(exchange: Exchange):
    def run(table: pa.Table) -> pa.Table:
        kind = table["rest"].to_numpy()
        words, wf, wk, pairs, pf, pk = [], [], [], [], [], []
        for first, end, w in K.batch_words(table["body"], lower=True):
            tokens, _, pair, bounds = token_stream(w)
            doc = np.repeat(kind[first:end], np.diff(bounds))
            starts = np.full(end - first, START)
            words += [tokens, starts]
            pairs.append(pair)
            learn, keep = doc != HELD_OUT, (doc != HELD_OUT) & (doc != EM_SLICE)
            wf += [tokens[learn], starts[kind[first:end] != HELD_OUT]]
            wk += [tokens[keep], starts[(kind[first:end] != HELD_OUT) & (kind[first:end] != EM_SLICE)]]
            pf.append(pair[learn])
            pk.append(pair[keep])
        return exchange.parts([*_tally(words, wf, wk), *_tally(pairs, pf, pk)], table["chunk"][0].as_py(), 0, 0)

    return run


def _merged(table: pa.Table) -> dict:
    """Distinct keys of all parts of a range, their sums, and each part's places among them."""
    out = {}
    for kind in ("word", "pair"):
        keys = [_unpack_keys(b) for b in table[f"{kind}_keys"].to_pylist()]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        out[f"{kind}_keys"], out[f"{kind}_places"] = every, np.split(place, np.cumsum([k.size for k in keys])[:-1])
        for which in ("full", "kept"):
            counts = np.concatenate([_unpack(b, np.uint64) for b in table[f"{kind}_{which}"].to_pylist()])
            out[f"{kind}_{which}"] = np.bincount(place, weights=counts, minlength=every.size).astype(np.uint64)
    return out


def _add_up(exchange: Exchange, level: int):
    """Sums of one range over a group's parts, cut for the next level."""

    def run(table: pa.Table) -> pa.Table:
        found = _merged(table)
        return exchange.parts([found[a] for a in ARRAYS], table["grp"][0].as_py(), table["rng"][0].as_py(), level)

    return run


def _handed_back(exchange: Exchange, table: pa.Table, found: dict, totals: dict[str, np.ndarray]) -> dict[str, list]:
    """Totals of a range for each of its parts, in the order of the part's keys."""
    out = {"grp": table["child"].to_pylist(), "rng": [r // exchange.fan_out for r in table["rng"].to_pylist()], "part": table["rng"].to_pylist()}
    for name in TOTALS:
        out[name] = [_pack(totals[name][place]) for place in found[f"{name[:4]}_places"]]
    return out | {s: [0] * table.num_rows for s in SUMS}


def _totals(exchange: Exchange):
    """At the last level: totals for each part; a row of group -1 has the range's sums over words."""

    def run(table: pa.Table) -> pa.Table:
        found = _merged(table)
        out = _handed_back(exchange, table, found, found)
        real = found["word_keys"] != START
        sums = [int(x) for which in ("full", "kept") for x in (found[f"word_{which}"][real].sum(), (found[f"word_{which}"][real] > 0).sum())]
        last = {"grp": -1, "rng": 0, "part": table["rng"][0].as_py()} | dict.fromkeys(TOTALS) | dict(zip(SUMS, sums, strict=True))
        return pa.table({n: pa.array([*v, last[n]], pa.binary() if n in TOTALS else pa.int64()) for n, v in out.items()})

    return run


def _hand_down(exchange: Exchange):
    """Totals that came back for a group's range, for each of its parts."""

    def run(parts: pa.Table, back: pa.Table) -> pa.Table:
        back = back.sort_by("part")
        totals = {name: np.concatenate([_unpack(b) for b in back[name].to_pylist()]) for name in TOTALS}
        found = _merged(parts)
        if any(totals[n].size != found[f"{n[:4]}_keys"].size for n in TOTALS):
            raise RuntimeError("totals do not fit a range's keys")
        return pa.table({n: pa.array(v, pa.binary() if n in TOTALS else pa.int64()) for n, v in _handed_back(exchange, parts, found, totals).items()})

    return run


def _exchanged(parts: DataFrame, exchange: Exchange) -> tuple[DataFrame, list[int]]:
    """(``grp, part`` and the totals of each chunk's words and pairs, [tokens, types, kept tokens, kept types])."""
    levels = [parts]
    for level in range(1, exchange.levels):
        levels[-1] = staged(levels[-1], f"lm-parts-{level}")
        levels.append(levels[-1].groupBy("grp", "rng").applyInArrow(_add_up(exchange, level), PARTS))
    back = staged(levels.pop().groupBy("grp", "rng").applyInArrow(_totals(exchange), BACK), "lm-totals")
    sums = back.filter("grp = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in SUMS)).first()
    back = back.filter("grp >= 0")
    while levels:
        back = staged(levels.pop().groupBy("grp", "rng").cogroup(back.groupBy("grp", "rng")).applyInArrow(_hand_down(exchange), BACK), "lm-handed-down")
    return back, [int(n) for n in sums]


class _ChunkModel:
    """Counts of one chunk's tokens, contexts and pairs."""

    def __init__(self, texts: pa.Array, counts: pa.Table, which: str):
        self.texts = texts
        words, pairs = [], []
        for _, _, w in K.batch_words(texts, lower=True):
            tokens, _, pair, _ = token_stream(w)
            words.append(np.unique(tokens))
            pairs.append(np.unique(pair))
        self.words, self.pairs = np.unique(np.concatenate([*words, np.array([START])])), np.unique(np.concatenate(pairs))
        order = np.argsort(counts["part"].to_numpy())
        rows = counts.take(pa.array(order))
        self.word_n, self.pair_n = (np.concatenate([_unpack(b) for b in rows[f"{kind}_{which}"].to_pylist()]).astype(np.float64) for kind in ("word", "pair"))
        if self.word_n.size != self.words.size or self.pair_n.size != self.pairs.size:
            raise RuntimeError("a chunk's counts do not fit its texts")

    def slices(self):
        """(first row, end row, token bounds, c(w), c(context), c(pair)) of each slice."""
        for first, end, w in K.batch_words(self.texts, lower=True):
            tokens, contexts, pair, bounds = token_stream(w)
            n = self.word_n[np.searchsorted(self.words, tokens)]
            context = np.empty_like(n)
            context[1:] = n[:-1]
            context[bounds[:-1]] = self.word_n[np.searchsorted(self.words, START)]
            yield first, end, bounds, n, context, self.pair_n[np.searchsorted(self.pairs, pair)]


def context_bucket(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 n)."""
    return np.minimum(np.frexp(n)[1], MAX_CONTEXT_BUCKETS - 1)


def learn_weights(bucket: np.ndarray, bigram: np.ndarray, unigram: np.ndarray, events: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation.

    ``bigram`` and ``unigram`` are estimates relative to the uniform one. Buckets without
    events take the weights learned over all events; without any event the mix is even.
    Rounds end when no weight changes by more than ``EM_CHANGE``.
    """
    weights = np.full((MAX_CONTEXT_BUCKETS, 3), 1 / 3)
    if not events.size:
        return weights
    ratios = np.stack((bigram, unigram, np.ones(events.size)), axis=1)

    def fit(slot: np.ndarray, n: int) -> np.ndarray:
        w = np.full((n, 3), 1 / 3)
        for _ in range(rounds):
            share = w[slot] * ratios
            share *= (events / share.sum(axis=1))[:, None]
            new = np.stack([np.bincount(slot, weights=share[:, k], minlength=n) for k in range(3)], axis=1)
            new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
            change, w = np.abs(new - w).max(), new
            if change < EM_CHANGE:
                break
        w = np.maximum(w, LEAST_WEIGHT)
        return w / w.sum(axis=1, keepdims=True)

    seen = np.bincount(bucket, weights=events, minlength=MAX_CONTEXT_BUCKETS) > 0
    weights[:] = fit(np.zeros_like(bucket), 1)[0]
    weights[seen] = fit(bucket, MAX_CONTEXT_BUCKETS)[seen]
    return weights


def _ratios(n: np.ndarray, context: np.ndarray, pair: np.ndarray, tokens: int, types: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram maximum-likelihood estimates relative to 1 / (types + 1)."""
    scale = types + 1.0
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0) * scale, n / max(tokens, 1) * scale


def _held_out_events(tokens: int, types: int):
    """Events of a chunk by context bucket and steps of both ratios, with the sums of the ratios themselves."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        found = [np.zeros((0, 6))]
        if docs.num_rows and counts.num_rows:
            for _, _, _, n, context, pair in _ChunkModel(docs["body"].combine_chunks(), counts, "kept").slices():
                two, one = _ratios(n, context, pair, tokens, types)
                step = [np.where(r > 0, np.round(np.log2(np.maximum(r, 1e-300)) / RATIO_STEP), -9999) for r in (two, one)]
                cell, at = np.unique(np.stack((context_bucket(context), *step), axis=1), axis=0, return_inverse=True)
                found.append(np.column_stack((cell, *(np.bincount(at.ravel(), weights=w) for w in (np.ones(n.size), two, one)))))
        cells = np.concatenate(found)
        return pa.table({name: cells[:, i].astype(np.int64) if i < 4 else cells[:, i] for i, name in enumerate(CELL)})

    return run


CELL = ("context", "two", "one", "events", "two_sum", "one_sum")


def _score(tokens: int, types: int, weights: np.ndarray, id_type: pa.DataType):
    names = ("n_tokens", "n_known", "base_score", "score")

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        found = {n: [] for n in names}
        if docs.num_rows:
            model = _ChunkModel(docs["body"].combine_chunks(), counts, "full")
            for _, _, bounds, n, context, pair in model.slices():
                two, one = _ratios(n, context, pair, tokens, types)
                w = weights[context_bucket(context)]
                p = (w[:, 0] * two + w[:, 1] * one + w[:, 2]) / (types + 1.0)
                found["n_tokens"].append(np.diff(bounds))
                found["n_known"].append(K.sum_by(bounds, n > 0))
                found["base_score"].append(np.add.reduceat(np.log10((n + 1) / (tokens + types + 1)), bounds[:-1]))
                found["score"].append(np.add.reduceat(np.log10(p), bounds[:-1]))
        arrays = {n: pa.array(np.concatenate(v) if v else [], pa.int64() if n.startswith("n_") else pa.float64()) for n, v in found.items()}
        return pa.table({"id": docs["id"].cast(id_type), "held_out": pa.array(docs["rest"].to_numpy() == HELD_OUT), **arrays})

    return run


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", place: Column | None = None, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES, most_fan: int = MOST_FAN) -> DataFrame:
    """One row per input row: id, ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from rows whose crc32(id as text) mod 7 is not 2 (a null id counts as an empty
    text). A null or empty text is its end token only. Rows that repeat an id are separate
    rows. ``place`` is any deterministic column, by whose hash rows are dealt to chunks;
    without it the hash of id and text deals them. A chunk is read whole by one task: it has
    about ``chunk_bytes``, and a longer text at most. Other columns are not read. An empty
    table gives an empty result; without any learning row all tokens are unknown.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(MODULUS))
    own = rest == EM_SLICE
    size = df.agg(F.coalesce(F.sum(F.when(own, F.octet_length(text))), F.lit(0)), F.coalesce(F.sum(F.when(~own, F.octet_length(text))), F.lit(0))).first()
    # The EM slice has chunks of its own, with odd numbers, so that it can be read alone.
    slices, others = (max(1, -(-n // chunk_bytes)) for n in size)
    exchange = Exchange(2 * max(slices, others), max(1, -(-sum(size) // range_bytes)), most_fan)
    deal = F.xxhash64(id_col, text_col) if place is None else F.xxhash64(place)
    chunk = F.when(own, F.pmod(deal, F.lit(slices)) * 2 + 1).otherwise(F.pmod(deal, F.lit(others)) * 2)
    rows = df.select(chunk.alias("chunk"), rest.alias("rest"), text.alias("body"), F.col(id_col).alias("id"))

    parts = rows.select("chunk", "rest", "body").groupBy("chunk").applyInArrow(_chunk_counts(exchange), PARTS)
    counts, n = _exchanged(parts, exchange)
    counts = counts.withColumnRenamed("grp", "chunk")

    slice_rows = rows.filter(F.col("rest") == EM_SLICE).groupBy("chunk").cogroup(counts.filter("chunk % 2 = 1").select("chunk", "part", "word_kept", "pair_kept").groupBy("chunk"))
    events = slice_rows.applyInArrow(_held_out_events(n[2], n[3]), "context long, two long, one long, events long, two_sum double, one_sum double")
    cells = events.groupBy("context", "two", "one").agg(*(F.sum(c).alias(c) for c in CELL[3:])).toPandas()  # bounded by the ratio steps
    count = cells["events"].to_numpy()
    weights = learn_weights(cells["context"].to_numpy(), cells["two_sum"].to_numpy() / count, cells["one_sum"].to_numpy() / count, count)

    scored = rows.groupBy("chunk").cogroup(counts.select("chunk", "part", "word_full", "pair_full").groupBy("chunk")).applyInArrow(
        _score(n[0], n[1], weights, to_arrow_type(kind)), f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n[0])).cast("long").alias("train_tokens"), "base_score", "score")
