"""Personal data: fixed patterns, and bootstrapped contextual extraction, in DataFrame operations only.

The fixed patterns give seed entities, each its whole text. The two words before a seed, the
word before it and the word behind it are lexical patterns of its kind; a line break is a word,
digits are one class. Other tokens with digits or an at sign, and groups of digits with blanks
between, that stand in the same places are candidate instances. A graph of patterns and
instances is scored in rounds: an instance's belief comes from the patterns that extract it, a
pattern's confidence from the instances it extracts. What patterns above a fixed confidence
extract, and no fixed pattern has found, is personal data of the pattern's kind; it then counts
among the known instances and induces patterns of its own, until a generation finds nothing new.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import staged

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. Possessive and anchored forms of the documented ones, which find the same
#: matches without stack use or restarts inside a run of one class.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: A group of digits, and two or more of them with single blanks between, up to a word's end.
_GROUP = r"[+(]*+[0-9]{1,8}+(?:[()-]++[0-9]{1,8}+)*+\)?+"
_GROUPS = rf"[^\s\p{{L}}\p{{N}}@+(]*+{_GROUP}(?:[ ]{_GROUP}(?=[^\s\p{{L}}\p{{N}}@]*+(?!\S)))++\S*+"
#: What may be an identifier, from a word's start: groups of digits, or a token.
CANDIDATE = rf"(?<!\S)(?:{_GROUPS}|[^\s0-9@]*+[0-9@]\S*+)"
#: Code points that a text is cut into, to read the words around a span without a pass over the text.
CHUNK = 256
CONTEXT_WORDS = 2
#: What the pattern of all context words begins with.
WIDE = "2 "
#: Most rounds of one generation, the change of confidence at which they end before, and most generations.
ROUNDS, CHANGE, GENERATIONS = 10, 0.01, 10
#: A pattern needs so many different known instances, and this confidence.
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
#: What an instance that is not known weighs in a pattern's confidence, and what all patterns owe.
UNKNOWN, DOUBT = 0.25, 0.5
#: Numbers that a running sum copies at once.
RUN = 64


def _spans(text: Column, kind: str, pattern: str, hint: Column, keep) -> Column:
    """Array of (kind, start, end, body) of a pattern's matches, in code points; ``keep``: matched text -> condition."""
    found = F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    placed = _placed(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), found)
    return F.transform(F.filter(placed, lambda s: keep(s["body"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body")))


def _placed(gaps: Column, bodies: Column) -> Column:
    """(gap, body, start, end) of each body, which stands behind its gap."""
    both = F.arrays_zip(gaps.alias("gap"), bodies.alias("body"))
    sums = _running(F.transform(both, lambda x: F.length(x["gap"]) + F.length(x["body"])))

    def place(x: Column) -> Column:
        start = x["at"] + F.length(x["gap"])
        return F.struct(x["gap"].alias("gap"), x["body"].alias("body"), start.alias("start"), (start + F.length(x["body"])).alias("end"))

    return F.transform(F.arrays_zip(gaps.alias("gap"), bodies.alias("body"), sums.alias("at")), place)


def _running(sizes: Column) -> Column:
    """The sum of the numbers before each number, by runs of ``RUN`` numbers, so that no step copies a long array."""

    def along(numbers: Column, start: Column) -> Column:
        sums = F.aggregate(numbers, F.array(start), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.slice(sums, F.lit(1), F.size(numbers))

    def over(sizes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda k: F.slice(sizes, k * RUN + 1, F.lit(RUN)))
        starts = along(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda acc, n: acc + n)), F.lit(0))
        return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(runs, starts, along))).otherwise(F.array().cast("array<int>"))

    return _once(sizes, over)


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often and wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, body) of the fixed patterns, by kind and then start."""

    def card(m: Column) -> Column:
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)

    digit = text.rlike("[0-9]")
    return F.concat(
        _spans(text, "email", EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        _spans(text, "ip", IP, digit & F.contains(text, F.lit(".")), lambda m: m.rlike(rf"^{IP_PART}(\.{IP_PART}){{3}}$")),
        _spans(text, "card", CARD, digit, card),
        _spans(text, "phone", PHONE, F.contains(text, F.lit("+")), lambda m: F.length(_digits(m)).between(8, 15)),
    )


def candidates(text: Column) -> Column:
    """Array of (body, start, end) of tokens with a digit or an at sign, and of blank-separated groups of digits."""
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array().cast("array<string>"))
    return F.transform(_placed(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), found), _trimmed)


def _trimmed(s: Column) -> Column:
    """The candidate without signs around it."""
    tail = F.regexp_replace(s["body"], r"^(?:(?!\([0-9]+\))[^\p{L}\p{N}+])+", "")
    body = F.regexp_replace(tail, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")  # a run of signs is tried from its start only
    start = s["start"] + F.length(s["body"]) - F.length(tail)
    return F.struct(body.alias("body"), start.alias("start"), (start + F.length(body)).alias("end"))


def _around(chunks: Column, s: Column) -> Column:
    """(body, start, end, kind, before, after): the span with the text around it, a line break where the text begins or ends."""

    def chunk(k: Column) -> Column:
        return F.coalesce(F.get(chunks, k), F.lit(""))

    first, last = F.floor(s["start"] / CHUNK).cast("int"), F.floor(s["end"] / CHUNK).cast("int")
    before = F.concat(F.when(first <= 1, "\n").otherwise(""), chunk(first - 1), F.substring(chunk(first), F.lit(1), s["start"] % CHUNK))
    after = F.concat(F.substring(chunk(last), s["end"] % CHUNK + 1, F.lit(CHUNK)), chunk(last + 1), F.when(last + 2 >= F.size(chunks), "\n").otherwise(""))
    return F.struct(*(s[c].alias(c) for c in ("body", "start", "end", "kind")), _shape(before).alias("before"), _shape(after).alias("after"))


def _shape(text: Column) -> Column:
    """Lower case, digits as one class."""
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def _worded(s: Column) -> Column:
    """(body, start, end, kind, words, behind): the words before the span, nearest last, and the word behind; a line break is a word."""
    words = F.filter(F.split(F.regexp_replace(s["before"], r"[\n\r]\s*+", " \n "), r"[^\S\n]+"), lambda w: w != "")
    behind = F.regexp_extract(s["after"], r"^[^\S\n]*+[^\s\p{L}\p{N}]*+[^\S\n]*+(\S+|\n)", 1)
    near = F.slice(words, F.greatest(F.size(words) - (CONTEXT_WORDS - 1), F.lit(1)), F.lit(CONTEXT_WORDS))
    return F.struct(*(s[c].alias(c) for c in ("body", "start", "end", "kind")), near.alias("words"), behind.alias("behind"))


def _patterned(s: Column) -> Column:
    """(body, start, end, kind, wide, contexts): patterns of the words before, of the last of them alone, and of the word behind."""
    wide = F.array_join(s["words"], " ")
    last = F.element_at(F.concat(F.array(F.lit("")), s["words"]), -1)
    contexts = F.array(F.concat(F.lit(WIDE), wide), F.concat(F.lit("1 "), last), F.concat(F.lit("> "), s["behind"]))
    return F.struct(*(s[c].alias(c) for c in ("body", "start", "end", "kind")), wide.alias("wide"), F.filter(contexts, lambda c: F.length(c) > 2).alias("contexts"))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, name: str = "pii-patterns") -> DataFrame:
    """``context, kind, confidence`` from distinct ``context, wide, body, kind`` (kind null: not known).

    A pattern needs ``min_seeds`` different known instances of its kind. One that is not of all
    context words (``wide``) needs so many different ``wide`` among them as well: behind one
    phrase only, a single word says no more than the phrase.
    A known instance has belief 1 for its own kind and 0 for others, or if it is of two kinds. In each round a pattern's confidence is the mean of its instances' beliefs,
    those not known weighing ``UNKNOWN`` each and ``DOUBT`` without belief added; the belief of
    an instance not known is ``1 - product(1 - confidence)`` over the other patterns that extract
    it, as of the round before. Rounds end when no confidence changes by more than ``CHANGE``.
    """
    known = edges.filter("kind IS NOT NULL").groupBy("context", "kind").agg(F.countDistinct("body").alias("seeds"), F.countDistinct("wide").alias("phrases"))
    known = known.filter((F.col("seeds") >= min_seeds) & (F.startswith("context", F.lit(WIDE)) | (F.col("phrases") >= min_seeds)))
    # (pattern, instance) pairs; a pattern is a context with the kind of enough known instances
    bodies = edges.groupBy("context", "body").agg(F.max("kind").alias("own"), F.count_distinct("kind").alias("kinds"))
    fixed = F.when(F.col("kinds") > 0, ((F.col("own") == F.col("kind")) & (F.col("kinds") == 1)).cast("double"))
    pairs = staged(bodies.join(known, "context").select("context", "kind", "body", fixed.alias("fixed")), name)
    weight = F.when(F.col("fixed").isNull(), UNKNOWN).otherwise(1.0)
    doubt = F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))
    scores = None
    for n in range(rounds):
        if scores is None:
            believed = pairs.withColumn("other", F.lit(0.0)).withColumn("was", F.lit(0.0))
        else:
            met = pairs.join(scores, ["context", "kind"])
            total = met.filter("fixed IS NULL").groupBy("kind", "body").agg(F.sum(doubt).alias("total"))
            believed = met.join(total, ["kind", "body"], "left").withColumn("other", 1 - F.exp(F.coalesce(F.col("total") - doubt, F.lit(0.0)))).withColumn("was", F.col("confidence"))
        new = believed.groupBy("context", "kind").agg((F.sum(weight * F.coalesce("fixed", "other")) / (F.sum(weight) + DOUBT)).alias("confidence"), F.max("was").alias("was"))
        new = staged(new, f"{name}-{n}")
        scores = new.select("context", "kind", "confidence")
        moved = new.agg(F.max(F.abs(F.col("confidence") - F.col("was")))).first()[0] or 0
        if not moved > CHANGE:
            return scores
    warnings.warn(f"confidences still moved by {moved:.3g} after {rounds} rounds", stacklevel=2)
    return scores


def _bootstrapped(edges: DataFrame, rounds: int, min_seeds: int, min_confidence: float) -> DataFrame:
    """``context, found_kind, confidence`` of the patterns that stand when a generation finds no new instance.

    ``edges`` has distinct ``context, wide, body, kind``. An instance that a pattern finds is
    known from then on.
    """
    edges = staged(edges, "pii-edges")
    unknown = edges.filter("kind IS NULL").select("context", "body").distinct().join(edges.filter("kind IS NOT NULL").select("body").distinct(), "body", "left_anti")
    found, count = None, 0
    for n in range(GENERATIONS):
        known = edges if found is None else edges.join(found, "body", "left").select("context", "wide", "body", F.coalesce("kind", "found_kind").alias("kind"))
        good = score_patterns(known, rounds, min_seeds, f"pii-patterns-{n}").filter(F.col("confidence") >= min_confidence).withColumnRenamed("kind", "found_kind")
        hits = unknown.join(good, "context").filter(_may_be(F.col("found_kind"), F.col("body")))
        best = hits.groupBy("body").agg(F.max(F.struct("confidence", "found_kind")).alias("best"))
        found = staged(best.select("body", F.col("best.found_kind").alias("found_kind")), f"pii-found-{n}")
        if (now := found.count()) <= count:
            return good
        count = now
    warnings.warn(f"instances were still being found after {GENERATIONS} generations: {count} so far", stacklevel=2)
    return good


def _may_be(kind: Column, body: Column) -> Column:
    return (kind == "email") | body.rlike("[0-9]")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per input row: id, counts of base spans, ``base_sha256``, ``spans``, ``n_found``.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind and then start. A
    null text is an empty one, with no spans. Rows that repeat id and text get equal results.
    What context finds has a digit, or is of an email pattern, and overlaps no base span. A
    context word is known by its last ``CHUNK`` code points at least.
    Other columns are not read. An empty table gives an empty result. No row is dropped:
    documents without candidates take no part in the graph only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("body")).select("id", "body", base_spans(F.col("body")).alias("base"), candidates(F.col("body")).alias("cands"))
    rows = rows.select("*", F.when(F.size("base") + F.size("cands") > 0, F.regexp_extract_all("body", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("chunks"))
    other = F.filter("cands", lambda c: c["end"] > c["start"])
    seeds = F.transform("base", lambda b: F.struct(b["body"], b["start"], b["end"], b["kind"]))
    spans = F.concat(seeds, F.transform(other, lambda c: F.struct(c["body"], c["start"], c["end"], F.lit(None).cast("string").alias("kind"))))
    for step in (lambda s: _around(F.col("chunks"), s), _worded, _patterned):
        spans = F.transform(spans, step)
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    rows = staged(rows.select("id", F.xxhash64("body").alias("text_key"), base.alias("base"), spans.alias("spans")), "pii-spans")  # spans and words around them only, no texts

    # Repeated rows are one; a candidate that overlaps a base span of its text is none.
    tokens = rows.filter(F.size("spans") > 0).select("id", "text_key", F.explode("spans").alias("c")).select("id", "text_key", "c.*").distinct()
    forth = Window.partitionBy("id", "text_key").orderBy("start", F.col("kind").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("id", "text_key").orderBy(F.desc("start"), F.col("kind").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    reach, following = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(forth), F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(back)
    tokens = tokens.select("*", reach.alias("reach"), following.alias("following")).filter("kind IS NOT NULL OR (coalesce(reach, 0) <= start AND coalesce(following, end) >= end)")
    tokens = tokens.drop("reach", "following").withColumn("context", F.explode("contexts")).drop("contexts")
    good = _bootstrapped(tokens.select("context", "wide", "body", "kind").distinct(), rounds, min_seeds, min_confidence)
    extra = tokens.filter("kind IS NULL").join(good, "context").filter(_may_be(F.col("found_kind"), F.col("body")))
    extra = extra.groupBy("id", "text_key", "start", "end").agg(F.max_by("found_kind", F.struct("confidence", "found_kind")).alias("kind"))
    extra = extra.groupBy("id", "text_key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("extra"))
    out = rows.drop("spans").join(extra.withColumnsRenamed({"id": "x_id", "text_key": "x_key"}), F.col("id").eqNullSafe(F.col("x_id")) & (F.col("text_key") == F.col("x_key")), "left")
    found = F.coalesce("extra", F.array().cast(rows.schema["base"].dataType))
    every = F.concat(*(F.array_sort(_of_kind(F.concat("base", found), k)) for k in KINDS))
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size(found).cast("long").alias("n_found"))
