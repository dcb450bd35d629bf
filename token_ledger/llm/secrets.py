"""Secret scans: fixed patterns, and sliding-window Shannon entropy of candidate strings.

Candidate strings are runs of one alphabet (hexadecimal, base32, lower or upper case with
digits, base64, letters without digits); one pass finds the runs of the widest, classes are
told apart inside them. A window slides over a
candidate; its character counts, and with them the entropy, change by one character in and
one out. A candidate whose best window reaches its alphabet's threshold is a secret, unless
an allow-list pattern covers it.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches
from .textkit import release_memory

#: Fixed patterns of the base scan, in the order of their kinds.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16

WINDOW = 20
#: Candidates lie in runs of the widest alphabet; nothing shorter than a window is one.
RUN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_IN_RUN, _BESIDE = b"x", b" "
_MARKS = bytes(_IN_RUN[0] if chr(c) in RUN else _BESIDE[0] for c in range(256))
_DIGIT, _LOWER, _UPPER = re.compile(r"[0-9]"), re.compile(r"[a-z]"), re.compile(r"[A-Z]")
#: The class of hexadecimal strings, which may be a part of a run between signs: what it must hold, and its bits per character.
HEX_PART, HEX_NEEDS, HEX_BITS = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])"), (_DIGIT, re.compile(r"[A-Fa-f]")), 3.0
#: Classes of whole runs: (name, what the run is, what it must hold, bits per character that a window must reach)
ALPHABETS = (
    ("base32", re.compile(r"[A-Z2-7]{20,}=*"), (re.compile(r"[2-7]"), _UPPER), 3.2),
    ("lower", re.compile(r"[a-z0-9+/_=-]+"), (_DIGIT, _LOWER), 3.7),
    ("upper", re.compile(r"[A-Z0-9+/_=-]+"), (_DIGIT, _UPPER), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), (_DIGIT, _LOWER, _UPPER), 3.7),
    ("letters", re.compile(r"[A-Za-z0-9+/_=-]+"), (), 4.1),
)
#: What a text with an assignment holds in lower case.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
#: A name before a value, which no allow-list pattern has to cover.
LABEL = re.compile(r"[A-Za-z_-]+=(?=.)")
#: Allowed strings: UUIDs, dates and times run together, paths of lower-case words.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9-]+Z?",
    r"/?(?:[a-z]+/)+[a-z0-9_-]*",
)


def best_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits per character, of any window of the text."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c)
    size = min(window, len(text))
    if not size:
        return 0.0
    least = math.inf
    term = [0.0, *(c * math.log2(c) for c in range(1, size + 2))]
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if i >= size:
            out = text[i - size]
            c = counts[out]
            counts[out] = c - 1
            total += term[c - 1] - term[c]
        if i >= size - 1 and total < least:
            least = total
    return math.log2(size) - least / size


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, by place."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def long_runs(text: str) -> Iterator[tuple[int, str]]:
    """(start, run) of the maximal runs of the widest alphabet that hold a window, in one pass over the bytes."""
    data = text.encode()
    marks = data.translate(_MARKS)
    one_byte, place, seen = len(data) == len(text), 0, 0
    at = marks.find(_IN_RUN * WINDOW)
    while at >= 0:
        end = marks.find(_BESIDE, at)
        end = len(marks) if end < 0 else end
        if not one_byte:
            place, seen = place + len(data[seen:at].decode()), at
        yield at if one_byte else place, data[at:end].decode()
        at = marks.find(_IN_RUN * WINDOW, end)


def _entropy_spans(run: str, start: int, free: Callable[[int, int], bool], allow: re.Pattern | None) -> list[tuple[int, int, str]]:
    """Secrets by entropy in one run: its hexadecimal parts, or else the whole of it, by the easiest class that it is of."""

    def secret(part: str, bits: float) -> bool:
        return not (allow and allow.fullmatch(LABEL.sub("", part, count=1) if LABEL.match(part) else part)) and best_entropy(part) >= bits

    out = []
    for m in HEX_PART.finditer(run):
        s, e = start + m.start(), start + m.end()
        if free(s, e) and all(n.search(m[0]) for n in HEX_NEEDS) and secret(m[0], HEX_BITS):
            out.append((s, e, "entropy"))
    if out or not free(start, start + len(run)):
        return out
    bits = min(b for _, whole, needs, b in ALPHABETS if whole.fullmatch(run) and all(n.search(run) for n in needs))
    return [(start, start + len(run), "entropy")] if secret(run, bits) else []


def scan_text(text: str, allow: re.Pattern | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) as (start, end, kind), each by start."""
    base, low, runs = [], text.lower(), list(long_runs(text))
    if any(name in low for name in _NAMES):
        base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    base += [(at + m.start(), at + m.end(), "hex") for at, run in runs for m in HEX.finditer(run)]
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    starts, ends = _merged([(s, e) for s, e, _ in base])

    def free(start: int, end: int) -> bool:
        k = bisect.bisect_right(ends, start)
        return k == len(starts) or starts[k] >= end

    return base, [span for at, run in runs for span in _entropy_spans(run, at, free, allow)]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: Sequence[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, and spans that overlap as one, replaced by a mark."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long, redacted string"


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = ALLOW, with_redacted: bool = False) -> DataFrame:
    """One row per input row: id, counts of base spans, ``base_sha256``, ``spans``, ``n_entropy``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind.
    ``with_redacted`` adds the text with all spans masked. A null text is an empty one, with
    no spans. Rows are independent of each other; other columns are not read; an empty table
    gives an empty result.
    """
    small_batches(df.sparkSession)
    allowed = "|".join(f"(?:{p})" for p in allow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_re = re.compile(allowed) if allowed else None
        names = [f.split()[0] for f in OUT.split(", ")]
        names = names if with_redacted else names[:-1]
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part, rows = batch.slice(first, 500), []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    base, added = scan_text(text, allow_re)
                    n = [sum(kind == k for _, _, kind in base) for k in KINDS[:3]]
                    every = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))
                    rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(added), *([redact(text, every)] if with_redacted else [])))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c)) for c in zip(*rows, strict=True))], ["id", *names])
        release_memory()

    kind = df.schema[id_col].dataType.simpleString()
    schema = OUT if with_redacted else OUT.rpartition(", ")[0]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", allow: Sequence[str] = ALLOW) -> DataFrame:
    """All rows and columns of ``df`` with secrets in the text masked, in one pass without a join.

    Only texts with a secret change; ``length_col``, if there is such a column, follows them.
    A null stays null. Rows are independent of each other; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    allowed = "|".join(f"(?:{p})" for p in allow)
    follows = length_col in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_re = re.compile(allowed) if allowed else None
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = part.column(at).to_pylist()
                masked = [None if t is None else redact(t, [s for spans in scan_text(t, allow_re) for s in spans]) for t in texts]
                columns = part.columns
                columns[at] = pa.array(masked, part.schema.field(at).type)
                n = part.schema.get_field_index(length_col) if follows else -1
                if n >= 0:
                    new = [len(m) if m is not None and m != t else old for t, m, old in zip(texts, masked, part.column(n).to_pylist(), strict=True)]
                    columns[n] = pa.array(new, part.schema.field(n).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
        release_memory()

    return df.mapInArrow(run, df.schema)
