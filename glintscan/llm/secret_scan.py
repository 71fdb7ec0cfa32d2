"""Secrets in texts: fixed patterns, and a battery of randomness tests for everything they do not name.

A candidate is a run of at least ``MIN_RUN`` characters of the common encodings outside the spans of the patterns, or its
parts between ``/``, ``-`` and ``_`` where those look more random than the run. Its encoding is inferred (the smallest
alphabet that holds it), its characters become numbers, and three tests follow: chi-squared uniformity over the
alphabet, runs above and below the middle, and serial correlation. A string that one of them rejects (repeats, counters) gets the p-value 1. The question for the others is not whether a string could be random, for every short
string could, but whether ordinary text would be written so. Its p-value is the chance that ordinary text gives the string
(``prose.log_chance``: letters by the letter before, case and digits) over the chance that its uniform encoding gives it: by
Markov's inequality ordinary text gets a ratio of at most p with a chance of at most p, at any length. False discoveries
are then limited by Benjamini and Hochberg's rule over all candidates of the table, in classes of encoding and length:
p-values are counted in a histogram of bounded size, and each class gets one limit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import prose
from .common import staged

#: The kinds of spans in their order, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LENGTH = 12
KEYWORDS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_RUN = 20
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PART = re.compile(r"[A-Za-z0-9+]{20,}={0,2}")

#: Alphabets from small to large; a string has the encoding of the first one that holds it.
ALPHABETS = {
    "decimal": "0123456789", "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower and digits": "0123456789abcdefghijklmnopqrstuvwxyz",
    "alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64 for urls": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
NUMBERS = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}
#: Chances that two, and that three, characters of ordinary text are equal: European letters, and those of them that are hex
#: digits.
PROSE, PROSE_HEX = (0.066, 0.0056), (0.24, 0.078)
#: Two-sided chance at which runs and serial correlation reject.
ALPHA = 0.002
#: Standard deviations of the pairs of equal characters above which a string is not uniform, unless prose is as even with a
#: chance of at most ``RARE`` only: repeats have more, encoded texts are in between.
EVEN, RARE = 3.5, 0.01
#: Share of false discoveries allowed.
FALSE_RATE = 0.01
#: Steps of the histogram for a factor of ten of the p-value, and its last step.
STEPS, LAST_STEP = 10, 400
MASK = "[secret]"


def below(z: float) -> float:
    """The standard normal distribution function."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def battery(text: str) -> tuple[str, float]:
    """Encoding of a string, and the chance that ordinary text looks as random."""
    body = text.rstrip("=")
    letters = set(body)
    name = next((n for n, s in SETS.items() if letters <= s), None)
    if name is None:
        return "mixed", 1.0
    if name == "decimal":  # numbers are as even as random digits; the pattern for hex takes all of them
        return name, 1.0
    numbers = NUMBERS[name]
    values = [numbers[c] for c in body]
    n, k = len(values), len(numbers)
    high = [v >= k / 2 for v in values]
    a = sum(high)
    b = n - a
    if not a or not b:
        return name, 1.0
    count: dict[int, int] = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    pairs = n * (n - 1) / 2
    equal = sum(c * (c - 1) for c in count.values()) / 2  # chi-squared is 2 k / n of it, and a constant
    even = (equal - pairs / k) / math.sqrt(pairs / k * (1 - 1 / k))
    two, three = PROSE_HEX if name.endswith("hex") else PROSE
    spread = math.sqrt(pairs * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two))
    if even > EVEN and below((equal - pairs * two) / spread) > RARE:
        return name, 1.0
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 2 * a * b / n + 1
    wide = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    middle = sum(values) / n
    power = sum((v - middle) ** 2 for v in values)
    serial = sum((x - middle) * (y - middle) for x, y in zip(values, values[1:], strict=False)) / power if power else 1.0
    two_sided = min(2 * below(-abs(runs - mean) / wide), 2 * below(-abs(serial * math.sqrt(n))))
    return name, math.exp(min(0.0, prose.log_chance(body) + n * math.log(k))) if two_sided >= ALPHA / 2 else 1.0


def length_class(n: int) -> int:
    return min(n.bit_length(), 12)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind, end; in this order."""
    spans = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    small = text.lower()
    if any(k in small for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    return sorted(spans)


def gaps(base: list[tuple[int, int, int]], end: int) -> Iterator[tuple[int, int]]:
    """Start and end of what lies between the base spans."""
    at = 0
    for start, _, stop in base:
        if start > at:
            yield at, start
        at = max(at, stop)
    yield at, end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """Start, end, class and step of the runs outside the base spans.

    Where a run has long parts between separators, either it or they are candidates, whichever is more random; their
    p-values double for the choice.
    """
    out = []
    for gap in gaps(base, len(text)):
        for m in RUN.finditer(text, *gap):
            tested, choices = [(m, *battery(m.group()))], 1
            parts = [(part, *battery(part.group())) for part in PART.finditer(text, *m.span()) if part.span() != m.span()]
            if parts:
                choices = 2
                if min(p for _, _, p in parts) < tested[0][2]:
                    tested = parts
            out += [(c.start(), c.end(), f"{name} {length_class(c.end() - c.start())}", step_of(min(1.0, choices * p))) for c, name, p in tested]
    return out


def step_of(p: float) -> int:
    return min(LAST_STEP, int(-math.log10(max(p, 1e-300)) * STEPS))


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())])
CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.string()), ("step", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` (spans of the fixed patterns) and ``runs`` (candidates with class and step) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [base_spans(t) for t in batch.column("text").to_pylist()]
            runs = [candidates(t, b) for t, b in zip(batch.column("text").to_pylist(), base, strict=True)]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in b] for b in base], pa.list_(SPAN)),
                pa.array([[dict(zip(("start", "end", "class", "step"), c, strict=True)) for c in r] for r in runs], pa.list_(CANDIDATE))],
                ["doc_id", "base", "runs"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, base array<struct<start: long, kind: long, end: long>>, "
                                "runs array<struct<start: long, end: long, class: string, step: long>>")


def step_limits(scanned: DataFrame, rate: float = FALSE_RATE) -> dict[str, int]:
    """The smallest step that counts as random, by class; classes without one are left out.

    The driver gets a histogram of at most 401 rows for each of about a hundred classes, whatever the table's size.
    """
    counts: dict[str, dict[int, int]] = {}
    for r in scanned.select(F.explode("runs").alias("r")).groupBy("r.class", "r.step").count().collect():
        counts.setdefault(r["class"], {})[r["step"]] = r["count"]
    limits = {}
    for name, steps in counts.items():
        tested, found = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            found += steps[step]
            if 10 ** (-step / STEPS) <= rate * found / tested:
                limits[name] = step
    return limits


def with_spans(scanned: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: the base spans and the random runs, by start and kind."""
    least = F.create_map(*[F.lit(x) for item in limits.items() for x in item]) if limits else F.lit(None).cast("map<string,int>")
    random = F.transform(
        F.filter("runs", lambda r: F.coalesce(r["step"] >= F.element_at(least, r["class"]), F.lit(False))),
        lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).cast("long").alias("kind"), r["end"].alias("end")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def of_kind(kind: int) -> Callable[[Column], Column]:
    """Whether a span is of a kind; of one argument, for Spark gives a second one the span's place."""
    return lambda s: s["kind"] == kind


def shown(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"].cast("int") + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``spans``, arrays of start, kind and end (code points).

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored and a null text is empty. Equal rows get equal
    spans. A table without candidates has base spans only.
    """
    scanned = staged(scan(docs))
    return with_spans(scanned, step_limits(scanned, rate))


def redact(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """``docs``, all columns, with ``MASK`` in place of every span (overlapping ones as one); ``n_chars``, if there, follows."""
    limits = step_limits(staged(scan(docs).select("doc_id", "runs")), rate)
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [None if t is None else masked(t, limits) for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], columns[chars].type)
            yield pa.record_batch(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, limits: dict[str, int]) -> str:
    base = base_spans(text)
    spans = [(s, e) for s, _, e in base] + [(s, e) for s, e, name, step in candidates(text, base) if step >= limits.get(name, LAST_STEP + 1)]
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])
