"""Fill-in-the-middle forms of documents, made per batch by Arrow's compute functions alone.

A text is cut into units (a word with the white space before it; white space at the end is a unit). A batch's units lie in one
list array; flattened, every unit has the number of its document (parent index) and its place in it (ordinal). Comparing ordinals with the
cuts of the document gives each unit's role; the units of a role are filtered, rebuilt into one list a document and joined. Nothing in
that is a loop over rows, units or characters. Cuts and form follow from a hash of the seed and ``doc_id``, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: The marks of the pieces.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: A byte that UTF-8 never has, so it can stand between units.
END = b"\xff"
#: Texts are taken in portions of about this many bytes; a larger one stands alone.
PORTION = 8_000_000
FORMS = pa.array(["plain", "psm", "spm"])


def draws(seed: int, doc_id: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first digits of the SHA-256 of ``seed:doc_id``; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def modulo(number: pa.Array, by: pa.Array | int) -> pa.Array:
    return pc.subtract(number, pc.multiply(pc.divide(number, by), by))


def units(texts: pa.Array) -> pa.Array:
    """A list of units for each text, and after them one empty string."""
    return pc.split_pattern(pc.replace_substring_regex(texts.cast(pa.large_binary()), pattern=UNIT, replacement=b"\\0" + END), END)


def joined(flat: pa.Array, wanted: pa.Array, sizes: pa.Array) -> pa.Array:
    """The wanted units of every document as one text; ``sizes`` says how many each has."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)]).cast(pa.int32())
    lists = pa.ListArray.from_arrays(offsets, flat.filter(wanted))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).cast(pa.large_string())


def arranged(texts: pa.Array, h: list[pa.Array], plain_percent: int, spm_percent: int) -> list[pa.Array]:
    """Units, form, lengths of prefix and middle in code points (null if plain), and the output of every text."""
    lists = units(texts)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    one, other = (modulo(x, pc.add(n, 1)) for x in h[:2])
    low, high = pc.min_element_wise(one, other), pc.max_element_wise(one, other)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ends = pc.cumulative_sum(pc.add(n, 1))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(pc.subtract(ends, pc.add(n, 1)), parent))
    after_low = pc.greater_equal(ordinal, pc.take(low, parent))
    after_high = pc.greater_equal(ordinal, pc.take(high, parent))
    text_unit = pc.less(ordinal, pc.take(n, parent))
    prefix = joined(flat, pc.and_(pc.invert(after_low), text_unit), low)
    middle = joined(flat, pc.and_(after_low, pc.invert(after_high)), pc.subtract(high, low))
    suffix = joined(flat, pc.and_(after_high, text_unit), pc.subtract(n, high))
    texts = texts.cast(pa.large_string())
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(modulo(h[2], 100), 100 - plain_percent))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = pc.less(modulo(h[3], 100), spm_percent)
    mark = lambda m: pa.scalar(m, pa.large_string())
    none = mark("")
    output = pc.if_else(
        plain, texts, pc.if_else(
            spm, pc.binary_join_element_wise(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle, none),
            pc.binary_join_element_wise(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle, none)))
    form = pc.take(FORMS, pc.if_else(plain, 0, pc.if_else(spm, 2, 1)))
    null = pa.scalar(None, pa.int64())
    lengths = [pc.if_else(plain, null, pc.utf8_length(t).cast(pa.int64())) for t in (prefix, middle)]
    return [n, form, *lengths, output]


def portions(batch: pa.RecordBatch, size: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``PORTION`` bytes."""
    start, held = 0, 0
    for i, bytes_ in enumerate(size.to_pylist()):
        if i > start and held + bytes_ > PORTION:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += bytes_
    yield batch.slice(start)


def fill_in_middle(docs: DataFrame, seed: int = 42, plain_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null text is an empty one, a null id counts as an empty string in
    the hash; repeated ids are cut alike only where their texts have as many units. Texts that are empty or hold one of the marks
    stay plain, and so do ``plain_percent`` of the others; of the rest ``spm_percent`` put the suffix first. A text of any length is
    taken whole: a task needs some ten times the bytes of the longest text.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in portions(batch, pc.binary_length(batch.column("text"))):
                made = arranged(part.column("text"), [part.column(f"h{k}") for k in range(1, 5)], plain_percent, spm_percent)
                made[-1] = made[-1].cast(part.column("text").type)
                yield pa.record_batch([part.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[d.alias(f"h{k + 1}") for k, d in enumerate(draws(seed, "doc_id"))])
    return rows.mapInArrow(run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from; marks in it are those between the pieces, for texts with marks stay plain."""
    pieces = F.split(output, "<[PSM]>")
    order = lambda *at: F.concat(*[F.try_element_at(pieces, F.lit(k)) for k in at])
    return F.when(F.col(form) == "psm", order(2, 4, 3)).when(F.col(form) == "spm", order(3, 4, 2)).otherwise(F.col(output))
