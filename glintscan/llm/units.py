"""Texts as units that a byte-level tokenizer treats independently, and a bounded memory of their ids.

The tokenizers split a text by a pattern whose matches hold white space only at their start, or consist of it.
So no match crosses a place between a character and white space that follows it: every such place is a
boundary of the whole text, whatever stands around. A unit is a run of white space and the run of other characters
after it. Equal units have equal ids everywhere, so each needs the tokenizer once. Special tokens hold no white
space and so never cross a unit.

No match of these patterns goes on from a letter or digit to a punctuation character with no letter after it, so the
punctuation at the end of a unit is apart from the letter or digit before it, and each of the two is taken by itself.
"""

from __future__ import annotations

import itertools
import re
import string
import struct
import sys
import types
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The code points of Unicode's property White_Space, which the pattern's \s stands for.
WHITE = r"\t-\r \x85\xa0  -     　"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
BOUNDARY = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
WHITE_CHARACTERS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
#: A space or line feed after white space: where it stands no cut may be.
INNER = re.compile(f"[{WHITE}][ \n]")
#: Letters and digits that punctuation is cut from: those of the first blocks, on which all Unicode versions in use agree.
ENDS = frozenset(c for c in map(chr, range(0x530)) if c.isalpha() or c in string.digits)
#: Longer units are not remembered.
LONG_UNIT = 64


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


def units_of(texts: list[str]) -> pa.LargeListArray:
    """Every text cut at boundaries into units, in order; one may be empty.

    Where all white space but tabs and the like is single, a text is cut at spaces and line feeds only; then a unit may hold
    other boundaries. Any other text is cut by the pattern.
    """
    if any("\0" in t for t in texts):
        return pa.array(map(UNIT.findall, texts), pa.large_list(pa.large_string()))
    marked = ["\0".join(UNIT.findall(t)) if INNER.search(t) else t.replace(" ", "\0 ").replace("\n", "\0\n") for t in texts]
    return pc.split_pattern(pa.array(marked, pa.large_string()), "\0").cast(pa.large_list(pa.large_string()))


class UnitMemory:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``encode`` gives the ids of a list of units or parts of them. Units with punctuation of ``tails`` at their end are put
    together from two parts. What is encoded is kept in two generations: once the young one has over half of ``limit``
    entries, it takes the place of the old one, and what is met again of the old one moves to the young one. A text is taken
    in pieces of about ``chars`` characters, cut at unit boundaries, so a huge text needs little more than its ids.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], tails: str = string.punctuation, limit: int = 900_000, chars: int = 2_000_000):
        self.encode, self.tails, self.limit, self.chars, self.known, self.old = encode, tails, limit, chars, {}, {}

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        return [ids for part in portions(texts, self.chars) for ids in (
            self._encoded(part) if len(part) > 1 else [b"".join(i for p in pieces(part[0], self.chars) for i in self._encoded([p]))])]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        units = units_of(texts)
        coded = units.flatten().dictionary_encode()
        ids = self._of_units(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # the ids of the distinct units one after the other, then those of all units taken from there
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        unit = coded.indices.to_numpy()
        after = np.append(0, np.cumsum(sizes[unit]))
        place = np.repeat((np.cumsum(sizes) - sizes)[unit] - after[:-1], sizes[unit]) + np.arange(after[-1])
        out = np.frombuffer(b"".join(ids), "<u4")[place]
        cuts = after[units.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in itertools.pairwise(cuts)]

    def _of_units(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units."""
        known, old = self.known, self.old
        found = list(map(known.get, units))
        missing = [k for k, ids in enumerate(found) if ids is None]
        whole, places, heads, tails = [], [], [], []
        for k in missing:
            unit = units[k]
            head = unit.rstrip(self.tails)
            if head != unit and head[-1:] in ENDS:
                places.append(k)
                heads.append(head)
                tails.append(unit[len(head):])
            else:
                whole.append(k)
        parts = dict.fromkeys(units[k] for k in whole)
        parts.update(dict.fromkeys(p for p in itertools.chain(heads, dict.fromkeys(tails)) if p not in known))
        fresh = [p for p in parts if p not in old] if old else list(parts)
        if len(fresh) < len(parts):
            known.update({p: old[p] for p in parts if p in old})
        known.update(zip(fresh, self.encode(fresh), strict=True))
        for k in whole:
            found[k] = known[units[k]]
        for k, head, tail in zip(places, heads, tails, strict=True):
            found[k] = known[head] + known[tail]
        for p in fresh:
            if len(p) > LONG_UNIT:
                del known[p]
        if len(known) > self.limit // 2:
            self.known, self.old = {}, known
        return found


def kept_in_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python worker and kept for its later tasks; a new key takes the place of the old one."""
    kept = sys.modules.setdefault("_llm_kept_in_worker", types.ModuleType("_llm_kept_in_worker")).__dict__
    if kept.get("key") != key:
        kept["value"] = make()
        kept["key"] = key
    return kept["value"]


def portions(texts: Iterable[str], chars: int) -> Iterable[list[str]]:
    """Consecutive texts in lists of about ``chars`` characters; a longer text stands alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def pieces(text: str, chars: int) -> Iterable[str]:
    """``text`` cut at unit boundaries into pieces of ``chars`` characters, longer only where no boundary comes."""
    start = 0
    while len(text) - start > chars:
        cut = BOUNDARY.search(text, start + chars)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]
