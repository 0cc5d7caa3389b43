"""Token ids of many texts at once: each different unit of a run of texts is looked up once, and gathered wherever it stands.

The pre-tokenizers' pattern begins a match at any single space between two other characters, at and behind a
single line feed between two others, and between a letter and an ASCII mark. So texts are cut there (by Arrow's functions) into units that
are encoded apart with the same result. A text with white space beside a space or a line feed, or either at an end, is encoded
whole, and so is one with an added token, which the tokenizer looks for in whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomwell.llm.memory import ENTRY

#: Stands between units while texts are cut; texts that have it are encoded whole.
CUT = "\x1f"
#: A letter (of those that every version of Unicode has) and the mark behind it.
LETTER_MARK = r"([A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\[-`{-~])"
#: White space at the ends or beside a space or a line feed, ASCII only; other white space is found in the units.
WIDE = r"^[ \n]|[ \n]$|[ \n][\s\x0b]|[\s\x0b][ \n]"
#: Bytes of text that are encoded at a time.
RUN = 2 << 20
#: Bytes of units that a worker remembers, in both generations.
MOST = 64 << 20
#: Characters of the longest unit that is remembered.
LONGEST = 64

Encode = Callable[[list[str]], list[bytes]]


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last (excluded) row of consecutive texts of about RUN bytes together."""
    if len(texts):
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // RUN
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        yield from zip(cuts, cuts[1:], strict=False)


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every stretch, one behind the other."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return np.repeat(begins.astype(np.int32) - ends + sizes.astype(np.int32), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


def odd(unit: str) -> bool:
    """Whether a unit (but for the space it may begin with) is empty, or begins or ends in white space."""
    bare = unit.removeprefix(" ")
    return unit != "\n" and (not bare or bare[0].isspace() or bare[-1].isspace())


class WordIds:
    """Ids of whole texts as 32-bit numbers, with those of units remembered in two generations.

    ``alone`` encodes units, ``whole`` whole texts, each apart; ``added`` are strings whose texts are encoded whole.
    """

    def __init__(self, alone: Encode, whole: Encode, added: list[str], most: int = MOST):
        self.alone, self.whole, self.added, self.most = alone, whole, added, most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = 0

    def _units(self, units: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of different units, and the places of odd ones, which have none."""
        ids = list(map(self.known.get, units))
        found: list[int] = []
        new: list[int] = []
        strange: list[int] = []
        for at, known in enumerate(ids):
            if known is None:
                ids[at] = old = self.older.get(units[at])
                if old is not None:
                    found.append(at)
                elif odd(units[at]):
                    strange.append(at)
                    ids[at] = b""
                else:
                    new.append(at)
        for at, made in zip(new, self.alone([units[at] for at in new]), strict=True):
            ids[at] = made
        for at in chain(found, new):
            unit = units[at]
            if len(unit) <= LONGEST:
                self.known[unit] = ids[at]
                self.bytes += len(unit) + len(ids[at]) + ENTRY
        if self.bytes > self.most // 2:
            self.known, self.older, self.bytes = {}, self.known, 0
        return ids, strange

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each text has. No text is null."""
        apart = pc.match_substring_regex(texts, WIDE).to_numpy(zero_copy_only=False).copy()
        for token in (CUT, *self.added):
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(apart), "", texts)
        cut = pc.replace_substring(cut, " ", CUT + " ")
        cut = pc.replace_substring(cut, "\n", f"{CUT}\n{CUT}")
        lists = pc.split_pattern(pc.replace_substring_regex(cut, LETTER_MARK, f"\\1{CUT}\\2"), CUT)
        begins = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        table, strange = self._units(coded.dictionary.to_pylist())
        if strange:
            is_odd = np.zeros(len(table), dtype=np.int64)
            is_odd[strange] = 1
            apart |= np.add.reduceat(is_odd[code], begins[:-1]) > 0
        at = np.flatnonzero(apart)
        if len(at):  # one place in the table for each such text, instead of its units
            sizes = np.diff(begins)
            code, sizes = code[np.repeat(~apart, sizes)], np.where(apart, 0, sizes)
            code = np.insert(code, np.cumsum(sizes)[at], len(table) + np.arange(len(at)))
            begins = np.concatenate([[0], np.cumsum(sizes + apart)])
            table += self.whole(texts.take(pa.array(at)).to_pylist())
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        ids = np.frombuffer(b"".join(table), "<u4")
        sizes = size[code]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids[spread((np.cumsum(size) - size)[code], sizes)], np.diff(ends[begins])
