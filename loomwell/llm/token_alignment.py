"""Alignment of two tokenizers: which ids of the one overlap which ids of the other, counted over the corpus.

Tokenizer A is a byte-level BPE, B a piece BPE with byte fallback; both encode a space and the text, so both cut the same
bytes. Two token occurrences are linked when their byte ranges overlap. The work goes in three steps:

1. Each task aligns its texts in chunks. A chunk keeps its links, and per *stripe* the distinct id pairs
   with the number of their links: pairs are added up before anything is shuffled.
2. Pairs go to the stripe of their B id (``b % STRIPES``, so that the frequent low ids are spread evenly). There
   ``np.add.at`` adds them into a dense block, rows by B id and columns by A id, whose row maxima are the best counts.
   A stripe's rows are as many as chunks, whatever the ids; they are added as they come.
3. Each chunk asks the stripes for its distinct pairs (a stripe's counts and the requests of one share of the chunks meet
   in one task, counts first), and the answers go to the chunk, where its links are scored.

No row holds more than ``PIECE`` values of an array: longer arrays go on in the rows that follow. Spark reads such tables back in batches
of thousands of rows, so the memory of a batch is bounded by the size of a row and by nothing else, neither by the files' size nor by the texts.

A text is cut into units, a space or one line feed and what follows up to the next white space, wherever it has no
other white space: both tokenizers begin a token there, so a unit's tokens, groups and links are the same in every text, and what a
worker has seen before it looks up. Any other text is one unit.

Defined cases: null and empty texts, and texts in which the joined bytes of A or B differ from space and text (a U+2581 in it, or a
lone surrogate), have no tokens: zeros and an empty digest; strings of special tokens are plain text; an empty table gives no
rows; texts of any length are encoded whole; repeated rows count and come out once each; a null id stays null; ties: every link whose
count equals its B id's highest is a best one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.memory import ENTRY, held
from loomwell.llm.shared import forget, materialise, small_batches, text_or_empty

#: Stripes of B ids. A block of counts has (size of B / STRIPES) rows and as many columns as A has ids.
STRIPES = 128
#: Characters of a chunk, about; a longer text is a chunk of its own.
CHUNK_CHARS = 4 << 20
#: Chunks whose requests to one stripe meet in one task.
CHUNKS_A_SHARE = 512
#: Values of an array in one row at most.
PIECE = 512
#: Rows of a stripe's block whose counts are given out at a time.
COUNTED_AT_ONCE = 32
#: Rows handed over at a time.
ROWS_AT_ONCE = 2048
#: Bytes of units that a worker remembers at most.
MOST = 64 << 20
LONGEST = 64
#: Characters handed to a tokenizer at a time.
CHARS_AT_ONCE = 1 << 20

#: Units that A encodes as one text.
UNITS_AT_ONCE = 50

REGULAR = re.compile(r"[ \n]\S+")
#: Finds white space after a unit's first character, or a unit without anything else.
OTHER = re.compile(r"(?s)\A(?:.\Z|.\S*\s|\S)").match


def byte_values() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Ids and byte lengths by both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        values = byte_values()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.mark = self.b.piece_to_id("▁")
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.sizes = [np.array(sizes, dtype=np.int64) for sizes in (self.a_sizes, self.b_sizes)]

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """A's and B's ids of all units in a row and the units' ends in bytes; None unless all are cut the same as alone, with their bytes.

        Units of one white space and what follows can be encoded by A as one text; bytes and ends are compared for all.
        """
        whole = "".join(units)
        if "▁" in whole or not _encodable(whole) or any(map(OTHER, units)):
            return None
        of_a = self.a.encode_batch_fast(["".join(units[i : i + UNITS_AT_ONCE]) for i in range(0, len(units), UNITS_AT_ONCE)], add_special_tokens=False)
        of_b = self.b.encode([t[1:] if t[0] == " " else t for t in units], num_threads=1)
        lines = [i for i, t in enumerate(units) if t[0] == "\n"]
        if any(of_b[i][:1] != [self.mark] for i in lines):
            return None
        for i in lines:
            del of_b[i][0]
        want = whole.encode()
        ends = np.fromiter(map(len, units) if whole.isascii() else (len(t.encode()) for t in units), np.int64, len(units)).cumsum()
        found = []
        for ids, table, sizes in ((chain.from_iterable(a.ids for a in of_a), self.a_bytes, self.sizes[0]), (chain.from_iterable(of_b), self.b_bytes, self.sizes[1])):
            ids = list(ids)
            if b"".join(map(table.__getitem__, ids)) != want:
                return None
            flat = np.array(ids, dtype=np.int64)
            stops = sizes[flat].cumsum()
            at = stops.searchsorted(ends)
            if (sizes[flat] == 0).any() or (stops[at] != ends).any():
                return None
            found.append(flat)
        return found[0], found[1], ends

    def encode(self, units: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both for each unit, a text with the space (or line feed) before it; None where bytes differ."""
        good = [i for i, u in enumerate(units) if "▁" not in u and _encodable(u)]
        out: list[tuple[list[int], list[int]] | None] = [None] * len(units)
        texts = [units[i] for i in good]
        # B puts a space before everything; before a line feed it becomes a token of its own, which goes
        of_a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        of_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        pairs = [(a.ids, b if text[0] == " " else b[1:]) for text, a, b in zip(texts, of_a, of_b, strict=True)]
        marked = all(text[0] == " " or b[:1] == [self.mark] for text, b in zip(texts, of_b, strict=True))
        want = [text.encode() for text in texts]
        # bytes that agree as a whole agree unit by unit if their lengths do
        same = marked and all(sum(map(sizes.__getitem__, ids)) == len(w) for pair, w in zip(pairs, want, strict=True) for sizes, ids in zip((self.a_sizes, self.b_sizes), pair))
        if not same or not all(b"".join([table[x] for pair in pairs for x in pair[k]]) == b"".join(want) for k, table in enumerate((self.a_bytes, self.b_bytes))):
            same = False
        for i, text, pair, w, b in zip(good, texts, pairs, want, of_b, strict=True):
            if same or ((text[0] == " " or b[:1] == [self.mark]) and b"".join(map(self.a_bytes.__getitem__, pair[0])) == w == b"".join(map(self.b_bytes.__getitem__, pair[1]))):
                out[i] = pair
        return out


def _encodable(text: str) -> bool:
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


def aligned(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int], names: list[str]) -> tuple[str, int, list[int]]:
    """Groups as text, their number, and the links as codes (B id in the upper half of 32 bits, A id in the lower).

    ``names``: decimal forms of ids. Sizes are by id.
    """
    codes, groups = [], []
    i = j = 0
    mine, others = names[a[0]], names[b[0]]
    a_end, b_end = a_sizes[a[0]], b_sizes[b[0]]
    while True:
        codes.append(b[j] << 16 | a[i])
        if a_end == b_end:
            groups.append(mine + "|" + others)
            i += 1
            j += 1
            if i == len(a):
                return ";".join(groups), len(groups), codes
            mine, others = names[a[i]], names[b[j]]
            a_end += a_sizes[a[i]]
            b_end += b_sizes[b[j]]
        elif a_end < b_end:
            i += 1
            mine += "," + names[a[i]]
            a_end += a_sizes[a[i]]
        else:
            j += 1
            others += "," + names[b[j]]
            b_end += b_sizes[b[j]]


#: A unit: groups, their number, numbers of A and B tokens, links.
Unit = tuple[bytes, int, int, int, bytes]


class Units:
    """Aligned units, remembered up to MOST bytes."""

    def __init__(self, a_path: str, b_path: str):
        self.tokenizers = Tokenizers(a_path, b_path)
        if len(self.tokenizers.a_bytes) > 1 << 16 or len(self.tokenizers.b_bytes) > 1 << 16:
            raise ValueError("ids of both tokenizers must fit in 16 bits")
        self.names = [str(k) for k in range(max(len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)))]
        # a token as it is shown: its id, and "," or "|" (A), ";" or nothing (B) after it
        self.shown = np.array([name + after for name in self.names for after in (",", "|", ";", "")], dtype="S6")
        self.shown_width = np.char.str_len(self.shown)
        self.known: dict[str, Unit | None] = {}
        self.bytes = 0

    def _make_all(self, units: list[str]) -> list[Unit | None]:
        """All units by array operations, or one by one where some need it."""
        together = self.tokenizers.together(units) if units else None
        if together is None:
            return list(map(self._make, self.tokenizers.encode(units)))
        a, b, ends = together
        a_ends, b_ends = (sizes[ids].cumsum() for sizes, ids in zip(self.tokenizers.sizes, (a, b), strict=True))
        # between two neighbouring ends of either kind there is one link
        stops = np.concatenate([a_ends, b_ends])
        stops.sort(kind="stable")  # merges the two runs
        stops = stops[np.diff(stops, prepend=-1) > 0]
        of_a, of_b = a_ends.searchsorted(stops), b_ends.searchsorted(stops)
        codes = (b[of_b] << 16 | a[of_a]).astype(np.uint32).tobytes()
        closes = (a_ends[of_a] == stops) & (b_ends[of_b] == stops)
        group_ends, a_upto, b_upto = stops[closes], of_a[closes] + 1, of_b[closes] + 1
        a_group, b_group = group_ends.searchsorted(a_ends), group_ends.searchsorted(b_ends)
        # a group's A tokens, then its B tokens, each with what follows it
        shown = np.empty(len(a) + len(b), dtype=np.int64)
        shown[np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group]] = a * 4 + (group_ends[a_group] == a_ends)
        b_at = np.arange(len(b)) + a_upto[b_group]
        last = b_ends.searchsorted(ends)
        closing = (group_ends[b_group] == b_ends) * 2
        closing[last] = 3
        shown[b_at] = b * 4 + closing
        text = self.shown[shown].tobytes().translate(None, b"\0")
        width = np.concatenate([[0], self.shown_width[shown].cumsum()])
        text_to = width[b_at[last] + 1].tolist()
        groups_to, links_to = group_ends.searchsorted(ends) + 1, stops.searchsorted(ends) + 1
        a_to, b_to = a_ends.searchsorted(ends) + 1, last + 1
        counts = [np.diff(x, prepend=0).tolist() for x in (groups_to, a_to, b_to)]
        links = (links_to * 4).tolist()
        return [
            (text[t0:t1], n, n_a, n_b, codes[c0:c1])
            for t0, t1, n, n_a, n_b, c0, c1 in zip([0, *text_to[:-1]], text_to, *counts, [0, *links[:-1]], links, strict=True)
        ]

    def _make(self, ids: tuple[list[int], list[int]] | None) -> Unit | None:
        if ids is None:
            return None
        a, b = ids
        groups, n, codes = aligned(a, self.tokenizers.a_sizes, b, self.tokenizers.b_sizes, self.names)
        return groups.encode(), n, len(a), len(b), array("I", codes).tobytes()

    def learn(self, units: list[str]) -> dict[str, Unit | None]:
        """The given units; those up to LONGEST characters are remembered."""
        if self.bytes > MOST:
            self.known.clear()
            self.bytes = 0
        known = self.known
        out = {unit: known[unit] for unit in units if unit in known}
        new = [unit for unit in units if unit not in out]
        at = 0
        while at < len(new):
            upto, size = at, 0
            while upto < len(new) and size < CHARS_AT_ONCE:
                size += len(new[upto])
                upto += 1
            part = new[at:upto]
            made = dict(zip(part, self._make_all(part), strict=True))
            out |= made
            if max(map(len, part)) > LONGEST:
                made = {u: m for u, m in made.items() if len(u) <= LONGEST}
            known |= made
            self.bytes += sum(map(len, made)) + len(made) * (2 * ENTRY + 100) + sum([len(m[0]) + len(m[4]) for m in made.values() if m])
            at = upto
        return out


def units_of(text: str) -> list[str]:
    """The units of a text, with the space before it."""
    if not text:
        return []
    spaced = " " + text
    units = REGULAR.findall(spaced)
    return units if sum(map(len, units)) == len(spaced) else [spaced]


#: A chunk's own rows have stripe OWN and are of one of these kinds, each numbered by ``at``: a document; then pieces of the numbers of all
#: documents' units, of the links of each different unit, of the numbers of these links' codes, and of the codes. ANSWER comes behind them.
DOCUMENT, UNITS, CODE_COUNTS, UNIT_CODES, CODES, ANSWER = range(6)
OWN = -1
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, n_units int"
CHUNK = f"chunk long, stripe int, kind int, at int, {DOC}, own array<int>, codes array<int>, times array<long>"
DOC_FIELDS = [f.split(" ")[0] for f in DOC.split(", ")]
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
FIELDS = [(name, TYPES[kind]) for name, kind in (f.split(" ") for f in CHUNK.split(", "))]


def _rows(n: int, **values) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk, a bounded number at a time. A number stands in all of them, what isn't given is null."""
    columns = []
    for name, kind in FIELDS:
        value = values.get(name)
        columns.append(pa.nulls(n, kind) if value is None else pa.array(np.full(n, value), kind) if isinstance(value, int) else value if isinstance(value, pa.Array) else pa.array(value, kind))
    batch = pa.RecordBatch.from_arrays(columns, [name for name, _ in FIELDS])
    for at in range(0, n, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Lists that begin at ``starts`` in ``values`` and reach to the next one."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def _starts(n: int) -> np.ndarray:
    return np.arange(0, n, PIECE)


class Chunk:
    """Texts of one task, aligned as they come: only numbers of units stay, and each different unit once."""

    def __init__(self, units: Units):
        self.units = units
        self.number: dict[str, int] = {}
        self.made: list[Unit | None] = []
        self.groups: list[bytes] = []
        self.broken: set[int] = set()
        self.doc_ids: list[int | None] = []
        self.per_doc: list[array] = []
        self.digests: list[str] = []
        self.chars = 0

    def add(self, doc_ids: list, texts: list[str]) -> None:
        number, made, groups = self.number, self.made, self.groups
        cuts = [units_of(text) for text in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(cuts)) if u not in number]
        known = self.units.learn(new)
        number.update(zip(new, range(len(made), len(made) + len(new)), strict=True))
        for u in new:
            made.append(unit := known[u])
            groups.append(unit[0] if unit else b"")
            if not unit:
                self.broken.add(number[u])
        for doc_id, text, cut in zip(doc_ids, texts, cuts, strict=True):
            own = array("i", map(number.__getitem__, cut))
            if self.broken and not self.broken.isdisjoint(own):
                own = array("i")
            self.doc_ids.append(doc_id)
            self.per_doc.append(own)
            self.digests.append(hashlib.sha256(b";".join(map(groups.__getitem__, own))).hexdigest() if own else "")
            self.chars += len(text)

    def rows(self, chunk: int, stripes: int) -> Iterator[pa.RecordBatch]:
        made = self.made
        sizes = np.array([(m[1], m[2], m[3], len(m[4]) // 4) if m else (0, 0, 0, 0) for m in made], dtype=np.int64).reshape(-1, 4)
        flat = np.frombuffer(b"".join(self.per_doc), np.int32)
        counts = np.array([len(own) for own in self.per_doc], dtype=np.int32)
        owner = np.repeat(np.arange(len(counts)), counts)
        totals = np.zeros((len(counts), 4), dtype=np.int64)
        for k in range(4):
            np.add.at(totals[:, k], owner, sizes[flat, k])
        used = np.bincount(flat, minlength=len(made))
        links = np.frombuffer(b"".join([m[4] if m else b"" for m in made]), dtype=np.uint32)
        codes, where = np.unique(links, return_inverse=True)
        times = np.zeros(len(codes), dtype=np.int64)
        np.add.at(times, where, np.repeat(used, sizes[:, 3]))
        yield from _rows(
            len(counts), chunk=chunk, stripe=OWN, kind=DOCUMENT, at=np.arange(len(counts)), doc_id=self.doc_ids, n_a=totals[:, 1], n_b=totals[:, 2], n_groups=totals[:, 0],
            n_links=totals[:, 3], digest=self.digests, n_units=counts,
        )
        for kind, own in ((UNITS, flat), (CODE_COUNTS, sizes[:, 3].astype(np.int32)), (UNIT_CODES, where.astype(np.int32)), (CODES, codes.view(np.int32))):
            starts = _starts(len(own))
            yield from _rows(len(starts), chunk=chunk, stripe=OWN, kind=kind, at=np.arange(len(starts)), own=_lists(starts, own))
        asked = np.flatnonzero(times)
        asked = asked[np.argsort((codes[asked] >> 16) % stripes, kind="stable")]
        stripe = ((codes[asked] >> 16) % stripes).astype(np.int32)
        starts = np.flatnonzero((np.arange(len(stripe)) - stripe.searchsorted(stripe)) % PIECE == 0)
        yield from _rows(len(starts), chunk=chunk, stripe=stripe[starts], codes=_lists(starts, codes[asked].view(np.int32)), times=_lists(starts, times[asked]))


def _align(a_path: str, b_path: str, stripes: int, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = held(f"alignment {a_path} {b_path}", lambda: Units(a_path, b_path))
        name, chunk = TaskContext.get().partitionId() << 32, Chunk(units)
        for batch in batches:
            chunk.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if chunk.chars >= chunk_chars:
                yield from chunk.rows(name, stripes)
                name, chunk = name + 1, Chunk(units)
        if chunk.doc_ids:
            yield from chunk.rows(name, stripes)

    return run


def _place(codes: np.ndarray, stripes: int, width: int) -> np.ndarray:
    """Where a pair stands in its stripe's block: row b // stripes, column a."""
    return (codes >> 16).astype(np.int64) // stripes * width + (codes & 0xFFFF)


def _flat(batch: pa.RecordBatch, name: str, low: int = 0, high: int | None = None) -> np.ndarray:
    """The values of the lists of some rows, one behind the other."""
    lists = batch.column(name)
    return lists.slice(low, (len(lists) if high is None else high) - low).flatten().to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """The values of integer columns in consecutive rows that have the same ones, the first of these rows and the one behind the last."""
    columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in names]
    change = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for column in columns:
        change |= column[1:] != column[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield tuple(int(column[low]) for column in columns), low, high


COUNTS = "stripe int, codes array<int>, counts array<long>, best array<boolean>"


def _count(stripes: int, width: int, rows: int):
    """Rows of one stripe after the other: adds pairs into the stripe's block, gives counts and the rows' maxima."""

    def finish(stripe: int, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, rows, COUNTED_AT_ONCE):
            part = block[first * width : (first + COUNTED_AT_ONCE) * width]
            best = part.reshape(-1, width).max(axis=1)
            at = np.flatnonzero(part)
            if not len(at):
                continue
            count = part[at]
            code = (((first + at // width) * stripes + stripe) << 16 | at % width).astype(np.uint32)
            starts = _starts(len(at))
            lists = [_lists(starts, code.view(np.int32)), _lists(starts, count), _lists(starts, count == best[at // width])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), stripe, dtype=np.int32)), *lists], ["stripe", "codes", "counts", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("alignment counts", dict)  # lets go of the units that the worker has remembered
        block = np.zeros(rows * width, dtype=np.int64)
        stripe = None
        for batch in batches:
            for (now,), low, high in _runs(batch, "stripe"):
                if stripe not in (None, now):
                    yield from finish(stripe, block)
                    block[:] = 0
                stripe = now
                np.add.at(block, _place(_flat(batch, "codes", low, high).view(np.uint32), stripes, width), _flat(batch, "times", low, high))
        if stripe is not None:
            yield from finish(stripe, block)

    return run


ANSWERS = "chunk long, codes array<int>, counts array<long>, best array<boolean>"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stripe and share: counts first, then the requests of chunks, each of which gets the counts of its codes."""
    held("alignment counts", dict)
    of, given, have = None, [], None
    for batch in batches:
        for (stripe, share, kind), low, high in _runs(batch, "stripe", "share", "kind"):
            if of != (stripe, share):
                of, given, have = (stripe, share), [], None
            asked = _flat(batch, "codes", low, high).view(np.uint32)
            if kind == 0:
                given.append((asked, _flat(batch, "counts", low, high), _flat(batch, "best", low, high)))
                continue
            if have is None:
                have, count, best = map(np.concatenate, zip(*given, strict=True))
                order, given = np.argsort(have), []
                have, count, best = have[order], count[order], best[order]
            at = np.searchsorted(have, asked)
            offsets = batch.column("codes").offsets.to_numpy()[low:high]
            starts = offsets - offsets[0]
            columns = [batch.column("chunk").slice(low, high - low), _lists(starts, asked.view(np.int32)), _lists(starts, count[at]), _lists(starts, best[at])]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "codes", "counts", "best"])


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: its own rows first, then the answers; gives one row per document."""

    def finish(docs: pa.Table, own: list[list[np.ndarray]], count: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
        units, code_counts, unit_codes = (np.concatenate(own[kind]) if own[kind] else np.empty(0, np.int32) for kind in (UNITS, CODE_COUNTS, UNIT_CODES))
        unit_counts = docs["n_units"].to_numpy()
        of_unit = np.repeat(np.arange(len(code_counts)), code_counts)
        owner = np.repeat(np.arange(len(unit_counts)), unit_counts)
        sums = []
        for value in (best, count):
            unit, doc = np.zeros(len(code_counts), np.int64), np.zeros(len(unit_counts), np.int64)
            np.add.at(unit, of_unit, value[unit_codes])
            np.add.at(doc, owner, unit[units])
            sums.append(pa.array(doc))
        arrays = [*[docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], *sums, docs["digest"]]
        yield from pa.Table.from_arrays(arrays, [f.split(" ")[0] for f in OUT.split(", ")]).to_batches(ROWS_AT_ONCE)

    held("alignment counts", dict)
    of, docs, own, codes = None, [], [], None
    for batch in batches:
        for (chunk, kind), low, high in _runs(batch, "chunk", "kind"):
            if of != chunk:
                if docs:
                    yield from finish(pa.Table.from_batches(docs), own, count, best)
                of, docs, own, codes = chunk, [], [[] for _ in range(ANSWER)], None
                count = best = np.empty(0, np.int64)
            if kind == DOCUMENT:
                docs.append(batch.slice(low, high - low).select(DOC_FIELDS))
            elif kind != ANSWER:
                own[kind].append(_flat(batch, "own", low, high))
            else:
                if codes is None:
                    codes = np.concatenate(own[CODES]).view(np.uint32)
                    count, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
                at = np.searchsorted(codes, _flat(batch, "codes", low, high).view(np.uint32))
                count[at], best[at] = _flat(batch, "counts", low, high), _flat(batch, "best", low, high)
    if docs:
        yield from finish(pa.Table.from_batches(docs), own, count, best)


def _parts(rows: DataFrame, most: int) -> int:
    """Shuffle partitions for rows of which ``most`` keys exist: a key's rows stream through a task, so several may share one."""
    session = rows.sparkSession
    return min(most, max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def pair_counts(requests: DataFrame, stripes: int, width: int, height: int) -> DataFrame:
    """stripe, codes, counts and best (whether a count is its B id's highest)."""
    dealt = requests.select("stripe", "codes", "times").repartition(_parts(requests, stripes), "stripe").sortWithinPartitions("stripe")
    return dealt.mapInArrow(_count(stripes, width, -(-height // stripes)), COUNTS)


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    sizes = Tokenizers(a_path, b_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    made, made_path = materialise(rows.mapInArrow(_align(a_path, b_path, stripes, chunk_chars), CHUNK), "alignment-chunks")
    requests = made.where(f"stripe <> {OWN}").select("stripe", "chunk", "codes", "times")
    counts, counts_path = materialise(pair_counts(requests, stripes, len(sizes.a_bytes), len(sizes.b_bytes)), "alignment-counts")
    own = made.where(f"stripe = {OWN}")
    chunks = own.where(f"kind = {DOCUMENT} AND at = 0").count()
    shares = max(1, -(-chunks // CHUNKS_A_SHARE))
    share = F.pmod(F.xxhash64("chunk"), F.lit(shares)).cast("int")
    asked = requests.select("stripe", share.alias("share"), F.lit(1).alias("kind"), "chunk", "codes", F.lit(None).cast("array<long>").alias("counts"), F.lit(None).cast("array<boolean>").alias("best"))
    stored = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "codes", "counts", "best")
    dealt = stored.unionByName(asked).repartition(_parts(requests, stripes * shares), "stripe", "share").sortWithinPartitions("stripe", "share", "kind")
    answers = dealt.mapInArrow(_answer, ANSWERS)
    mine = own.select("chunk", "kind", "at", *DOC_FIELDS, "own")
    meet = mine.unionByName(answers.withColumn("kind", F.lit(ANSWER)), allowMissingColumns=True)
    scored, _ = materialise(meet.repartition(_parts(meet, max(1, chunks)), "chunk").sortWithinPartitions("chunk", "kind", "at").mapInArrow(_score, OUT), "alignment-scores")
    forget(spark, made_path)
    forget(spark, counts_path)
    return scored
