"""Byte-level BPE encoding by longest matches and backtracking, and decoding.

The vocabulary's byte strings, mapped to Latin-1, form one Aho-Corasick automaton. A run over
a piece gives the longest token at every place. The encoder takes longest matches; where the
last two tokens could not stand side by side in a result of the merges, it tries the next
shorter prefix token, and goes back where none is left. Whether two tokens may be adjacent
depends on these two alone and is remembered, so each place is visited a bounded number of
times and the result is the same as that of the merges.

Defined cases: a null or empty text has no ids (both digests are those of no bytes); an empty
table gives no rows; a repeated document gives a row each time; other columns are ignored;
special tokens' strings are ordinary text; long texts and long pieces are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.memory import Bounded, held
from loomwell.llm.shared import small_batches, text_or_empty
from loomwell.llm.words import WordIds, runs, spread

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SCHEMA_IDS = SCHEMA + ", ids binary"


class Vocabulary:
    """A rank file's tokens, their automaton, and which tokens may be adjacent."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        self.tokens = tokens
        self.size = [len(token) for token in tokens]
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.machine = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self.machine.add_word(token.decode("latin-1"), i)
        self.machine.make_automaton()
        self.shorter = [self._prefix(token) for token in tokens]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        self.known: dict[int, bool] = {}
        for i, token in enumerate(tokens):
            self.halves.append(self._halves_of(i, token))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a rank file: lines of a base64 token and its rank, ranks from 0 without gaps."""
        ranks: dict[int, bytes] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[int(rank)] = base64.b64decode(token)
        if sorted(ranks) != list(range(len(ranks))):
            raise ValueError(f"{path}: ranks have gaps")
        return cls([ranks[i] for i in range(len(ranks))])

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((r for n in range(len(token) - 1, 0, -1) if (r := self.rank.get(token[:n])) is not None), -1)

    def _halves_of(self, i: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge is token i; (i, i) if no merge makes it."""
        left = self.shorter[i]
        while left >= 0:
            right = self.rank.get(token[len(self.tokens[left]) :], -1)
            if left < i and 0 <= right < i and self._may_meet(left, right):
                self.merged[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _may_meet(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between tokens a and b alone.

        The tokens on both sides of the border are undone, the later merge first. At each
        point the pair at the border must not be one that merges before what was undone.
        """
        before = len(self.tokens)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < before:
                return False
            undo_left = a > b
            for _ in range(2):
                if undo_left:
                    inner = self.halves[a][1]
                    if inner != a:
                        before, a = a, inner
                        break
                else:
                    inner = self.halves[b][0]
                    if inner != b:
                        before, b = b + 1, inner
                        break
                undo_left = not undo_left
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the pre-tokenizer, by backtracking from longest matches."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, known = len(piece), self.size, self.shorter, self.known
        longest = [0] * n
        for end, token in self.machine.iter(piece.decode("latin-1")):
            longest[end - size[token] + 1] = token  # ends grow, so the last one is the longest
        shut: set[int] = set()
        token = longest[0]
        at, end, last, out = 0, size[token], -1, []
        while True:
            fits = end not in shut
            if fits and last >= 0:
                fits = known.get(last << 32 | token)
                if fits is None:
                    if len(known) >= 300_000:
                        known.clear()
                    fits = known[last << 32 | token] = self._may_meet(last, token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                shut.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
            end = at + size[token]


class Encoder:
    """Whole texts to little-endian 32-bit ids and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.piece = Bounded(self._piece).get
        self.encode = WordIds(lambda units: list(map(self._unit, units)), lambda texts: list(map(self._text, texts)), [])
        sizes = np.array(vocabulary.size, dtype=np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(vocabulary.tokens), dtype=np.uint8)

    def _piece(self, piece: str) -> bytes:
        return array("I", self.vocabulary.encode_piece(piece.encode())).tobytes()

    def _text(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def _unit(self, unit: str) -> bytes:
        """Letters, with a space before them or not, are one match of the pattern."""
        return self._piece(unit) if unit.removeprefix(" ").isalpha() else self._text(unit)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """The bytes of texts that have so many of the ids each, gathered from one array of all tokens."""
        ends = np.cumsum(self.sizes[ids])
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        parts = [self.bytes[spread(self.starts[part], self.sizes[part])].tobytes() for at in range(0, len(ids), 1 << 18) if len(part := ids[at : at + (1 << 18)])]
        out = b"".join(parts)
        yield from (out[begin:end] for begin, end in zip(cuts, cuts[1:], strict=False))


def encoder(path: str, pattern: str) -> Encoder:
    return held(f"bpe {path} {pattern}", lambda: Encoder(Vocabulary.load(path), pattern))


def _run(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            counts, heads, tails, kept = [], [], [], []
            for begin, stop in runs(batch.column(1)):
                ids, sizes = own.encode(batch.column(1).slice(begin, stop - begin))
                raw = memoryview(ids).cast("B") if len(ids) else b""
                ends = (4 * np.cumsum(sizes)).tolist()
                texts = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                counts += sizes.tolist()
                heads += [sha(text).hexdigest() for text in texts]
                tails += [sha(text).hexdigest() for text in own.decode(ids, sizes)]
                if with_ids:
                    kept += map(bytes, texts)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(heads), pa.array(tails)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode every whole text, decode the ids, and report count and digests (and ids)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col)).mapInArrow(
        _run(ranks_path, pattern, with_ids), SCHEMA_IDS if with_ids else SCHEMA
    )
