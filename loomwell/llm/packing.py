"""Power-of-two packing: each document is cut into pieces of binary length.

A document of n tokens becomes ``n // width`` pieces of full width and one piece for every
set bit of the rest, longest first. A piece is a sequence of its own, so no sequence crosses
documents, every sequence has a power-of-two length, and nothing is padded. Batches are
then formed from one bucket (one length) at a time.

Defined cases: a null or empty text has just the end token; an empty table gives no piece;
a repeated document is packed once per row; other columns are ignored; text of any length is
tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.memory import give_back, held
from loomwell.llm.shared import small_batches, text_or_empty
from loomwell.llm.words import Encode, WordIds, runs

WIDTH = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA_IDS = SCHEMA + ", ids array<int>"
#: Units handed to the tokenizer as one text.
TOGETHER = 2_000
#: Letters of every version of Unicode.
LETTERS = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
#: How a byte-level model writes each byte: as itself if it can be seen, else as the next character from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = {b: chr(b) for b in _SEEN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encoders(path: str) -> tuple[Encode, Encode, list[str]]:
    """Encoders of units and of whole texts, and the tokenizer's added tokens."""
    tokenizer = _tokenizer(path)
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]

    def whole(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    feed = np.frombuffer(whole(["\n"])[0], "<u4")
    tokenize, before = tokenizer.model.tokenize, tokenizer.pre_tokenizer
    bare = tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and not before.add_prefix_space

    def alone(units: list[str]) -> list[bytes]:
        """Letters, with a space before them or not, are one match of the pattern, and go to the tokenizer's model at once. Other units
        without white space but a space in front are encoded TOGETHER, each on a line of its own: a line feed is a token
        that none of them has, so the ids are cut there."""
        ids: dict[str, bytes] = {}
        if bare:
            for unit in units:
                if LETTERS(unit):
                    shown = unit.replace(" ", "Ġ") if unit.isascii() else "".join(map(SHOWN.__getitem__, unit.encode()))
                    ids[unit] = array("I", [token.id for token in tokenize(shown)]).tobytes()
        lines = [
            unit
            for unit in units
            if unit not in ids and len(unit.split()) == 1 and not unit[-1].isspace() and (not unit[0].isspace() or unit[0] == " " and not unit[1].isspace())
        ]
        if len(feed) == 1:
            for at in range(0, len(lines), TOGETHER):
                part = lines[at : at + TOGETHER]
                raw = whole(["\n".join(part)])[0]
                ends = [*np.flatnonzero(np.frombuffer(raw, "<u4") == feed[0]).tolist(), len(raw) // 4]
                ids.update((unit, raw[4 * begin : 4 * end]) for unit, begin, end in zip(part, [0, *[end + 1 for end in ends[:-1]]], ends, strict=True))
        rest = [unit for unit in units if unit not in ids]
        ids.update(zip(rest, whole(rest), strict=True))
        return [ids[unit] for unit in units]

    return alone, whole, added


def _word_ids(path: str) -> WordIds:
    return held(f"packing {path}", lambda: WordIds(*_encoders(path)))


def binary_lengths(n: int, width: int = WIDTH) -> list[int]:
    """Piece lengths of a document of n tokens, in order."""
    rest = n % width
    return [width] * (n // width) + [1 << b for b in range(width.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(path: str, width: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_ids(path)
        full, shapes = [width], [binary_lengths(r, width) for r in range(width)]
        for batch in batches:
            for begin, stop in runs(batch.column(1)):
                ids, counts = encode(batch.column(1).slice(begin, stop - begin))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4", copy=False)
                totals = counts + 1
                cut = [full * (n // width) + shapes[n % width] for n in totals.tolist()]
                row = np.repeat(np.arange(len(cut)), list(map(len, cut)))
                length = np.array(list(chain.from_iterable(cut)), dtype=np.int64)
                ends = np.cumsum(length)
                raw = memoryview(ids).cast("B")
                at = [0, *(4 * ends).tolist()]
                columns = [
                    batch.column(0).slice(begin, stop - begin).take(pa.array(row)),
                    pa.array(ends - length - (np.cumsum(totals) - totals)[row]),
                    pa.array(length),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()),
                    pa.array(totals[row]),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
            give_back()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece. ``sequence_id`` is unique without a shuffle: partition and row.
    ``bucket`` is the power of two by which batches are formed."""
    small_batches(docs.sparkSession)
    schema = SCHEMA_IDS if with_ids else SCHEMA
    pieces = docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)).mapInArrow(
        _pack(tokenizer_path, width, end_id, with_ids), schema
    )
    return (
        pieces.withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .withColumn("bucket", F.col("length"))
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces with their ids as one folder per bucket."""
    pieces.write.partitionBy("bucket").parquet(path)
