"""Units of texts: each is encoded once, remembered within bounds, and equal to plain encoding in its text."""

import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa

from loomwell.llm import bpe, packing
from loomwell.llm.words import WordIds

BITS = ["a", "Zé", "don't", "'s", "x'S,", " ", "  ", "\n", "\n\n", "\t", "\n ", ",", "...", "12b", "\x1f", "<|endoftext|>", "\xa0", "漢字", "é!", "😀", "\x1c", " ,"]


def odd_texts() -> list[str]:
    draw = random.Random(3)
    return ["", "b" * 200 + ", " + "c" * 64 + "."] + ["".join(draw.choice(BITS) for _ in range(draw.randrange(14))) for _ in range(3000)]


def split(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    return [part.tolist() for part in np.split(ids, np.cumsum(counts))[:-1]]


def test_packing_ids_equal_the_tokenizer():
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), odd_texts()
    plain = [e.ids for e in packing._tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    encode = packing._word_ids(path)
    for _ in range(2):
        assert split(*encode(pa.array(texts))) == plain


def test_byte_bpe_ids_equal_plain_pieces():
    encoder, texts = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), odd_texts()
    plain = [[i for piece in encoder.split(text) for i in encoder.vocabulary.encode_piece(piece.encode())] for text in texts]
    ids, counts = encoder.encode(pa.array(texts))
    assert split(ids, counts) == plain
    assert list(encoder.decode(ids, counts)) == [text.encode() for text in texts]


def counting(most: int = 64 << 20) -> tuple[WordIds, list[str]]:
    asked: list[str] = []

    def alone(units: list[str]) -> list[bytes]:
        asked.extend(units)
        return [b"\1\0\0\0"] * len(units)

    return WordIds(alone, alone, [], most), asked


def test_words_beside_marks_and_line_feeds_are_encoded_once():
    encode, asked = counting()
    for _ in range(2):
        encode(pa.array(["one two, two.\ntwo; one two", "one two\none two\none"]))
    assert sorted(asked) == sorted(["one", " two", ",", ".", "\n", "two", ";", " one"])


def test_what_is_remembered_is_bounded():
    encode, _ = counting(most=200_000)
    for run in range(40):
        encode(pa.array([" ".join(f"w{run}x{i}" for i in range(500))]))
        held = [*encode.known.items(), *encode.older.items()]
        assert sum(map(sys.getsizeof, [x for item in held for x in item])) < 500_000
