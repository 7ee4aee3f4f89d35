"""Encoding of a corpus with a public byte-level BPE vocabulary, through a SentencePiece model made from it.

The model file is written directly: each token of the vocabulary becomes a piece spelt in byte-mapped characters with
the score of its negative rank, under identity normalisation and without a dummy prefix. A text is cut into pre-tokens
by the vocabulary's pattern; pre-tokens are byte-mapped and encoded, each distinct one once per batch. Pieces keep
their rank as id, so no table is needed afterwards; decoding maps the pieces' characters back to bytes.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text; white space, broken
encodings and any script are kept exactly (the round trip gives back the text); texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every function that needs it.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published pattern of pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache
def byte_letters() -> tuple[str, ...]:
    """A printable character for each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in set(printable) else chr(next(others)) for b in range(256))


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised SentencePiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    if [rank for _, rank in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = bytearray()
    for token, rank in by_rank:
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))))
    unknown = _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2))
    out += _field(1, 2, unknown)
    trainer = (
        _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(by_rank) + 1)) + _field(40, 0, _varint(len(by_rank)))
        + b"".join(_field(n, 0, _varint(-1)) for n in (41, 42, 43))
    )
    normalizer = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normalizer))


@lru_cache(maxsize=2)
def _tools(path: str):
    """The processor and the pattern; once per Python worker."""
    import regex
    import sentencepiece

    lines = Path(path).read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks)), regex.compile(PATTERN)


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    processor, pattern = _tools(path)
    letters = byte_letters()
    words = [pattern.findall(t) if t else [] for t in texts]
    distinct = list({w for ws in words for w in ws})
    spelt = ["".join([letters[b] for b in w.encode("utf-8", "replace")]) for w in distinct]
    known = dict(zip(distinct, processor.encode(spelt, num_threads=1)))
    return [[i for w in ws for i in known[w]] for ws in words]


def decode_ids(ids: list[int], path: str) -> str:
    processor, _ = _tools(path)
    back = {letter: b for b, letter in enumerate(byte_letters())}
    return bytes(back[c] for i in ids for c in processor.id_to_piece(int(i))).decode("utf-8", "replace")


#: Characters encoded together: bounds the pre-token lists of a worker, whatever the batch holds.
CHARS_AT_ONCE = 2_000_000


def token_ids(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """The ids of a text column as array<int>; never null."""
    path = f"{folder}/{vocabulary}"

    def batches(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out: list[list[int]] = []
            part: list[str | None] = []
            chars = 0
            for text in texts:
                part.append(text)
                chars += len(text or "")
                if chars >= CHARS_AT_ONCE:
                    out += encode_texts(part, path)
                    part, chars = [], 0
            yield pd.Series(out + encode_texts(part, path), dtype="object")

    batches.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "array<int>")(text)
