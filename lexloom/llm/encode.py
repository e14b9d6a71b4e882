"""Encoding of a corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised straight from the vocabulary: every byte
of a token becomes one printable character, a token's score is its negative rank,
and normalisation is the identity. Texts are cut into pre-tokens by the
vocabulary's pattern; each distinct pre-token is encoded once in a Python worker
and the ids come back by lookup. Decoding is the inverse mapping.

Defined results: a null text and an empty text both give the empty list; text that
looks like a special token is ordinary text; nothing is trimmed or normalised;
repeated rows are encoded like any other; extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The split pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pre-tokens a worker remembers; past it the memory starts afresh.
REMEMBERED = 200_000
#: Characters of text encoded at once; bounds a worker's memory, not the text.
CHUNK = 2_000_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        if byte in printable:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's tokens in rank order."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError(f"the ranks in {path} have gaps")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; <unk> comes last."""
    letters = byte_letters()
    pieces = [(token.decode("latin-1").translate(dict(enumerate(letters))), -float(rank), 1) for rank, token in enumerate(tokens)]
    pieces.append(("<unk>", 0.0, 2))
    body = b"".join(_block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)) for text, score, kind in pieces)
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(k, -1) for k in (41, 42, 43))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Encodes texts; keeps the ids of the pre-tokens it has seen."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self._cut = regex.compile(PATTERN).findall
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._letters = dict(enumerate(byte_letters()))
        self._known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self._cut(t) for t in texts]
        fresh = set(chain.from_iterable(cut)).difference(self._known)
        if fresh:
            if len(self._known) + len(fresh) > REMEMBERED:
                self._known = {}
                fresh = set(chain.from_iterable(cut))
            words = list(fresh)
            mapped = [w.encode().decode("latin-1").translate(self._letters) for w in words]
            self._known.update(zip(words, self._pieces.encode(mapped, num_threads=1)))
        return [list(chain.from_iterable(map(self._known.__getitem__, tokens))) for tokens in cut]


#: One encoder per vocabulary in a worker process, which serves many tasks.
_encoders: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row. ``vocabulary`` is read on the driver
    only; its model (about 1 MB, fixed by the vocabulary) is broadcast."""
    serialised = serialise_model(read_ranks(vocabulary))
    model, name = df.sparkSession.sparkContext.broadcast(serialised), hashlib.sha256(serialised).hexdigest()
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(name) or _encoders.setdefault(name, Encoder(model.value))
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                    size += len(texts[last])
                    last += 1
                ids = encoder.encode(texts[first:last])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])
                first = last

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, text): the inverse of :func:`encode_texts`; null ids give a null text."""
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else b"".join(map(tokens.value.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")
