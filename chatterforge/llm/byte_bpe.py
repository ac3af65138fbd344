"""Byte-level BPE over Arrow batches with the tokenizers library, and its exact inverse.

Encoding runs the library's vocabulary on whole texts, batch by batch.  A
byte-level vocabulary spells every byte as one printable character; decoding
reverses that table, so a token is a byte string that may hold a part of a
character, and only the joined bytes of a text are UTF-8 again.

Offsets are counted from the tokens' byte lengths: byte places first, then
character places through a byte-to-character map.  A token that starts inside
a character starts at that character; one that ends inside it ends after it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatterforge.llm.common import id_text

#: Texts handed to the library at once.
BATCH = 256


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte, reversed.

    Printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer and, by id, the bytes of each token; once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    to_byte = byte_characters()
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    table: list[bytes] = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        if all(c in to_byte for c in token):
            table[i] = bytes(to_byte[c] for c in token)
    return tokenizer, table


def character_offsets(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in code points of tokens with these byte lengths."""
    leads = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
    # Characters begun before each byte place.
    begun = np.concatenate([[0], np.cumsum(leads)])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inside = np.concatenate([~leads, [False]])
    return begun[starts] - inside[starts], begun[ends]


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    """The bytes of a token sequence; join before reading them as UTF-8."""
    return b"".join([table[i] for i in ids])


def _encode_batches(path: str, offsets: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, table = load(path)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                texts = batch["text"].to_pylist()
                rows: list[list] = [[] for _ in range(6)]
                for text, encoding in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                    ids = encoding.ids
                    packed = np.array(ids, "<u4")
                    decoded = decode_ids(ids, table)
                    values = [len(ids), packed.tobytes(), hashlib.sha256(packed.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    if offsets:
                        lengths = np.array([len(table[i]) for i in ids], np.int64)
                        values += [x.astype("<u4").tobytes() for x in character_offsets(text.encode(), lengths)]
                    for column, value in zip(rows, values):
                        column.append(value)
                columns = [pa.array(rows[0], pa.int64())]
                if offsets:
                    columns += [pa.array(rows[i], pa.binary()) for i in (1, 4, 5)]
                columns += [pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], _names(offsets))

    return run


def _names(offsets: bool) -> list[str]:
    return ["doc_id", "n_tokens", *["ids", "starts", "ends"] * offsets, "ids_sha256", "decoded_sha256"]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """One row per row of ``docs``: token count, digests and, with ``offsets``, the tokens.

    ``ids``, ``starts`` and ``ends`` are little-endian unsigned 32-bit arrays; the
    latter two are code-point places.  ``decoded_sha256`` is that of the bytes that
    decoding the ids gives.  Null texts count as empty and have no tokens; a very long text is encoded
    whole, as tokens may not be cut at a border, so a task holds its tokens at once; repeated
    rows and null ids are returned as they are; an empty table gives an empty
    result; other columns are not read.  Special tokens' strings are ordinary text.
    """
    kinds = {"doc_id": "bigint", "n_tokens": "bigint", "ids": "binary", "starts": "binary", "ends": "binary"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in _names(offsets))
    return id_text(docs, id_col, text_col).mapInArrow(_encode_batches(path, offsets), schema)


def _decode_batches(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = load(path)
        for batch in batches:
            texts = [
                decode_ids(np.frombuffer(packed or b"", "<u4").tolist(), table).decode("utf-8", "replace")
                for packed in batch["ids"].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from the ``ids`` of :func:`encode`; null ids give an empty text.

    Bytes that are no UTF-8, as when a sequence was cut inside a character, become
    U+FFFD.
    """
    return tokens.select("doc_id", "ids").mapInArrow(_decode_batches(path), "doc_id bigint, text string")
