"""Byte-level BPE on a sentencepiece model that is serialised here from the vocabulary.

Every byte is mapped to one letter of its own, so that a vocabulary entry becomes a
string; the piece of rank r scores -r, and sentencepiece's merge order (best score, then
leftmost) is the order of the ranks. The model normalises nothing. A text is cut into
pre-tokens; each is an entry itself or is encoded on its own; ids are decoded by the
inverse mapping of the model's pieces.
"""

from __future__ import annotations

import base64
import struct
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FIRST = 0x4E00  # byte b is the letter FIRST + b
CACHE = 200_000  # pre-tokens whose ids a task remembers; a full cache is emptied


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def lettered(data: bytes) -> str:
    return "".join([chr(FIRST + b) for b in data])


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A serialised ModelProto: piece i has rank i; the last piece is the unknown, which no text can reach.

    Field numbers and enum values are fixed by the format: pieces 1 (piece 1, score 2, type 3: normal 1,
    unknown 2), trainer 2 (model type 3: BPE 2, vocabulary size 4, byte fallback 35), normaliser 3 (name 1,
    dummy prefix 3, extra white space 4, escaped white space 5).
    """
    entries = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in entries] != list(range(len(entries))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must count from 0 without gaps and hold all 256 bytes")
    pieces = [_field(1, _field(1, lettered(t).encode()) + _field(2, float(-r)) + _field(3, 1)) for t, r in entries]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(2, _field(3, 2) + _field(4, len(pieces)) + _field(35, 0) + _field(40, len(entries)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1))
    normaliser = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + normaliser


class Codec:
    """Encodes and decodes whole texts; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        n = self.model.vocab_size() - 1
        self.token = [bytes([ord(c) - FIRST for c in self.model.id_to_piece(i)]) for i in range(n)]
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.token)}
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        parts = self.cut(text) if text else []
        new = list(set(parts).difference(self.cache))
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache, new = {}, list(set(parts))
            raw = [p.encode("utf-8", "surrogatepass") for p in new]
            known = [self.whole.get(r) for r in raw]
            rest = [k for k, ids in enumerate(known) if ids is None]
            for k, ids in zip(rest, self.model.encode([lettered(raw[k]) for k in rest], num_threads=1) if rest else []):
                known[k] = struct.pack(f"<{len(ids)}I", *ids)
            self.cache.update(zip(new, known))
        return b"".join(map(self.cache.__getitem__, parts))

    def decode(self, ids: bytes | None) -> bytes:
        numbers = array("I", ids or b"")
        return b"".join(map(self.token.__getitem__, numbers))


def _apply(docs: DataFrame, column: str, codec: tuple[bytes, str], made: dict[str, str], make) -> DataFrame:
    """Adds binary columns made from one column, batch by batch; columns of the same names are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(codec)
    docs = docs.drop(*made)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.BinaryType()) for n in made]])
    at = docs.columns.index(column)

    def run(batches):
        c = Codec(*model.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # results stay small next to very long texts
                part = batch.slice(k, 256)
                rows = [make(c, x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([r[i] for r in rows], pa.binary()) for i in range(len(made))]], names=[*part.schema.names, *made])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ``token_ids`` (packed little-endian unsigned 32-bit). Null and empty texts have no ids."""
    return _apply(docs, text_col, (model_of(ranks), pattern), {"token_ids": "binary"}, lambda c, x: (c.encode(x),))


def decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """docs with ``decoded``, the bytes of the ids; a null has none."""
    return _apply(docs, ids_col, (model_of(ranks), pattern), {"decoded": "binary"}, lambda c, x: (c.decode(x),))


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """Both in one pass, so that a task holds one model."""

    def both(c: Codec, text):
        ids = c.encode(text)
        return ids, c.decode(ids)

    return _apply(docs, text_col, (model_of(ranks), pattern), {"token_ids": "binary", "decoded": "binary"}, both)
