"""Substring dedup by fixed-block anchors.

A passage of ``window`` consecutive words is removed from a document where the same word
sequence also starts in a document with a smaller id; passages are judged on the input.

1. Index and probe. Every document's words are cut into non-overlapping blocks of
   (window + 1) // 2 words; any window holds one whole block. Blocks are the index; every
   rolling run of block length is a probe. Both go to buckets as packed 32-bit remainders
   (the bucket number adds its bits, so false hits stay below one in a thousand at
   every size). A probe that meets an index block of another document is an anchor.
2. Extend. Each window over an anchor is looked up by a 96-bit key (plus the bucket) for
   the smallest document that has it. Windows found in smaller documents that overlap are
   one maximal exact repeat; its words are removed.

Only keys travel, never pairs of documents: a passage in a third of all documents is one
key for each chunk of text.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, NO_ID, U32, U64, bucket_of, chunk_of, chunks, dealt, mixed, rest, runs, words_in

CHUNKS_PER_BUCKET = 4  # buckets are fewer than chunks, so that there are fewer and larger pieces
M1, M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
REQUEST = "bucket int, chunk int, stage int, keys binary, more binary, low binary, high binary"
ANSWER = "chunk int, stage int, bucket int, bits binary"


def rolled(f: np.ndarray, width: int, at: np.ndarray | None, multiplier: int) -> np.ndarray:
    """Polynomial hash of ``width`` words from each position in ``at`` (None: all)."""
    n = max(0, len(f) - width + 1)
    out, m = np.zeros(n if at is None else len(at), U64), 1
    for k in range(width):
        out += (f[k : k + n] if at is None else f[at + k]) * np.uint64(m)
        m = m * multiplier & 0xFFFFFFFFFFFFFFFF
    return mixed(out)


class Chunk:
    """The words of one chunk of documents, in the order of their ids."""

    def __init__(self, data: pa.Table, window: int, n: int):
        ids = np.array([NO_ID if x is None else x for x in data["__id"].to_pylist()], np.int64)
        texts = data["__text"].cast(pa.binary()).to_pylist()
        self.order = np.lexsort((np.array([len(t or b"") for t in texts], np.int64), ids))
        self.words = words_in([texts[i] for i in self.order])
        self.sizes = self.words.sizes
        self.window, self.block, self.n = window, (window + 1) // 2, n
        self.f = self.words.hashes()
        self.row = np.repeat(np.arange(len(ids)), self.sizes)
        self.doc = ids[self.order][self.row]
        self.within = self.words.places()
        self._blocks()

    def _whole(self, width: int) -> np.ndarray:
        """Positions from which ``width`` words stay inside one document."""
        n = max(0, len(self.f) - width + 1)
        return np.flatnonzero(self.row[:n] == self.row[width - 1 :]) if n else np.zeros(0, np.int64)

    def _blocks(self) -> None:
        """Distinct block keys in order of (bucket, remainder)."""
        self.at = self._whole(self.block)
        h = rolled(self.f, self.block, None, M1)[self.at]
        ids = (bucket_of(h, self.n) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        self.sorted = np.argsort(ids)
        ids = ids[self.sorted]
        self.start, self.end = runs(ids)
        self.ids = ids[self.start]

    def block_requests(self, chunk: int):
        if not len(self.ids):
            return
        doc = self.doc[self.at][self.sorted]
        several = np.minimum.reduceat(doc, self.start) < np.maximum.reduceat(doc, self.start)
        indexed = np.logical_or.reduceat((self.within[self.at] % self.block == 0)[self.sorted], self.start)
        flags = indexed.astype(np.uint8) | (several.astype(np.uint8) << 1)
        keys, buckets = self.ids.astype(U32), self.ids >> np.uint64(32)
        for s, e in zip(*runs(buckets)):
            yield int(buckets[s]), chunk, 1, keys[s:e].tobytes(), flags[s:e].tobytes(), b"", b""

    def windows(self, answers: list[tuple[int, bytes]]) -> None:
        """Takes the anchors that the buckets found; makes the distinct keys of the windows over them."""
        hit = unpacked(self.ids >> np.uint64(32), answers)
        anchor = np.zeros(len(self.f) + 1, np.int64)
        anchor[self.at[self.sorted]] = np.repeat(hit, self.end - self.start)
        total = np.concatenate(([0], np.cumsum(anchor)))
        at = self._whole(self.window)
        self.over = at[total[at + self.window - self.block + 1] > total[at]]
        k1 = rolled(self.f, self.window, self.over, M1 ^ 2)
        k2 = rolled(mixed(self.f), self.window, self.over, M2).astype(U32)
        b = bucket_of(k1, self.n)
        self.over_sorted = np.lexsort((k2, k1, b))
        self.k1, self.k2, self.b = (x[self.over_sorted] for x in (k1, k2, b))
        same = np.zeros(len(k1), bool)
        same[1:] = (self.k1[1:] == self.k1[:-1]) & (self.k2[1:] == self.k2[:-1])
        self.key_start = np.flatnonzero(~same)
        self.key_end = np.append(self.key_start[1:], len(k1))
        doc = self.doc[self.over[self.over_sorted]]
        self.first = np.minimum.reduceat(doc, self.key_start) if len(doc) else doc

    def window_requests(self, chunk: int):
        k1, k2, b = (x[self.key_start] for x in (self.k1, self.k2, self.b))
        first = self.first.astype(U64)
        for s, e in zip(*runs(b)):
            low, high = first[s:e].astype(U32), (first[s:e] >> np.uint64(32)).astype(U32)
            yield int(b[s]), chunk, 2, k1[s:e].tobytes(), k2[s:e].tobytes(), low.tobytes(), high.tobytes()

    def removed(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """A flag for each word."""
        cover = np.zeros(len(self.f) + 1, np.int64)
        if len(self.over):
            earlier = unpacked(self.b[self.key_start], answers)
            size = self.key_end - self.key_start
            at = self.over[self.over_sorted]
            gone = at[np.repeat(earlier, size) | (self.doc[at] > np.repeat(self.first, size))]
            cover[gone] += 1
            np.subtract.at(cover, gone + self.window, 1)
        return np.cumsum(cover[:-1]) > 0


def unpacked(buckets: np.ndarray, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """The buckets' bits for keys in order of bucket."""
    got, out = dict(answers), np.zeros(len(buckets), bool)
    for s, e in zip(*runs(buckets)):
        if bits := got.get(int(buckets[s])):
            out[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s).astype(bool)
    return out


def requests(rows) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in REQUEST.split(", ")])


def answered(data):
    """One bucket: which of the keys sent to it are anchors (stage 1), or are in a smaller document (stage 2)."""
    r = data.to_pydict()
    sizes = [len(k) // (4 if s == 1 else 8) for k, s in zip(r["keys"], r["stage"])]
    if r["stage"][0] == 1:
        keys = np.frombuffer(b"".join(r["keys"]), U32)
        flags = np.frombuffer(b"".join(r["more"]), np.uint8)
        order = np.argsort(keys)
        start, end = runs(keys[order])
        docs = np.add.reduceat(1 + (flags[order] >> 1).astype(np.int64), start)
        alive = np.logical_or.reduceat((flags[order] & 1).astype(bool), start) & (docs > 1)
    else:
        keys, more = np.frombuffer(b"".join(r["keys"]), U64), np.frombuffer(b"".join(r["more"]), U32)
        doc = np.frombuffer(b"".join(r["low"]), U32).astype(U64) | np.frombuffer(b"".join(r["high"]), U32).astype(U64) << np.uint64(32)
        order = np.lexsort((more, keys))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], len(keys))
        first = np.minimum.reduceat(doc[order], start)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(alive, end - start) if r["stage"][0] == 1 else np.repeat(first, end - start) < doc[order]
    cut = np.cumsum([0, *sizes])
    bits = [np.packbits(out[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return pa.table([pa.array(x, k) for x, k in ((r["chunk"], pa.int32()), (r["stage"], pa.int32()), (r["bucket"], pa.int32()), (bits, pa.binary()))], names=["chunk", "stage", "bucket", "bits"])


def of_stage(data: pa.Table, stage: int) -> list[tuple[int, bytes]]:
    r = data.to_pydict()
    return [(b, x) for b, x, s in zip(r["bucket"], r["bits"], r["stage"]) if s == stage]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``.

    Every row is kept. A null text has no words (kept_text ''). Rows that share an id are one
    document's copies: neither removes from the other. A null id counts as larger than any.
    Columns of docs that have a result's name are replaced by it.
    """
    carried = rest(docs, id_col, text_col, "kept_text", "n_words", "n_removed")
    chunk_count = chunks(docs, text_col, chunk_bytes)
    n = -(-chunk_count // CHUNKS_PER_BUCKET)  # buckets
    whole = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("int")
    base = docs.select(chunk_of(chunk_count, id_col, text_col).alias("__chunk"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), whole.alias("__rest"))
    slim = base.select("__chunk", "__id", "__text", "__rest")

    def first(key, data):
        return requests(Chunk(data, window, n).block_requests(key[0].as_py()))

    def second(key, data, answers):
        c = Chunk(data, window, n)
        c.windows(of_stage(answers, 1))
        return requests(c.window_requests(key[0].as_py()))

    def third(key, data, answers):
        c = Chunk(data, window, n)
        c.windows(of_stage(answers, 1))
        gone = c.removed(of_stage(answers, 2))
        kept, ends = [], np.cumsum(c.sizes)
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[ends] - total[ends - c.sizes]
        for s, e, n_gone in zip(ends - c.sizes, ends, removed.tolist()):
            words = c.words.raw[c.words.start[s] : c.words.end[e - 1]].split() if e > s else []
            kept.append(b" ".join(compress(words, ~gone[s:e]) if n_gone else words).decode("utf-8", "surrogatepass"))
        data = data.take(pa.array(c.order))
        return pa.table([data["__id"], data["__text"], data["__rest"], pa.array(kept, pa.string()), pa.array(c.sizes, pa.int64()), pa.array(removed, pa.int64())], names=["__id", "__text", "__rest", "kept_text", "n_words", "n_removed"])

    groups = dealt(slim, chunk_count, "__chunk").groupBy("__chunk")
    ask = lambda requests: dealt(requests, n, "bucket").groupBy("bucket").applyInArrow(answered, ANSWER)
    anchors = dealt(ask(groups.applyInArrow(first, REQUEST)), chunk_count, "chunk")
    found = dealt(ask(groups.cogroup(anchors.groupBy("chunk")).applyInArrow(second, REQUEST)), chunk_count, "chunk")
    schema = T.StructType([*slim.schema.fields[1:], *T._parse_datatype_string("kept_text string, n_words long, n_removed long").fields])
    out = groups.cogroup(anchors.unionByName(found).groupBy("chunk")).applyInArrow(third, schema)
    kind = docs.schema[id_col].dataType
    return out.select(F.col("__id").cast(kind).alias(id_col), F.col("__text").alias(text_col), *[F.col(f"__rest.`{c}`") for c in carried], "kept_text", "n_words", "n_removed")
