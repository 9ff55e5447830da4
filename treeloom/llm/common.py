"""What the operators share: tables, scratch space, words as hashes, and packed exchanges.

A packed exchange replaces one shuffled row per word window by arrays. Documents are
dealt into chunks of about ``CHUNK_BYTES`` of text, each chunk sends the sorted distinct
keys that it needs to buckets as packed arrays, and each bucket answers every chunk in
the order of its keys. A key that millions of documents share appears once per chunk, so
no bucket is hot; buckets and chunks grow in number, not in size, with the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, written  # noqa: F401

CHUNK_BYTES = 6_000_000
MOST_PARTITIONS = 20_000  # of an exchange between chunks and buckets; a partition then holds several of them, one after the other
NO_ID = np.iinfo(np.int64).max
U32, U64 = np.dtype("<u4"), np.dtype("<u8")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(df: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """How many chunks the texts make."""
    total = df.agg(F.sum(F.octet_length(F.col(text)) + 64)).first()[0] or 0
    return max(1, math.ceil(total / chunk_bytes))


def chunk_of(n: int, *columns: str):
    """A chunk by several columns, so that one hot key does not fill one chunk."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def dealt(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """df partitioned by columns of about n values. Unions of tables dealt alike, and their groups by these columns, need no exchange of their own, and each exchange is written once however often it is read."""
    return df.repartition(max(1, min(n, MOST_PARTITIONS)), *columns)


def rest(df: DataFrame, *taken: str) -> list[str]:
    """Columns that an operator carries along: all but those that it reads or makes."""
    return [c for c in df.columns if c not in taken]


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text; bytes.split() cuts at exactly these six bytes."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


SPACES = bytes(int(c == 32 or 9 <= c <= 13) for c in range(256))
BLOCK = 1 << 15  # bytes hashed at once
ODD = 0x9E3779B97F4A7C15


def powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = powers(ODD, 2 * BLOCK), powers(pow(ODD, -1, 1 << 64), BLOCK + 1)


@dataclass
class Words:
    """The words [^\\x20\\x09-\\x0D]+ of several texts: their places in ``raw`` and their number in each text."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    sizes: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(np.frombuffer(self.raw, np.uint8), self.start, self.end)

    def places(self) -> np.ndarray:
        """Place of each word in its text."""
        return np.arange(len(self.start)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes other than zero bytes at its end; starts rise. A polynomial hash from running sums, so that no span is an object of its own."""
    out, i = np.zeros(len(start), U64), 0
    room = np.zeros((2, 2 * BLOCK + 1), U64)
    while i < len(start):
        base = int(start[i])
        stop = int(np.searchsorted(start, base + BLOCK, "right"))
        size = int(end[i:stop].max()) - base
        power = POWERS[:size] if size <= len(POWERS) else powers(ODD, size)
        product, sums = room[:, : size + 1] if size < room.shape[1] else np.zeros((2, size + 1), U64)
        np.multiply(b[base : base + size], power, out=product[1:])
        np.cumsum(product[1:], out=sums[1:])
        s = start[i:stop] - base
        out[i:stop] = (sums[end[i:stop] - base] - sums[s]) * INVERSES[s]
        i = stop
    return mixed(out)


def words_in(texts: list, lower: bool = False) -> Words:
    """Words of texts (str, bytes or None)."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"" for t in texts]
    raw = b" ".join(parts) + b" "
    raw = raw.lower() if lower else raw
    space = np.frombuffer(raw.translate(SPACES), np.uint8)
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    change = change if space[0] else np.concatenate(([0], change))
    start, end = change[::2], change[1::2]
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    sizes = np.diff(np.searchsorted(start, ends), prepend=0)
    return Words(raw, start, end, sizes)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys >> np.uint64(32)) % np.uint64(n)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values in a sorted array."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return start, np.append(start[1:], len(values))
