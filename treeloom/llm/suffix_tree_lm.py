"""Language-model scoring by a probabilistic suffix tree over words.

A state is a context of the last words, at most ``DEPTH`` of them. A context s is retained if
it occurs at least ``LEAST`` times in the training texts and its next-word distribution diverges from
that of its suffix: for some next word x, its count times |ln(P(x|s) / P(x|suffix of s))| is at
least ``DIVERGENCE`` (half of the test's 1 % point, 6.63). Suffixes of retained contexts are
retained. The longest retained suffix of the words so far is the state that scores the next token;
its distribution is the counts smoothed towards that of its own suffix, down to add-one word
counts, so every state's distribution sums to one over the training vocabulary and one unknown word.

Counts, contexts and tests are over all training documents and none of them reaches the driver,
which sees two numbers, tokens and vocabulary. Chunks of documents and buckets of keys exchange packed
arrays in three rounds: counts of words and pairs; counts of longer runs whose inner pairs are
all frequent enough; and whether any chunk saw a context diverge, as a bit for each key that was sent before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, chunk_of, chunks, dealt, mixed, runs, words_in

DEPTH = 3
LEAST = 2
DIVERGENCE = 3.32
WEIGHT = 20.0  # pseudo-count of the suffix's distribution
CHUNK_BYTES = 6_000_000
CHUNKS_PER_BUCKET = 4  # buckets are fewer than chunks, so that there are fewer and larger pieces
END = np.uint64(0x6A09E667F3BCC909)  # the end of a text, as a token
BATCH = 24_000_000  # characters counted together
STEP = np.uint64(0x9E3779B97F4A7C15)
WORDS, PAIRS, LONGER = 1, 2, 3  # what is asked
BITS = {WORDS: 44, PAIRS: 36, LONGER: 36}  # of a key that are sent besides its bucket: a bucket has some million keys
REQUEST = "stage int, bucket int, chunk int, keys binary, more binary"
ANSWER = "chunk int, stage int, flags boolean, bucket int, more binary"
FLAGS = "stage int, bucket int, chunk int, flags binary"
SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts one after the other, and tokens of each (words and one end)."""
    words = words_in(texts, lower=True)
    sizes = words.sizes + 1
    out = np.full(int(sizes.sum()), END, U64)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(sizes) - 1] = False
    out[is_word] = words.hashes()
    return out, sizes


def run_keys(h: np.ndarray, longest: int) -> list[np.ndarray]:
    """Keys of the runs of 1, 2, ... ``longest`` tokens that end at each token; those that begin in an earlier text mean nothing."""
    out = [h]
    for n in range(2, longest + 1):
        before = np.concatenate((h[:1], out[-1][:-1]))
        out.append(mixed(before * STEP + h + np.uint64(n)))
    return out


def identities(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Bucket of each key and its last ``bits`` bits."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return bucket << np.uint64(bits) | keys & np.uint64((1 << bits) - 1)


def planes(x: np.ndarray) -> bytes:
    """Numbers by significance of their bytes, as many bytes as the largest needs (first byte: how many)."""
    x = np.ascontiguousarray(x.astype(U64))
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + (x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if width else len(x).to_bytes(8, "little"))


def numbers(raw: bytes) -> np.ndarray:
    width = raw[0]
    if not width:
        return np.zeros(int.from_bytes(raw[1:], "little"), U64)
    got = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, :width] = got.T
    return out.view(U64).reshape(-1)


def as_table(rows, schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.table([pa.array(c, kind[k]) for c, (_, k) in zip(columns, fields)], names=[name for name, _ in fields])


def requested(stage: int, ids: np.ndarray, counts: np.ndarray, chunk: int):
    """Rows of REQUEST for distinct sorted identities: steps between keys, and counts."""
    bucket = ids >> np.uint64(BITS[stage])
    for s, e in zip(*runs(bucket)):
        keys = ids[s:e] & np.uint64((1 << BITS[stage]) - 1)
        yield stage, int(bucket[s]), chunk, planes(np.diff(keys, prepend=np.uint64(0))), zlib.compress(planes(counts[s:e]), 1)


def keys_of(data: pa.Table) -> tuple[list[int], np.ndarray]:
    """How many keys each row of a bucket's requests has, and the keys."""
    keys = [np.cumsum(numbers(k), dtype=U64) for k in data["keys"].to_pylist()]
    return [len(k) for k in keys], np.concatenate(keys)


def counts_of(data: pa.Table) -> np.ndarray:
    return np.concatenate([numbers(zlib.decompress(m)) for m in data["more"].to_pylist()])


def combined(keys: np.ndarray, values: np.ndarray, how: np.ufunc) -> np.ndarray:
    """For every key, the values of all equal keys taken together."""
    order = np.argsort(keys)
    start, end = runs(keys[order])
    out = np.zeros(len(keys), values.dtype)
    out[order] = np.repeat(how.reduceat(values[order], start), end - start)
    return out


def answered(data: pa.Table) -> pa.Table:
    """One bucket: the sum over all chunks for every key that a chunk sent, in the order it was sent."""
    sizes, keys = keys_of(data)
    total = combined(keys, counts_of(data), np.add)
    cut = np.cumsum([0, *sizes])
    return as_table([(c, g, False, b, zlib.compress(planes(total[s:e]), 1)) for c, g, b, s, e in zip(data["chunk"].to_pylist(), data["stage"].to_pylist(), data["bucket"].to_pylist(), cut[:-1], cut[1:])], ANSWER)


def retained(data: pa.Table, flags: pa.Table) -> pa.Table:
    """One bucket: whether any chunk set the flag of a key, for every key that a chunk sent."""
    if not data.num_rows:
        return as_table([], ANSWER)
    sizes, keys = keys_of(data)
    got = dict(zip(flags["chunk"].to_pylist(), flags["flags"].to_pylist()))
    chunks_ = data["chunk"].to_pylist()
    bits = [np.unpackbits(np.frombuffer(got[c], np.uint8), count=k) if c in got else np.zeros(k, np.uint8) for c, k in zip(chunks_, sizes)]
    kept = combined(keys, np.concatenate(bits), np.maximum)
    cut = np.cumsum([0, *sizes])
    return as_table([(c, g, True, b, np.packbits(kept[s:e]).tobytes()) for c, g, b, s, e in zip(chunks_, data["stage"].to_pylist(), data["bucket"].to_pylist(), cut[:-1], cut[1:])], ANSWER)


def vocabulary(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """Tokens and distinct tokens of docs(__text)."""

    def run(batches):
        held, size = [], 0

        def rows():
            ids, counts = np.unique(identities(tokens_of(held)[0], buckets, BITS[WORDS]), return_counts=True)
            return as_table(requested(WORDS, ids, counts, 0), REQUEST).to_batches()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(t)
                size += len(t or "")
                if size >= BATCH:
                    yield from rows()
                    held, size = [], 0
        if held:
            yield from rows()

    def total(data):
        return pa.table({"n": [int(counts_of(data).sum())], "v": [len(np.unique(keys_of(data)[1]))]})

    r = docs.select("__text").mapInArrow(run, REQUEST).groupBy("bucket").applyInArrow(total, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(r[0] or 0), int(r[1] or 0)


class Chunk:
    """The tokens of one chunk of documents and the counts of the runs that end at each."""

    def __init__(self, data: pa.Table, tokens: int, buckets: int, depth: int, least: int):
        self.tokens, self.buckets, self.depth, self.least = tokens, buckets, depth, least
        self.held = np.array(data["__held"].to_pylist(), bool)
        h, self.sizes = tokens_of(data["__text"].cast(pa.binary()).to_pylist())
        self.keys = run_keys(h, depth + 1)
        self.learnt = np.repeat(~self.held, self.sizes)
        self.place = np.arange(len(h)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.made: dict[int, tuple] = {}
        self.count = [np.zeros(len(h), np.int64) for _ in range(depth + 1)]  # of the run of 1, 2, ... tokens that ends here

    def runs_asked(self, stage: int) -> list[tuple[int, np.ndarray]]:
        """(length, positions) of the runs that a stage asks for."""
        if stage == WORDS:
            return [(1, np.arange(len(self.place)))]
        if stage == PAIRS:
            return [(2, np.flatnonzero(self.place >= 1))]
        frequent = self.before(self.count[1] >= self.least)  # the pair that ends before the token
        out, ok = [], frequent
        for length in range(3, self.depth + 2):
            out.append((length, np.flatnonzero(ok & (self.place >= length - 1))))
            ok = ok & self.before(ok)
        return out

    @staticmethod
    def before(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x[:1], x[:-1]))

    def distinct(self, stage: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, list[np.ndarray]]:
        """The runs asked in a stage, the sorted distinct identities of their keys, and the place of each run's among these."""
        if stage not in self.made:
            asked = self.runs_asked(stage)
            keys = np.concatenate([np.zeros(0, U64), *[self.keys[k - 1][at] for k, at in asked]])
            ids, inverse = np.unique(identities(keys, self.buckets, BITS[stage]), return_inverse=True)
            self.made[stage] = asked, ids, np.split(inverse.astype(np.int32), np.cumsum([len(at) for _, at in asked])[:-1]) if asked else []
        return self.made[stage]

    def ask(self, stage: int, chunk: int):
        asked, ids, places = self.distinct(stage)
        weight = np.zeros(len(ids))
        for (_, at), place in zip(asked, places):
            weight += np.bincount(place, self.learnt[at], len(ids))
        yield from requested(stage, ids, weight, chunk)

    def take(self, stage: int, answers: list[bytes]) -> None:
        """Puts the answers of a stage where they belong."""
        values = np.concatenate([np.zeros(0, U64), *[numbers(zlib.decompress(m)) for m in answers]]).astype(np.int64)
        asked, _, places = self.distinct(stage)
        for (length, at), place in zip(asked, places):
            self.count[length - 1][at] = values[place]

    def can_diverge(self, d: int) -> np.ndarray:
        """Whether there is a context of d tokens before each token that is frequent enough and whose suffix has other next tokens."""
        can = (self.place >= d) & (self.before(self.count[d - 1]) >= self.least)
        return can & (self.count[d - 1] < self.before(self.count[d - 2])) if d > 1 else can

    def diverging(self, divergence: float) -> list[np.ndarray]:
        """Positions before which a context of 1, 2, ... tokens diverges, or is a suffix of one that does."""
        out = []
        longer = np.zeros(len(self.place), bool)
        for d in range(self.depth, 0, -1):
            a = np.flatnonzero(self.can_diverge(d))
            n_s, n_sx = self.count[d - 1][a - 1], self.count[d][a]
            below, n_x = (self.count[d - 2][a - 1], self.count[d - 1][a]) if d > 1 else (self.tokens, self.count[0][a])
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = n_sx * np.abs(np.log(n_sx / n_s) - np.log(n_x / below))
            longer[a] |= self.learnt[a] & (gain >= divergence)
            out.append(np.flatnonzero(longer))
        return out[::-1]

    def flag(self, divergence: float, chunk: int):
        """Rows of FLAGS: which of the keys that were sent are contexts that diverge here."""
        found = self.diverging(divergence)
        for stage in (WORDS, PAIRS, LONGER):
            asked, ids, places = self.distinct(stage)
            flags = np.zeros(len(ids), bool)
            for (length, at), place in zip(asked, places):
                if length <= self.depth:
                    flags[place[np.searchsorted(at, found[length - 1] - 1)]] = True
            for s, e in zip(*runs(ids >> np.uint64(BITS[stage]))):
                if flags[s:e].any():
                    yield stage, int(ids[s] >> np.uint64(BITS[stage])), chunk, np.packbits(flags[s:e]).tobytes()

    def scores(self, answers: dict[tuple, list[bytes]], vocabulary: int, weight: float) -> list[np.ndarray]:
        """Known tokens, base score and score of each text."""
        state = np.zeros(len(self.place), np.int64)
        for stage in (WORDS, PAIRS, LONGER):
            asked, ids, places = self.distinct(stage)
            cut = zip(*runs(ids >> np.uint64(BITS[stage])))
            kept = np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(m, np.uint8), count=e - s) for m, (s, e) in zip(answers.get((stage, True), []), cut)]])
            for (length, at), place in zip(asked, places):
                if length <= self.depth:
                    here = at[kept[place] > 0] + 1
                    here = here[here < len(state)]
                    state[here[self.place[here] >= length]] = length
        known = self.count[0]
        base = (known + 1) / (self.tokens + vocabulary + 1)
        p = base.copy()
        for d in range(1, self.depth + 1):
            a = np.flatnonzero(state >= d)
            p[a] = (self.count[d][a] + weight * p[a]) / (self.count[d - 1][a - 1] + weight)
        start = np.cumsum(self.sizes) - self.sizes
        return [np.add.reduceat(x, start) for x in ((known > 0).astype(np.int64), np.log10(base), np.log10(p))]


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, weight: float = WEIGHT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    Learns from the rows where held_out is false (null counts as true). A null text is empty: one end
    token. Without training rows every token has probability one. Rows that share an id are rows of their own.
    """
    n = chunks(docs, text_col, chunk_bytes)
    buckets = -(-n // CHUNKS_PER_BUCKET)
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(held_out, F.lit(True)).alias("__held"))
    tokens, distinct = vocabulary(base.filter("not __held"), buckets)
    groups = dealt(base.withColumn("__chunk", chunk_of(n, "__id", "__text")), n, "__chunk").groupBy("__chunk")

    def of(data, answers=None, needed=(WORDS, PAIRS, LONGER)):
        """A chunk that knows the answers it needs, and the answers by stage and kind."""
        chunk, got = Chunk(data, tokens, buckets, depth, least), {}
        if answers is not None:
            for g, flags, _, more in sorted(zip(*(answers[c].to_pylist() for c in ("stage", "flags", "bucket", "more")))):
                got.setdefault((g, flags), []).append(more)
            for stage in needed:
                if (stage, False) in got:
                    chunk.take(stage, got[stage, False])
        return chunk, got

    def first(key, data):
        chunk = of(data)[0]
        return as_table([*chunk.ask(WORDS, key[0].as_py()), *chunk.ask(PAIRS, key[0].as_py())], REQUEST)

    def second(key, data, answers):
        return as_table(of(data, answers, (PAIRS,))[0].ask(LONGER, key[0].as_py()), REQUEST)

    def third(key, data, answers):
        return as_table(of(data, answers)[0].flag(divergence, key[0].as_py()), FLAGS)

    def finish(key, data, answers):
        chunk, got = of(data, answers)
        known, plain, best = chunk.scores(got, distinct, weight)
        return pa.table([data["__id"], data["__held"], pa.array(chunk.sizes), pa.array(known), pa.array(np.full(len(known), tokens)), pa.array(plain), pa.array(best)], names=["id", *[c.split()[0] for c in SCORES.split(", ")]])

    to_buckets = lambda requests: dealt(requests, 2 * buckets, "stage", "bucket")
    to_chunks = lambda answers: dealt(answers, n, "chunk")
    by_bucket = lambda requests: requests.groupBy("stage", "bucket")
    asked = to_buckets(groups.applyInArrow(first, REQUEST))
    known = to_chunks(by_bucket(asked).applyInArrow(answered, ANSWER))
    longer = to_buckets(groups.cogroup(known.groupBy("chunk")).applyInArrow(second, REQUEST))
    known = known.unionByName(to_chunks(by_bucket(longer).applyInArrow(answered, ANSWER)))
    flags = to_buckets(groups.cogroup(known.groupBy("chunk")).applyInArrow(third, FLAGS))
    kept = by_bucket(asked.unionByName(longer)).cogroup(by_bucket(flags)).applyInArrow(retained, ANSWER)
    out = groups.cogroup(known.unionByName(to_chunks(kept)).groupBy("chunk")).applyInArrow(finish, f"id {docs.schema[id_col].dataType.simpleString()}, {SCORES}")
    return out.withColumnRenamed("id", id_col)
