"""SimHash near-dedup by the generalised pigeonhole principle.

Bits that go together over the corpus are put into one partition, so that partitions are
close to independent. Thresholds t_i, unequal and -1 for "not probed", are allocated by
dynamic programming on the estimated candidate counts. With ``miss`` 0, sum(t_i + 1) =
radius + 1: two fingerprints at most ``radius`` bits apart then agree to within t_i in some
probed partition i. With a larger ``miss`` the thresholds are the cheapest for which a pair
at the radius, its differing bits spread at random, fails to meet with at most that chance;
closer pairs fail more rarely. Each fingerprint goes to every value within t_i of its own;
fingerprints that meet are verified on all bits. Fewer and wider partitions take over as
the number of fingerprints grows and candidates come to outweigh probes.

A value that more than ``HOT`` rows share is split by further partitions of the bits that
it leaves open, under the same guarantee, and its parts again as long as a split at least halves
the pairs; so a mass of unrelated fingerprints with one value is not compared in one task. What
no split thins is a mass of near copies, which breadth-first search compares in few steps.

For similarity of word sets the fingerprint only finds candidates: bits are the signs of sums of weights that
shingles have by their hashes, so that two sets' bits differ by their angle whatever their sizes, and every pair
that meets within a wide radius is checked on its sets of shingles before it links.

Equal fingerprints are one row before probing. Rows that meet are compared inside the
task and only a spanning forest leaves it, so a group of n near copies yields at most n
edges for each partition, not n squared.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, U64, mixed, words_in, words_of, written
from .components import components

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
SMALL = 64  # groups up to this size are compared by shifting whole batches
QUADRATIC = 10  # weight of a candidate next to a probe among partitions of one cut: candidates fall on few tasks
CANDIDATE = 0.02  # time of a candidate next to a probe, by which cuts are compared
HOT = 20_000  # rows with one value that are compared in one task
PATH = 512  # base of the digits that name a split value's partition and pieces
STEPS = 1000  # steps in which the chance of a miss is counted


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words joined by a space; of all words if there are fewer."""
    if not words:
        return np.zeros(0, U64)
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    return np.fromiter((xxhash.xxh64_intdigest(line[s : e - 1], 42) for s, e in zip(starts[:n], last)), U64, n)


def balanced_weights() -> np.ndarray:
    """A weight for each value of a byte and each of eight bits: normal, centred, uncorrelated between bits."""
    x = np.random.default_rng(20_240_202).standard_normal((256, 8))
    return np.linalg.qr(x - x.mean(axis=0))[0]


WEIGHTS = balanced_weights()


def set_hashes(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of ``width`` lower-cased words (of all its words, if there are fewer), and whose each is."""
    w = words_in(texts, lower=True)
    h, place, size = w.hashes(), w.places(), np.repeat(w.sizes, w.sizes)
    row = np.repeat(np.arange(len(w.sizes)), w.sizes)
    hashes, rows = [], []
    for n in range(1, width + 1):
        at = np.flatnonzero(place + n <= size if n == width else (size == n) & (place == 0))
        x = np.full(len(at), n, U64)
        for k in range(n):
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
        hashes.append(x)
        rows.append(row[at])
    x, row = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[fresh], row[fresh]


def bit_votes(hashes: np.ndarray, row: np.ndarray, rows: int, weights: np.ndarray = BYTE_BITS) -> np.ndarray:
    """Sum over each row's hashes of the weights of their bits, most significant first: how many have each bit."""
    if not len(hashes):
        return np.zeros((rows, 64))
    octets = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)
    at = row * 256
    return np.concatenate([np.bincount(at + octets[:, k], minlength=rows * 256).reshape(rows, 256) @ weights for k in range(8)], axis=1)


def fingerprints_of(texts: list, width: int, bits: int, distinct: bool) -> list[bytes]:
    if distinct:
        flat, row = set_hashes(texts, width)
        middle = np.zeros((len(texts), 1))
    else:
        hashes = [shingle_hashes(words_of(t, lower=True), width) for t in texts]
        sizes = np.array([len(h) for h in hashes], np.int64)
        flat, row = np.concatenate(hashes) if hashes else np.zeros(0, U64), np.repeat(np.arange(len(sizes)), sizes)
        middle = sizes[:, None] / 2
    out = []
    for word in range(bits // 64):
        votes = bit_votes(flat if word == 0 else mixed(flat + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)), row, len(texts), WEIGHTS if distinct else BYTE_BITS)
        out.append(np.packbits(votes > middle, axis=1))
    return [bytes(x) for x in np.concatenate(out, axis=1)] if len(texts) else []


def fingerprints(docs: DataFrame, width: int = 3, bits: int = 64, distinct: bool = False, text_col: str = "text") -> DataFrame:
    """docs with ``fingerprint`` (binary, big-endian); null and wordless texts get zero. A column of that name is replaced."""
    docs = docs.drop("fingerprint")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                made = fingerprints_of(part.column(at).to_pylist(), width, bits, distinct)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def bit_table(column, bits: int) -> np.ndarray:
    """Fingerprints of an Arrow column, a row of bits each."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, bits // 8)
    return np.unpackbits(raw, axis=1)


def bit_counts(prints: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each 64-bit word how often two of its bits are set together, over all of them."""

    def run(batches):
        total, n = np.zeros((bits // 64, 64, 64), np.int64), 0
        for batch in batches:
            table = bit_table(batch.column(0), bits).astype(np.float32)
            n += len(table)
            for w in range(bits // 64):
                x = table[:, 64 * w : 64 * w + 64]
                total[w] += (x.T @ x).round().astype(np.int64)
        flat = np.append(total.reshape(-1), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["at", "n"])

    rows = prints.select("fingerprint").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(bits * 64 + 1, np.int64)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(bits // 64, 64, 64)


def correlated_parts(n: int, together: np.ndarray, per_word: int) -> list[np.ndarray]:
    """Cuts each 64-bit word into parts, each grown from a free bit by the bits most correlated with it."""
    parts = []
    for w, counts in enumerate(together):
        p = np.diag(counts) / max(n, 1)
        cov = counts / max(n, 1) - np.outer(p, p)
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        r = np.abs(cov / np.outer(sd, sd))
        free = list(range(64))
        sizes = [64 // per_word + (i < 64 % per_word) for i in range(per_word)]
        for size in sizes:
            part = [max(free, key=lambda b: (r[b, free].sum(), -b))]
            free.remove(part[0])
            while len(part) < size:
                part.append(max(free, key=lambda b: (r[b, part].sum(), -b)))
                free.remove(part[-1])
            parts.append(np.array(sorted(part)) + 64 * w)
    return parts


def costs(n: int, together: np.ndarray, part: np.ndarray, most: int, weight: float) -> list[float]:
    """Estimated work in one partition if it is not probed, or probed with threshold 0, 1, ... ``most``."""
    p = (np.concatenate([np.diag(c) for c in together]) / max(n, 1))[part]
    chance = np.array([1.0])  # of 0, 1, ... differing bits
    for q in 2 * p * (1 - p):
        chance = np.convolve(chance, [1 - q, q])
    ball = np.cumsum([1, *np.cumprod([(len(part) - i) / (i + 1) for i in range(most)])])
    return [0.0, *[n * ball[t] + weight * n * n / 2 * chance[: t + 1].sum() for t in range(most + 1)]]


def missed(size: int, apart: float, t: int) -> float:
    """Chance that more than t of ``size`` bits differ, each with chance ``apart``."""
    return max(1e-300, 1 - sum(math.comb(size, k) * apart**k * (1 - apart) ** (size - k) for k in range(t + 1)))


def thresholds(n: int, together: np.ndarray, parts: list[np.ndarray], radius: int, miss: float = 0.0) -> list[int]:
    """The t_i of the least estimated work, by dynamic programming, that meet the guarantee for ``radius``; none if none do."""
    most = min(3, radius)
    need = STEPS if miss else radius + 1
    apart = radius / (64 * len(together))
    best = {0: (0.0, [])}
    for part in parts:
        step: dict[int, tuple[float, list[int]]] = {}
        gains = [0, *[int(STEPS * math.log(missed(len(part), apart, t)) / math.log(miss)) if miss else t + 1 for t in range(most + 1)]]
        for (used, (value, chosen)), (t, extra) in itertools.product(best.items(), enumerate(costs(n, together, part, most, QUADRATIC))):
            at = used + gains[t]
            at = min(at, need) if miss else at
            if at <= need and value + extra < step.get(at, (np.inf,))[0]:
                step[at] = (value + extra, [*chosen, t - 1])
        best = step
    return best[need][1] if need in best else []


def allocation(n: int, together: np.ndarray, radius: int, per_word: int, miss: float) -> tuple[list[np.ndarray], list[int]]:
    """Partitions and thresholds of the least estimated work among cuts of each word into 2 to ``per_word`` partitions."""
    found = []
    for count in range(per_word, min(per_word, 2) - 1, -1):
        parts = correlated_parts(n, together, count)
        limits = thresholds(n, together, parts, radius, miss)
        if limits:
            work = sum(costs(n, together, p, max(t, 0), CANDIDATE)[t + 1] for p, t in zip(parts, limits))
            found.append((work, parts, limits))
    if not found:
        raise ValueError("no thresholds reach this radius: take more bits or a larger miss")
    return min(found, key=lambda f: f[0])[1:]


def probe_rows(prints: DataFrame, bits: int, parts: list[np.ndarray], limits: list[int]) -> DataFrame:
    """(key, id, fingerprint): a row for every value within t_i of each fingerprint's own, in each probed part i."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                table = bit_table(part.column(1), bits).astype(np.int64)
                for i, (at, t) in enumerate(zip(parts, limits)):
                    if t < 0:
                        continue
                    weights = 1 << np.arange(len(at))
                    value = table[:, at] @ weights
                    flips = [sum(c) for r in range(t + 1) for c in itertools.combinations(weights.tolist(), r)]
                    for flip in flips:
                        yield pa.RecordBatch.from_arrays([pa.array((i << 40) | (value ^ flip)), part.column(0), part.column(1)], names=["key", "id", "fingerprint"])

    return prints.select("id", "fingerprint").mapInArrow(run, "key long, id long, fingerprint binary")


def finer_parts(taken: np.ndarray, bits: int, radius: int, miss: float) -> list[np.ndarray]:
    """Cuts the bits that partitions leave open so that pairs within the radius agree in one of the pieces; none if there are too few bits."""
    free = np.setdiff1d(np.arange(bits), taken)
    if len(free) <= radius:
        return []
    count = radius + 1
    if miss:
        chance = lambda k: missed(-(-len(free) // k), radius / len(free), 0) ** k
        count = next((k for k in range(1, len(free)) if chance(k) <= miss), len(free))
    return [free[j::count] for j in range(count)]


def pieces_at(path: int, parts: list[np.ndarray], bits: int, radius: int, miss: float) -> tuple[list[np.ndarray], int]:
    """(the pieces of the bits that a path leaves open, the weight of its next digit). A path's digits, lowest first, are a partition and pieces from 1; each split takes half of the chance of a miss that is left."""
    path, digit = divmod(path, PATH)
    taken, miss, weight = parts[digit], miss / 2, PATH
    pieces = finer_parts(taken, bits, radius, miss)
    while path:
        path, digit = divmod(path, PATH)
        taken, miss, weight = np.union1d(taken, pieces[digit - 1]), miss / 2, weight * PATH
        pieces = finer_parts(taken, bits, radius, miss)
    return (pieces if weight < PATH**7 else []), weight


def split_hot(probes: DataFrame, bits: int, parts: list[np.ndarray], radius: int, miss: float, hot: int) -> DataFrame:
    """probes, with rows of a key that more than ``hot`` rows share under keys of that key and a further piece of their bits; those keys again while that pays."""

    def run(batches):
        known: dict[int, tuple[list[np.ndarray], int]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                key, n, path, ids, prints = (batch.slice(k, 2048).column(c) for c in range(5))
                keys, paths, table = key.to_numpy(), path.to_numpy(), bit_table(prints, bits)
                for p in np.unique(paths).tolist():
                    rows = np.flatnonzero(paths == p)
                    at = pa.array(rows)
                    known[p] = known.get(p) or pieces_at(p, parts, bits, radius, miss)
                    pieces, weight = known[p]
                    for j, piece in enumerate(pieces):
                        value = table[np.ix_(rows, piece)].astype(U64) @ (np.uint64(1) << np.arange(len(piece), dtype=U64))
                        fine = mixed(mixed(keys[rows].astype(U64) ^ mixed(np.array([j + 1], U64))) + value).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(fine), key.take(at), n.take(at), pa.array(np.full(len(rows), p + (j + 1) * weight)), ids.take(at), prints.take(at)], names=names)
                    if not pieces:
                        yield pa.RecordBatch.from_arrays([key.take(at), key.take(at), n.take(at), path.take(at), ids.take(at), prints.take(at)], names=names)

    schema = "key long, parent long, n long, path long, id long, fingerprint binary"
    names = [c.split()[0] for c in schema.split(", ")]
    rows, settled = probes.withColumn("path", F.shiftright("key", 40)), []
    keys = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot), "hot")
    while not keys.isEmpty():
        settled.append(rows.join(keys.select("key"), "key", "left_anti"))
        split = rows.drop("n").join(keys, "key").select("key", "n", "path", "id", "fingerprint")
        rows = written(split.mapInArrow(run, schema), "split")
        counts = rows.groupBy("parent", "n", "key").agg(F.count("*").cast("double").alias("m"))
        pays = counts.groupBy("parent", "n").agg(F.sum(F.col("m") * F.col("m")).alias("pairs")).filter(F.col("pairs") * 2 <= F.col("n").cast("double") * F.col("n"))
        again = counts.filter(F.col("m") > hot).join(pays.select("parent"), "parent", "left_semi")
        keys = written(again.groupBy("key").agg(F.sum("m").cast("long").alias("n")), "hot")
    out = [t.select("key", "id", "fingerprint") for t in (*settled, rows)]
    return functools.reduce(DataFrame.unionByName, out)


class Forest:
    """Union-find over the edges of one batch."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def joins(self, pairs):
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                yield a, b


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def links_of(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray, radius: int):
    """Edges between rows of equal key at most ``radius`` apart, in pieces; rows are sorted by key, groups are whole."""
    change = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(change, len(keys)))
    left = np.repeat(size, size) - (np.arange(len(keys)) - np.repeat(change, size)) - 1  # rows of the group that follow
    small = np.repeat(size <= SMALL, size)
    at = np.flatnonzero(small & (left > 0))
    step = 1
    while len(at):
        near = at[apart(prints[at], prints[at + step]) <= radius]
        yield zip(ids[near].tolist(), ids[near + step].tolist())
        step += 1
        at = at[left[at] >= step]
    for s, n in zip(change[size > SMALL].tolist(), size[size > SMALL].tolist()):  # breadth first: a row that is reached is not compared again
        free = np.arange(s, s + n)
        while len(free):
            queue, free = [free[0]], free[1:]
            while queue and len(free):
                here = queue.pop()
                near = apart(prints[free], prints[here]) <= radius
                got, free = free[near], free[~near]
                yield zip(itertools.repeat(int(ids[here])), ids[got].tolist())
                queue += got.tolist()


def nearest_links(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray, radius: int):
    """Edges as of links_of, the nearest first: all of a small group's, and of a large one a spanning forest of the nearest."""
    change = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(change, len(keys)))
    left = np.repeat(size, size) - (np.arange(len(keys)) - np.repeat(change, size)) - 1
    at, step, found = np.flatnonzero(np.repeat(size <= SMALL, size) & (left > 0)), 1, []
    while len(at):
        d = apart(prints[at], prints[at + step])
        near = d <= radius
        found.append((ids[at[near]], ids[at[near] + step], d[near]))
        step += 1
        at = at[left[at] >= step]
    for s, n in zip(change[size > SMALL].tolist(), size[size > SMALL].tolist()):
        group, mine = prints[s : s + n], ids[s : s + n]
        best, via, free, here = np.full(n, radius + 1), np.zeros(n, np.int64), np.ones(n, bool), 0
        for _ in range(n):
            free[here] = False
            d = apart(group, group[here])
            closer = d < best
            best[closer], via[closer] = d[closer], here
            open_ = np.flatnonzero(free)
            if not len(open_):
                break
            here = int(open_[np.argmin(best[open_])])
            if best[here] <= radius:
                found.append((mine[[via[here]]], mine[[here]], best[[here]]))
    if found:
        a, b, d = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(d, kind="stable")
        yield zip(a[order].tolist(), b[order].tolist())


def verified_links(probes: DataFrame, bits: int, radius: int, nearest: bool = False) -> DataFrame:
    """Forest edges (a, b) of fingerprints that meet and are at most ``radius`` apart, ``nearest`` ones if asked."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table):
            prints = np.frombuffer(b"".join(table["fingerprint"].to_pylist()), U64).reshape(-1, bits // 64)
            key, ids, forest = table["key"].to_numpy(), table["id"].to_numpy(), Forest()
            pairs = [e for piece in (nearest_links if nearest else links_of)(key, ids, prints, radius) for e in forest.joins(piece)]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 200_000:
                continue
            table = pa.Table.from_batches(held)
            keys = table["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key's rows may go on
            if cut:
                yield links(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), len(keys) - cut
        if held:
            yield links(pa.Table.from_batches(held))

    return probes.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def meetings(one: DataFrame, bits: int, radius: int, per_word: int, miss: float, hot: int) -> DataFrame:
    """Probes (key, id, fingerprint) of one(id, fingerprint): rows that share a key meet."""
    n, together = bit_counts(one, bits)
    parts, limits = allocation(n, together, radius, per_word, miss)
    return split_hot(probe_rows(one, bits, parts, limits), bits, parts, radius, miss, hot)


def groups(prints: DataFrame, bits: int = 64, radius: int = 3, per_word: int = 3, miss: float = 0.0, hot: int = HOT) -> DataFrame:
    """prints(id long, fingerprint binary) -> (fingerprint, component): the smallest id among the fingerprints reachable by links."""
    one = written(prints.groupBy("fingerprint").agg(F.min("id").alias("id")), "prints")
    links = components(verified_links(meetings(one, bits, radius, per_word, miss, hot), bits, radius))
    return one.join(links, one["id"] == links["node"], "left").select("fingerprint", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 64, radius: int = 3, per_word: int = 3, miss: float = 0.0, hot: int = HOT, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row per row of docs.

    Null and wordless texts have fingerprint zero and link like any other. Rows that share an id are
    separate rows. A null id is larger than any other; a component of null ids alone has a null id.
    """
    prints = fingerprints(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text")), width, bits, distinct).select("id", "fingerprint")
    prints = written(prints, "fingerprints")
    out = prints.join(groups(prints, bits, radius, per_word, miss, hot), "fingerprint")
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("id").alias(id_col), "fingerprint", back("component").alias("component_id"))


#: For similarity of word sets: 512 bits in 40 partitions or fewer; a pair at the radius is missed with a chance of 1 %.
SETS = dict(bits=512, per_word=5, miss=0.01)
WIDTH = 5
SLACK = 2.0  # standard deviations by which differing bits may exceed what the similarity stands for
BLOCK_TEXTS = 1000  # texts whose sets meet as many others in one task
EDGES_PER_PIECE = 2000  # edges of one text that meet its set of shingles in one task


def radius_of(similarity: float, bits: int = 512) -> int:
    """Bits by which two sets of this Jaccard similarity differ on average: the angle between them, as a share of 180 degrees."""
    return round(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set array<long>) of the texts of docs(__id, __key, __text) that are named in wanted(node, __id, __key)."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                x, row = set_hashes(part.column(1).to_pylist(), WIDTH)
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["node", "set"])

    rows = docs.join(wanted, ["__id", "__key"]).select("node", "__text").mapInArrow(run, "node long, set array<long>")
    return rows.groupBy("node").agg(F.first("set").alias("set"))  # rows alike are one


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ok): whether two texts' sets of shingles are similar enough. Edges of one text, whichever end it is, are dealt into pieces, so that none is hot."""
    both, copies = edges, {}
    for end, other, name in (("b", "a", "y"), ("a", "b", "x")):
        of = edges.groupBy(end).agg(F.ceil(F.count("*") / EDGES_PER_PIECE).alias("pieces"))
        both = both.join(of, end).withColumn(f"{end}_piece", F.pmod(F.xxhash64(other), F.col("pieces"))).drop("pieces")
        piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias(f"{end}_piece")
        copies[end] = sets.join(of, sets["node"] == of[end]).select(end, piece, F.col("set").alias(name))
    for end, sets_of_end in copies.items():
        both = both.join(sets_of_end, [end, f"{end}_piece"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (shared >= similarity * (F.size("x") + F.size("y") - shared)).alias("ok"))


def block_links(rows: DataFrame, bits: int, radius: int, similarity: float) -> DataFrame:
    """Forest edges (a, b) of rows(node, area, group, fingerprint, set) of one area and different groups that are similar enough.

    An area is dealt into blocks of BLOCK_TEXTS, and each pair of blocks is one task's group; only pairs that
    join groups leave it.
    """
    sizes = rows.groupBy("area").agg(F.ceil(F.count("*") / BLOCK_TEXTS).alias("blocks"))
    dealt = rows.join(sizes, "area").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("area", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "group", "fingerprint", "set")

    def compare(key, data):
        _, p, q = (k.as_py() for k in key)
        prints = np.frombuffer(b"".join(data["fingerprint"].to_pylist()), U64).reshape(-1, bits // 64)
        node, group, block = (data[c].to_numpy() for c in ("node", "group", "block"))
        flat = pa.concat_arrays(data["set"].chunks)
        start, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        sets = [np.sort(values[s:e]) for s, e in zip(start[:-1], start[1:])]
        forest, pairs = Forest(), []
        there = np.flatnonzero(block == q)
        for i in np.flatnonzero(block == p).tolist():
            near = there[(group[there] != group[i]) & (apart(prints[there], prints[i]) <= radius)]
            for j in near.tolist():
                if forest.root(int(group[i])) != forest.root(int(group[j])):
                    n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                        pairs += [(int(node[i]), int(node[j])) for _ in forest.joins([(int(group[i]), int(group[j]))])]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return dealt.groupBy("area", "p", "q").applyInArrow(compare, "a long, b long")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs without those whose group has an earlier text: one text of each group stays, with all its columns.

    Texts link if the sets of their five-word shingles have this Jaccard similarity, which is computed for
    every pair that meets and could join two groups; of pairs at the bound about 3 in 100 do not meet, of closer pairs fewer. Texts with
    equal fingerprints of all 512 bits are taken as one: that less similar texts have them has a chance below
    1e-30. Earlier is the smaller id, then the smaller digest of the text; a null id is larger than any. Rows
    alike in id and text stay or go together. Texts without words are not copies of each other and all stay.
    """
    bits, radius = SETS["bits"], radius_of(similarity)
    share = radius / bits
    wide = radius + math.ceil(SLACK * math.sqrt(bits * share * (1 - share)))
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    texts = docs.filter(F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(number.alias("__id"), key.alias("__key"), F.col(text_col).alias("__text"))
    prints = written(fingerprints(texts, WIDTH, bits, True, "__text").select("__id", "__key", "fingerprint"), "fingerprints")
    one = prints.groupBy("fingerprint").agg(F.min(F.struct("__id", "__key")).alias("first"))
    one = written(one.select(F.monotonically_increasing_id().alias("id"), "fingerprint", "first"), "prints")
    probes = meetings(one.select("id", "fingerprint"), bits, radius, SETS["per_word"], SETS["miss"], hot)
    edges = written(verified_links(probes, bits, wide, nearest=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(one, nodes["node"] == one["id"]).select("node", F.col("first.__id").alias("__id"), F.col("first.__key").alias("__key"))
    sets = written(shingle_sets(texts, wanted), "sets")
    checked = written(similar(edges, sets, similarity), "checked")
    joined = components(checked.filter("ok"))
    if not checked.filter("not ok").isEmpty():  # an edge of the forest that fails may hide pairs that do not
        areas = components(edges).withColumnRenamed("component", "area")  # without the smallest node of each, as components has it
        labelled = sets.select("node").join(areas, "node", "left").join(joined, "node", "left").select("node", F.coalesce("area", "node").alias("area"), F.coalesce("component", "node").alias("group"))
        several = labelled.groupBy("area").agg(F.min("group").alias("least"), F.max("group").alias("most")).filter("least < most").select("area")
        rows = labelled.join(several, "area").join(one.select(F.col("id").alias("node"), "fingerprint"), "node").join(sets, "node")
        found = written(block_links(rows, bits, wide, similarity), "links")
        joined = components(found.unionByName(checked.filter("ok").select("a", "b")))
    known = one.join(joined, one["id"] == joined["node"], "left").select("fingerprint", "first", F.coalesce("component", "id").alias("component"))
    kept = known.groupBy("component").agg(F.min("first").alias("kept"))
    found = prints.join(known.join(kept, "component").select("fingerprint", "kept"), "fingerprint")
    gone = found.filter(F.struct("__id", "__key") != F.col("kept")).select("__id", "__key").distinct()
    marked = docs.withColumns({"__id": number, "__key": key})
    return marked.join(gone, ["__id", "__key"], "left_anti").select(*docs.columns)
