"""Benchmark decontamination by latent semantic retrieval.

Passages are 64 words of a document, one every 32. Their TF-IDF vectors are taken over
the benchmark's content terms, weighted by frequencies counted over all passages of all
documents. A randomised SVD of the passages that share two such terms with an item is computed
where they lie (tasks send a range matrix and a small Gram matrix). Passages and benchmark
items meet by cosine in the latent space; each candidate is then checked by the longest
common subsequence of words and by the item's answer: the content terms, without which a passage
says something else in the same common words. Items longer than a passage are cut into windows, each
compared as an item of its own, and are repeated where the windows that match in one
document make up the required share of their words.

The benchmark is a stated query set. The driver holds MOST_BYTES of its text at a time, which bounds
all that is broadcast; a larger benchmark is taken in several parts. The texts are read twice for a
part, however many items it has: passages that share two content terms with an item are written for
that item's group of GROUP_ITEMS windows, and each group has its latent space over its own passages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, scratch, span_hashes, words_in, words_of, written

HALF = 32  # words between passages; a passage is two halves
MOST_BYTES = 16_000_000  # of benchmark text held at once
BLOCK_CHARS = 4_000_000  # of documents whose words are looked up at once
WINDOW = 2 * HALF  # words of an item compared at once
CONTENT_SHARE = 2e-4  # a term in no more of the half passages than this is a content term
LEAST_CONTENT = 8  # an item with fewer of them takes its rarest terms
GROUP_ITEMS = 400
EXTRA_RANK, OVERSAMPLE = 48, 16
COSINE = 0.35
LCS = 0.6  # of the item's words, with the answer; SURE without
SURE = 0.9
ANSWER_SHARE = 0.5
EDGES = b".,;:!?()[]{}\"'`*#%&$|-_/\\<>=+~^@"


def terms_of(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation at their edges."""
    return [t for w in words_of(text, lower=True) if (t := w.strip(EDGES))]


EDGE = bytes(int(c in EDGES) for c in range(256))


def stripped(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word without punctuation at its edges."""
    edge = np.frombuffer(w.raw.translate(EDGE), np.uint8)
    change = np.flatnonzero(np.diff(edge, prepend=0, append=0))
    first, last = change[::2], change[1::2]  # runs of punctuation
    start, end = w.start.copy(), w.end.copy()
    at = np.flatnonzero(edge[start])
    start[at] = np.minimum(last[np.searchsorted(first, start[at], "right") - 1], end[at])
    at = np.flatnonzero(edge[end - 1])
    end[at] = np.maximum(first[np.searchsorted(first, end[at] - 1, "right") - 1], start[at])
    return start, end


class Lookup:
    """Number of a term by its hash."""

    def __init__(self, terms: list[bytes]):
        keys = words_in(terms).hashes()
        self.number = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.number]
        self.met = np.zeros(1 << 20, bool)
        self.met[self.keys >> np.uint64(44)] = True

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words of documents that are terms without punctuation at their edges, and the numbers of these terms."""
        h = span_hashes(np.frombuffer(w.raw, np.uint8), *stripped(w))
        at = np.flatnonzero(self.met[h >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[place] == h[at]
        return at[same], self.number[place[same]].astype(np.int64)


def blocks(batch: pa.RecordBatch, column: int):
    """Slices of a batch with about BLOCK_CHARS of text."""
    size = np.cumsum([len(x or "") for x in batch.column(column).to_pylist()])
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + BLOCK_CHARS)))
        yield batch.slice(start, end - start)
        start = end


def halves_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of half passages in each text, and in the texts before it."""
    n = -(-w.sizes // HALF)
    return n, np.cumsum(n) - n


def windows_of(words: list[bytes]) -> list[list[bytes]]:
    """An item's words in as few parts of about the same size as have at most WINDOW words."""
    n = max(1, -(-len(words) // WINDOW))
    cut = [len(words) * k // n for k in range(n + 1)]
    return [words[s:e] for s, e in zip(cut[:-1], cut[1:])]


def half_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """Half passages in all documents, and in how many of them each term is."""
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(terms), len(terms)))

    def run(batches):
        lookup, v = shared.value
        df = np.zeros(v + 1, np.int64)
        for batch in batches:
            for part in blocks(batch, 0):
                w = words_in(part.column(0).to_pylist(), lower=True)
                at, term = lookup.find(w)
                n, before = halves_of(w)
                half = (np.repeat(before, w.sizes) + w.places() // HALF)[at]
                df[:v] += np.bincount(np.unique(half * v + term) % v, minlength=v)
                df[v] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(v + 1)), pa.array(df)], names=["term", "n"])

    df = np.zeros(len(terms) + 1, np.int64)
    for r in docs.select("__text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return int(df[-1]), df[:-1]


@dataclass
class Items:
    """One group of benchmark items and what passages are compared with."""

    ids: list
    words: list[list[bytes]]
    terms: list[bytes]  # content terms of the group
    idf: np.ndarray
    vectors: np.ndarray  # unit TF-IDF rows
    answers: list[set[bytes]]


def items_of(rows: list[tuple], rank: dict[bytes, int], n: int, df: np.ndarray) -> Items:
    idf_of = lambda t: float(np.log((n + 1) / (df[rank[t]] + 1)) + 1)
    content = []
    for _, words in rows:
        rare = sorted(set(words), key=lambda t: (-idf_of(t), t))
        good = [t for t in rare if df[rank[t]] <= CONTENT_SHARE * n]
        content.append(good if len(good) >= LEAST_CONTENT else rare[:LEAST_CONTENT])
    terms = sorted({t for c in content for t in c})
    at = {t: i for i, t in enumerate(terms)}
    idf = np.array([idf_of(t) for t in terms])
    vectors = np.zeros((len(rows), len(terms)))
    for i, ((_, words), c) in enumerate(zip(rows, content)):
        for t in words:
            if t in at:
                vectors[i, at[t]] += idf[at[t]]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    answers = [set(c) for c in content]
    return Items([i for i, _ in rows], [w for _, w in rows], terms, idf, vectors, answers)


PASSAGE = "group int, id long, doc long, place long, terms array<int>, counts array<int>, words binary"


def expanded(at: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start[a] to start[a] + sizes[a] for each a in ``at``, and which of ``at`` each is for."""
    n = sizes[at]
    whose = np.repeat(np.arange(len(at)), n)
    return np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum()), whose


def passages(docs: DataFrame, groups: list[Items]) -> DataFrame:
    """A row for each passage and group with an item of which the passage has two content terms, or the only one.

    terms are numbered as in the group; words reach half a passage further on both sides.
    """
    answers = [a for g in groups for a in g.answers]
    terms = sorted({t for a in answers for t in a})
    number = {t: i for i, t in enumerate(terms)}
    entries = np.array(sorted((number[t], i) for i, a in enumerate(answers) for t in a), np.int64).reshape(-1, 2)  # (term, item)
    sizes = np.bincount(entries[:, 0], minlength=len(terms))
    group_of = np.repeat(np.arange(len(groups)), [len(g.ids) for g in groups])
    alone = np.array([len(a) == 1 for a in answers], bool)
    of_group = [np.array([number[t] for t in g.terms], np.int64) for g in groups]  # rises, as the terms do
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(terms), len(terms), entries[:, 1], np.cumsum(sizes) - sizes, sizes, group_of, alone, of_group))
    schema = pa.schema([("group", pa.int32()), ("id", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("words", pa.binary())])

    def rows_of(part):
        lookup, v, item, start, sizes, group_of, alone, of_group = shared.value
        w = words_in(part.column(2).to_pylist(), lower=True)
        at, term = lookup.find(w)
        if not len(at):
            return
        n, before = halves_of(w)
        doc = np.repeat(np.arange(len(n)), w.sizes)[at]
        half = w.places()[at] // HALF
        first, second = np.minimum(half, np.maximum(n[doc] - 2, 0)), np.maximum(half - 1, 0)  # the passages that hold the half
        more = second != first
        passage = np.concatenate((first + before[doc], (second + before[doc])[more]))
        key, count = np.unique(passage * v + np.concatenate((term, term[more])), return_counts=True)
        passage, term = key // v, key % v
        where, whose = expanded(term, start, sizes)
        pair, met = np.unique(passage[whose] * len(alone) + item[where], return_counts=True)
        pair = pair[(met > 1) | alone[pair % len(alone)]]
        wanted = np.unique(pair // len(alone) * len(of_group) + group_of[pair % len(alone)])
        ids, docs_ = part.column(0).to_pylist(), part.column(1).to_pylist()
        ends = np.cumsum(w.sizes)
        for p, g in zip((wanted // len(of_group)).tolist(), (wanted % len(of_group)).tolist()):
            s, e = np.searchsorted(passage, [p, p + 1])
            local = np.minimum(np.searchsorted(of_group[g], term[s:e]), len(of_group[g]) - 1)
            here = of_group[g][local] == term[s:e]
            d = int(np.searchsorted(before, p, "right")) - 1
            k = p - int(before[d])
            low = int(ends[d] - w.sizes[d])
            a, b = low + max(0, (k - 1) * HALF), min(low + (k + 3) * HALF, int(ends[d])) - 1
            yield g, ids[d], docs_[d], k * HALF, local[here].tolist(), count[s:e][here].tolist(), w.raw[w.start[a] : w.end[b]]

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 2):
                out = list(rows_of(part))
                for k in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 2000]), schema)], schema=schema)

    return docs.select("__id", F.xxhash64("__text"), "__text").mapInArrow(run, PASSAGE)


class Rows:
    """Unit TF-IDF rows of a batch of passages, sparse."""

    def __init__(self, terms, counts, idf: np.ndarray):
        sizes = np.diff(terms.offsets.to_numpy())
        self.term = terms.flatten().to_numpy()
        weight = counts.flatten().to_numpy() * idf[self.term]
        self.start = np.cumsum(sizes) - sizes
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        norm = np.sqrt(np.add.reduceat(weight * weight, self.start))
        self.weight = weight / norm[self.row]

    def times(self, m: np.ndarray) -> np.ndarray:
        return np.add.reduceat(m[self.term] * self.weight[:, None], self.start, axis=0)

    def transposed_times(self, x: np.ndarray, v: int) -> np.ndarray:
        order = np.argsort(self.term, kind="stable")
        t = self.term[order]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        out = np.zeros((v, x.shape[1]))
        out[t[first]] = np.add.reduceat(x[self.row[order]] * self.weight[order][:, None], first, axis=0)
        return out


def summed_matrix(rows: DataFrame, shape: tuple[int, int], idf: np.ndarray, by: np.ndarray, gram: bool) -> np.ndarray:
    """Over all rows a: the sum of a^T (a by), or with gram of (a by)^T (a by). Tasks send blocks of lines, which are summed before the driver gets them."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, by))
    lines = 8  # a block of all tasks stays small however many tasks there are

    def run(batches):
        weights, m = shared.value
        total = np.zeros(shape)
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                a = Rows(part.column(0), part.column(1), weights)
                x = a.times(m)
                total += x.T @ x if gram else a.transposed_times(x, shape[0])
        for k in range(0, shape[0], lines):
            if total[k : k + lines].any():
                yield pa.RecordBatch.from_pydict({"at": [k], "block": [total[k : k + lines].tobytes()]})

    def add(data):
        blocks = [np.frombuffer(b, np.float64) for b in data["block"].to_pylist()]
        return pa.table({"at": [data["at"][0].as_py()], "block": [np.sum(blocks, axis=0).tobytes()]})

    out = np.zeros(shape)
    for r in rows.select("terms", "counts").mapInArrow(run, "at long, block binary").groupBy("at").applyInArrow(add, "at long, block binary").collect():
        block = np.frombuffer(bytes(r["block"])).reshape(-1, shape[1])
        out[r["at"] : r["at"] + len(block)] = block
    return out


def latent_basis(rows: DataFrame, items: Items) -> np.ndarray:
    """Right singular vectors of the passages and the items: the range of (A^T A) on random vectors, then the SVD inside it."""
    v = len(items.terms)
    width = min(v, len(items.ids) + EXTRA_RANK + OVERSAMPLE)
    random = np.random.default_rng(20_240_101).standard_normal((v, width))
    y = summed_matrix(rows, (v, width), items.idf, random, False)
    # the items are rows too, as heavy as the passages, so that an item that leaked once has its direction
    heavy = max(1.0, float(np.linalg.norm(y)) / max(1e-12, float(np.linalg.norm(items.vectors.T @ (items.vectors @ random)))))
    q, _ = np.linalg.qr(y + heavy * (items.vectors.T @ (items.vectors @ random)))
    inside = items.vectors @ q
    values, vectors = np.linalg.eigh(summed_matrix(rows, (q.shape[1], q.shape[1]), items.idf, q, True) + heavy * inside.T @ inside)
    keep = max(1, width - OVERSAMPLE) if width < v else width
    return q @ vectors[:, np.argsort(-values)[:keep]]


def common_subsequence(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of an item (its words' places as bit masks) and a passage."""
    full = (1 << size) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def verified(rows: DataFrame, items: Items, basis: np.ndarray, parts: frozenset[int] = frozenset()) -> DataFrame:
    """(id, doc, item, cosine, lcs, answer, answers, place) of passages that repeat an item; lcs in words, answer in content terms out of ``answers``. Items in ``parts`` are windows, whose answer is not checked here."""
    latent = items.vectors @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    masks = []
    for words in items.words:
        m: dict[bytes, int] = {}
        for i, w in enumerate(words):
            m[w] = m.get(w, 0) | 1 << i
        masks.append(m)
    shared = rows.sparkSession.sparkContext.broadcast((items.idf, basis, latent, masks, [len(w) for w in items.words], items.answers))

    def run(batches):
        idf, basis, latent, masks, sizes, answers = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                cosine = Rows(part.column(3), part.column(4), idf).times(basis) @ latent.T
                ids, docs, places, words = *(part.column(c).to_pylist() for c in (0, 1, 2)), part.column(5)
                cut: dict[int, list[bytes]] = {}
                out = []
                for r, i in zip(*(x.tolist() for x in np.nonzero(cosine >= COSINE))):
                    if r not in cut:
                        cut[r] = [t for w in words[r].as_py().split() if (t := w.strip(EDGES))]
                    lcs = common_subsequence(masks[i], sizes[i], cut[r])
                    if lcs / sizes[i] < LCS:
                        continue
                    answer = len(answers[i].intersection(cut[r]))
                    if i in parts or lcs / sizes[i] >= SURE or answer / len(answers[i]) >= ANSWER_SHARE:
                        out.append((ids[r], docs[r], i, float(cosine[r, i]), lcs, answer, len(answers[i]), places[r]))
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], f.type) for j, f in enumerate(schema)], schema=schema)

    long = pa.int64()
    schema = pa.schema([("id", long), ("doc", long), ("item", pa.int32()), ("cosine", pa.float64()), ("lcs", long), ("answer", long), ("answers", long), ("place", long)])
    return rows.select("id", "doc", "place", "terms", "counts", "words").mapInArrow(run, "id long, doc long, item int, cosine double, lcs long, answer long, answers long, place long")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, cosine, lcs, answer, place): one row for each document and item that it repeats, at its best passage.

    lcs is the share of the item's words in the longest common subsequence, answer the share of its
    content terms that are there, place the passage's first word. An item of more than WINDOW words is
    reported if its windows with LCS of their words in the document make up LCS of the item, and SURE of these
    windows' words or ANSWER_SHARE of their content terms are there; lcs then sums over these windows, answer and
    cosine are of them, and place is of the first. Null and empty texts and items match
    nothing. Rows that share an id are reported together; a null id is reported as null. An empty
    benchmark or table gives no rows.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias(item_col), F.col(item_text).alias("__item"))
    total = items.agg(F.sum(F.octet_length("__item") + 64)).first()[0] or 0
    parts = max(1, -(-total // MOST_BYTES))
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    out = docs.sparkSession.createDataFrame([], f"{id_col} long, {item_col} long, cosine double, lcs double, answer double, place long")
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64(item_col, "__item"), F.lit(parts)) == k) if parts > 1 else items
        rows = sorted(((r[0], terms_of(r[1])) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        rows = [(i, w) for i, w in rows if w]
        if rows:
            found = leaks_of_part(base, rows, item_col).withColumnRenamed("id", id_col)
            out = out.unionByName(written(found, "leaks") if parts > 1 else found)
    if parts > 1:  # an item that the benchmark repeats may be in several parts
        out = out.groupBy(id_col, item_col).agg(F.max(F.struct("lcs", "answer", "cosine", "place")).alias("b")).select(id_col, item_col, "b.cosine", "b.lcs", "b.answer", "b.place")
    return out


def leaks_of_part(base: DataFrame, rows: list[tuple], item_col: str) -> DataFrame:
    """leaks of items (id, terms) that the driver holds, for documents (__id, __text)."""
    spark = base.sparkSession
    vocabulary = sorted({t for _, w in rows for t in w})
    n, df = half_frequencies(base, vocabulary)
    rank = {t: i for i, t in enumerate(vocabulary)}
    cut = [(nr, w) for nr, (_, words) in enumerate(rows) for w in windows_of(words)]
    groups = [items_of(cut[k : k + GROUP_ITEMS], rank, n, df) for k in range(0, len(cut), GROUP_ITEMS)]
    path = scratch(spark, "passages")
    found = passages(base, groups)
    (found.write.partitionBy("group") if len(groups) > 1 else found.write).parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    hits = None
    for g, items in enumerate(groups):
        names = [(i, nr, rows[nr][0], len(w), len(rows[nr][1])) for i, (nr, w) in enumerate(zip(items.ids, items.words))]
        sizes = spark.createDataFrame(names, f"item int, nr long, {item_col} long, window_words long, words long")
        whole = frozenset(i for i, _, _, size, words in names if size < words)
        mine = found.filter(F.col("group") == g)
        best = verified(mine, items, latent_basis(mine, items), whole).groupBy("id", "doc", "item").agg(F.max(F.struct("lcs", "answer", "cosine", (-F.col("place")).alias("place"), "answers")).alias("b"))
        best = best.join(F.broadcast(sizes), "item")  # at most GROUP_ITEMS rows
        best = written(best, "hits") if len(groups) > 1 else best
        hits = best if hits is None else hits.unionByName(best)
    whole = hits.groupBy("id", "doc", "nr", item_col, "words").agg(
        F.sum("window_words").alias("matched"),
        (F.sum("b.lcs") / F.col("words")).alias("lcs"),
        (F.sum("b.answer") / F.sum("b.answers")).alias("answer"),
        F.avg("b.cosine").alias("cosine"),
        F.max("b.place").alias("place"),
    )
    sure = (F.col("lcs") * F.col("words") >= SURE * F.col("matched")) | (F.col("answer") >= ANSWER_SHARE) | (F.col("matched") == F.col("words")) & (F.col("words") <= WINDOW)
    whole = whole.filter((F.col("matched") >= LCS * F.col("words")) & sure).groupBy("id", "nr", item_col).agg(F.max(F.struct("lcs", "answer", "cosine", "place")).alias("b"))
    best = whole.groupBy("id", item_col).agg(F.max("b").alias("b"))
    return best.select("id", item_col, "b.cosine", "b.lcs", "b.answer", (-F.col("b.place")).alias("place"))
