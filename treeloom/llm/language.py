"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed greedily into the
longest phrases that occur in that text. z phrases against a reference of n letters stand for
z log2(n) bits, so phrases are weighted by log2(n), and the language that needs least wins,
however much labelled text it has. The alphabet is that of the labelled texts, of any size:
automata are double arrays (a state's base plus a symbol is a slot, which says whose it is), so
a task parses thousands of segments of texts in step, one letter of each at a time; segments
are ``SEGMENT`` letters and cover every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


SEGMENT = 1024
#: Bounds of the fit for each language: labelled rows, and letters of each, from a place in the text that its hash decides.
ROWS_PER_LANGUAGE = 64
LETTERS_PER_ROW = 256
FREE_PHRASES = 2  # that likeness does not count, so that short texts are not judged
CODE_POINTS = 0x110000
UNKNOWN = "und"


@dataclass
class Automaton:
    """State s goes by symbol c to to[base[s] + c] if owner[base[s] + c] is s. State 1 is the start."""

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # of each code point; 0: white space and all else that is no letter, 1: a letter that no reference has
    automata: list[Automaton]
    bits: np.ndarray | float = 1.0  # of a phrase of each language
    usual: np.ndarray | None = None  # letters of a phrase in texts of the language itself


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point of each code point, and whether it is a letter."""
    low, is_letter = np.arange(CODE_POINTS), np.zeros(CODE_POINTS, bool)
    for c in range(CODE_POINTS):
        x = chr(c)
        if x.isalpha():
            is_letter[c] = True
            low[c] = ord(x.lower()[0])
    return low, is_letter


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeezed(symbols: np.ndarray) -> np.ndarray:
    """Runs of symbol 0 become one."""
    return symbols[np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0)))] if len(symbols) else symbols


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 1 is the start, 0 is unused."""
    go: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in symbols:
        new = len(go)
        go.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


def double_array(go: list[dict[int, int]], symbols: int) -> Automaton:
    """Packs transitions: the states with most of them first, each at the first place where all its slots are free."""
    total = sum(map(len, go))
    free = np.ones(2 * total + 4 * symbols + 64, bool)
    base = np.zeros(len(go), np.int32)
    owner, to = np.zeros(len(free), np.int32), np.zeros(len(free), np.int32)
    low = 0  # no free slot is before it
    for s in sorted(range(1, len(go)), key=lambda s: (-len(go[s]), s)):
        if not go[s]:
            break
        c = np.array(sorted(go[s]))
        while not free[low]:
            low += 1
        at, step = low, 64
        while True:
            if at + step + symbols >= len(free):
                more = len(free)
                free, owner, to = np.append(free, np.ones(more, bool)), np.append(owner, np.zeros(more, np.int32)), np.append(to, np.zeros(more, np.int32))
            bases = np.flatnonzero(free[at : at + step]) + at - c[0]
            bases = bases[bases >= 0]
            fits = bases[free[bases[:, None] + c].all(axis=1)] if len(c) > 1 else bases
            if len(fits):
                break
            at, step = at + step, min(2 * step, 8192)
        base[s] = b = int(fits[0])
        free[b + c], owner[b + c], to[b + c] = False, s, [go[s][x] for x in c.tolist()]
    size = int(base.max()) + symbols + 1
    return Automaton(base, owner[:size].copy(), to[:size].copy())


def automaton(symbols: list[int], n_symbols: int | None = None) -> Automaton:
    """The suffix automaton of symbols below ``n_symbols`` (None: up to one more than the largest)."""
    return double_array(suffix_automaton(symbols), n_symbols or max(symbols, default=0) + 2)


def in_rows(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts as rows of a table by falling size, their sizes, and which part each row is."""
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    table = np.zeros((len(parts), int(sizes.max())), np.int32)
    for row, k in enumerate(order):
        table[row, : sizes[k]] = parts[k]
    return table, sizes[order], order


def phrases(automata: list[Automaton], segments: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases each language needs for each segment; rows are sorted by falling size."""
    out = np.zeros((len(automata), len(sizes)), np.int32)
    live = np.searchsorted(-sizes, -np.arange(segments.shape[1]), "left")  # rows longer than k
    columns = np.ascontiguousarray(segments.T)
    for count, a in zip(out, automata):
        state = np.ones(len(sizes), np.int32)
        for k in range(segments.shape[1]):
            n = live[k]
            if not n:
                break
            c = columns[k, :n]
            slot = a.base[state[:n]] + c
            to = a.to[slot]
            fail = np.flatnonzero(a.owner[slot] != state[:n])
            if len(fail):
                again = a.base[1] + c[fail]
                lacking = a.owner[again] != 1  # a letter that the language lacks is a phrase of its own
                count[fail] += (state[fail] != 1).astype(np.int32) + lacking
                to[fail] = np.where(lacking, 1, a.to[again])
            state[:n] = to
        count += state != 1  # state 1: no phrase is open
    return out


def learnt(pieces: list[np.ndarray], n_symbols: int) -> tuple[Automaton, float, float]:
    """The automaton of a language's pieces, the bits of a phrase, and the letters of a phrase in every fourth piece parsed with the rest.

    Equal pieces count once and the middle piece decides, so that copies among the labelled rows do not.
    """
    joined = lambda ps: squeezed(np.concatenate(ps)).tolist() if ps else []
    distinct = [np.frombuffer(b, pieces[0].dtype) for b in dict.fromkeys(p.tobytes() for p in pieces)]
    probes, others = [p for p in distinct[::4] if len(p)], [p for k, p in enumerate(distinct) if k % 4]
    usual = 1.0
    if probes and others:
        table, sizes, _ = in_rows(probes)
        usual = float(np.median(sizes / np.maximum(1, phrases([automaton(joined(others), n_symbols)], table, sizes)[0])))
    whole = joined(pieces)
    return automaton(whole, n_symbols), float(np.log2(len(whole) + 2)), usual


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learns from at most ROWS_PER_LANGUAGE rows of each label, those with the smallest id hashes, and LETTERS_PER_ROW letters of each.

    Every label is learnt. Rows without label or text are left out; no labelled row gives a model without
    languages. Repeated rows are taken as they come. Automata are built by tasks, one language each.
    """
    spark = labelled.sparkSession
    text, most = F.coalesce(F.col(text_col), F.lit("")), 4 * LETTERS_PER_ROW
    start = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - most, F.lit(0)) + 1) + 1
    rows = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.substr(text, start.cast("int"), F.lit(most)).alias("text"), text.rlike(r"\p{L}").alias("has"))
    rows = rows.filter("lang is not null and has").drop("has")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    taken = rows.withColumn("k", order).filter(F.col("k") <= ROWS_PER_LANGUAGE).select("lang", "k", "text").collect()
    if not taken:
        return Model([], np.zeros(CODE_POINTS, np.int32), [])
    low, is_letter = letters()
    pieces: dict[str, list[np.ndarray]] = {}
    for r in sorted(taken, key=lambda r: (r["lang"], r["k"])):
        c = low[code_points(r["text"])]
        pieces.setdefault(r["lang"], []).append(np.append(squeezed(np.where(is_letter[c], c, 0))[:LETTERS_PER_ROW], 0))
    known = np.unique(np.concatenate([p for ps in pieces.values() for p in ps]))
    known = known[known > 0]
    of_low = np.where(is_letter, 1, 0).astype(np.int32)
    of_low[known] = np.arange(2, 2 + len(known))
    n_symbols = len(known) + 2
    symbol = np.where(is_letter, of_low[low], 0).astype(np.int32)
    sent = [(l, [of_low[p].astype("<i4").tobytes() for p in ps]) for l, ps in pieces.items()]

    def build(batches):
        for batch in batches:
            for lang, parts in zip(*(c.to_pylist() for c in batch.columns)):
                a, bits, usual = learnt([np.frombuffer(p, "<i4") for p in parts], n_symbols)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "base": [a.base.tobytes()], "owner": [a.owner.tobytes()], "to": [a.to.tobytes()], "bits": [bits], "usual": [usual]})

    made = spark.createDataFrame(sent, "lang string, pieces array<binary>").repartition(min(len(sent), 200), "lang").mapInArrow(build, "lang string, base binary, owner binary, to binary, bits double, usual double").collect()
    made.sort(key=lambda r: r["lang"])
    array = lambda x: np.frombuffer(bytes(x), np.int32)
    automata = [Automaton(array(r["base"]), array(r["owner"]), array(r["to"])) for r in made]
    return Model([r["lang"] for r in made], symbol, automata, np.array([r["bits"] for r in made]), np.array([r["usual"] for r in made]))


def scored(model: Model, texts: list) -> tuple[list[str], list[float], list[float], list[float]]:
    """Language, score, letters per phrase and likeness of each text."""
    parts, owner, letters_in = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if not t:
            continue
        s = model.symbol[code_points(t)]
        letters_in[i] = np.count_nonzero(s)
        if letters_in[i]:
            s = squeezed(s)
            for k in range(0, len(s), SEGMENT):
                parts.append(s[k : k + SEGMENT])
                owner.append(i)
    langs, scores, lengths, likeness = [UNKNOWN] * len(texts), *([0.0] * len(texts) for _ in range(3))
    if not parts or not model.languages:
        return langs, scores, lengths, likeness
    table, sizes, order = in_rows(parts)
    need = np.zeros((len(texts), len(model.languages)), np.int64)
    np.add.at(need, np.array(owner)[order], phrases(model.automata, table, sizes).T)
    symbols = np.bincount(np.array(owner)[order], sizes, len(texts))
    cost = need * model.bits
    for i in np.flatnonzero(letters_in):
        best = int(np.argmin(cost[i]))
        rest = np.delete(cost[i], best)
        langs[i], lengths[i] = model.languages[best], float(symbols[i] / need[i][best])
        scores[i] = float(rest.min() / (rest.min() + cost[i][best])) if len(rest) else 1.0
        counted = int(need[i][best]) - FREE_PHRASES
        known = counted > 0 and model.usual is not None and model.usual[best] > 1
        likeness[i] = float(np.clip((symbols[i] / counted - 1) / (model.usual[best] - 1), 0, 1)) if known else 1.0
    return langs, scores, lengths, likeness


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score``, ``phrase_letters`` (mean letters to a phrase of the winner) and ``likeness`` (how much more than one these are, as a share of what is usual in the language: 0 to 1).

    ``und`` with score and likeness 0 where the text is null or has no letter, or where nothing was learned. score
    is second / (first + second) of the least normalised phrases, 0.5 for a tie, which the first label in order
    wins. Columns of docs with these names are replaced. Repeated rows get the same values.
    """
    made = {"lang_pred": T.StringType(), "score": T.DoubleType(), "phrase_letters": T.DoubleType(), "likeness": T.DoubleType()}
    docs = docs.drop(*made)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in made.items()]])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            start = 0
            sizes = [len(x or "") for x in batch.column(at).to_pylist()]
            while start < batch.num_rows:  # about four million letters at a time
                end, total = start + 1, sizes[start]
                while end < batch.num_rows and total + sizes[end] <= 4_000_000:
                    total += sizes[end]
                    end += 1
                part = batch.slice(start, end - start)
                result = scored(shared.value, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(result[0], pa.string()), pa.array(result[1], pa.float64()), pa.array(result[2], pa.float64()), pa.array(result[3], pa.float64())], names=[*part.schema.names, *made])
                start = end

    return docs.mapInArrow(run, schema)


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % k
