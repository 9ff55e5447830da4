"""Personal data: fixed patterns, and further spans from a linear-chain conditional random field.

Patterns find emails, IP addresses, card numbers that pass Luhn, and international phone numbers. The field
labels tokens by their shapes and adds spans of the same four kinds that the patterns do not take: numbers in
local or grouped forms, cards with a wrong check digit, addresses written out. An added span must hold what its
kind needs (``plausible``), must not touch another letter or digit, and must not overlap a span of the patterns,
which stay.

The field is trained on the driver from ``labelled_table``, a few hundred sentences made by rule, or from the
caller's rows of the same form, at most ``MOST_LABELLED``. Texts are decoded whole, in numpy batches of about
``PIECE`` code points; a longer text is read in pieces that overlap by ``OVERLAP`` to each side, and a span
counts in the piece in which it starts. A span needs a digit, an @, an opening bracket or the word "dot", so tokens farther than
``NEAR`` tokens from all of these are outside and the chain is cut there; a stretch between cuts of more than
``STRETCH`` tokens is decoded in parts that overlap by NEAR tokens.

Input: (doc_id, text). A null text is an empty one; repeated rows are texts of their own; a null doc_id stays.
Spans are code points, end exclusive, ordered by start, then kind. Further columns are left out. An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf

KINDS = ["email", "ip", "card", "phone"]
PIECE, OVERLAP = 500_000, 2_000
NEAR, STRETCH = 16, 256
MOST_LABELLED = 2_000
SENTENCES, SEED = 300, 12
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, added array<string>, spans array<string>"

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An address, also with spaces at its @ or with the marks written out.
WRITTEN = re.compile(r"[\w.%+-]+(?: ?@ ?| at | ?[(\[]at[)\]] ?)[\w-]+(?:(?:\.| dot | ?[(\[]dot[)\]] ?)[\w-]+)+")
NO_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it and the domain behind it; found from the @, so that no run is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = at + 1  # no match can hold this @, and none can start before it
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    turned = [int(d) for d in reversed(digits)]
    return (sum(turned[::2]) + sum(d * 2 - 9 * (d > 4) for d in turned[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# Words that are shapes of their own.
CUES = [
    ["at"], ["dot"], ["com", "org", "net", "edu", "info"], ["mail", "email", "contact", "write"], ["phone", "tel", "call", "fax", "mobile", "dial"],
    ["card", "visa", "credit", "pay"], ["ip", "host", "server", "ping"], ["version", "token", "isbn", "order", "page", "license", "item", "section"],
]
MARKS = '@.-+()_%:/"=,[]\n'
SPACE, LETTER, DIGIT, MARK = range(4)
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CLASSES = np.full(0x3001, LETTER, np.int8)
CLASSES[:128] = [SPACE if c == 32 or 9 <= c <= 13 and c != 10 else DIGIT if 48 <= c < 58 else LETTER if chr(c).isalpha() else MARK for c in range(128)]
CLASSES[0x2010:0x2060] = MARK
CLASSES[WIDE_SPACES] = SPACE
MARK_SHAPE = np.full(128, len(MARKS), np.int16)
MARK_SHAPE[[ord(c) for c in MARKS]] = range(len(MARKS))
FIRST_CUE = len(MARKS) + 1
FIRST_WORD = FIRST_CUE + len(CUES)  # lower case, capital, capitals, mixed
FIRST_NUMBER = FIRST_WORD + 4  # by length, and whether at most 255
SIGNS = [MARKS.index("@"), MARKS.index("("), MARKS.index("["), FIRST_CUE + 1]
LENGTHS = np.minimum(np.searchsorted([1, 2, 3, 4, 5, 6, 9, 12, 16, 17, 20], np.arange(64), "right") - 1, 10)
SHAPES = 2 * (FIRST_NUMBER + 12)
BEYOND = SHAPES  # what is outside of a text
GAP = "\n" * (crf.REACH + 1)
CUE_KEYS, CUE_SHAPES = (np.array(v) for v in zip(*sorted((int.from_bytes(w.encode(), "little"), FIRST_CUE + i) for i, ws in enumerate(CUES) for w in ws)))


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shape) of the runs of letters, runs of digits and single marks of a text; a shape also tells whether space comes before."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = CLASSES[np.minimum(cp, len(CLASSES) - 1)]
    cut = np.ones(len(cp) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == MARK)
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    real = kind[start] != SPACE
    apart = np.concatenate(([True], ~real[:-1]))[real] if len(real) else real
    start, end = start[real], end[real]
    size, kind, first = end - start, kind[start], cp[start]
    shape = np.zeros(len(start), np.int16)
    marks = kind == MARK
    shape[marks] = MARK_SHAPE[np.minimum(first[marks], 127)]
    words = np.flatnonzero(kind == LETTER)
    upper = np.concatenate(([0], np.cumsum(((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE)), dtype=np.int32)))
    ups = upper[end[words]] - upper[start[words]]
    leads = upper[start[words] + 1] - upper[start[words]]
    shape[words] = FIRST_WORD + np.select([ups == 0, (ups == 1) & (leads == 1), ups == size[words]], [0, 1, 2], 3)
    short = words[size[words] <= 8]
    key, plain = np.zeros(len(short), np.int64), np.ones(len(short), bool)
    for i in range(8):
        c = cp[np.minimum(start[short] + i, len(cp) - 1)].astype(np.int64)
        inside = size[short] > i
        plain &= ~inside | (c < 128)
        key += np.where(inside, (c | 32) & 127, 0) << (8 * i)
    place = np.minimum(np.searchsorted(CUE_KEYS, key), len(CUE_KEYS) - 1)
    cue = plain & (CUE_KEYS[place] == key)
    shape[short[cue]] = CUE_SHAPES[place[cue]]
    numbers = np.flatnonzero(kind == DIGIT)
    shape[numbers] = FIRST_NUMBER + LENGTHS[np.minimum(size[numbers], 63)]
    three = numbers[size[numbers] == 3]
    value = sum((cp[start[three] + i].astype(int) - 48) * 10 ** (2 - i) for i in range(3))
    shape[three[value > 255]] = FIRST_NUMBER + 11
    return start, end, 2 * shape + apart


def labels_of(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside; 1 + 2 * kind where a span begins, 2 + 2 * kind inside it."""
    out = np.zeros(len(start), int)
    for s, kind, e in spans:
        inside = np.flatnonzero((start >= s) & (end <= e))
        out[inside] = 2 + 2 * kind
        out[inside[:1]] -= 1
    return out


def stretches(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, own from, own to) of the parts that are decoded: tokens near a digit or one of SIGNS, in one text. BEYOND parts texts."""
    kind = shape >> 1
    signs = np.flatnonzero((shape != BEYOND) & ((kind >= FIRST_NUMBER) | np.isin(kind, SIGNS)))
    if not len(signs):
        return (np.zeros(0, int),) * 4
    walls = np.concatenate(([-1], np.flatnonzero(shape == BEYOND), [len(shape)]))
    right = np.searchsorted(walls, signs)  # the wall behind each sign
    new = np.concatenate(([True], (np.diff(signs) > 2 * NEAR) | (np.diff(right) > 0)))
    final = np.append(np.flatnonzero(new)[1:] - 1, len(signs) - 1)
    lo = np.maximum(signs[new] - NEAR, walls[right[new] - 1] + 1)
    hi = np.minimum(signs[final] + NEAR + 1, walls[right[final]])
    parts = -(-(hi - lo) // STRETCH)
    first = np.cumsum(parts) - parts
    own = np.repeat(lo, parts) + STRETCH * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    stop = np.minimum(own + STRETCH, np.repeat(hi, parts))
    return np.maximum(own - NEAR, np.repeat(lo, parts)), np.minimum(stop + NEAR, np.repeat(hi, parts)), own, stop


def labelled_tokens(model: crf.Model, shape: np.ndarray) -> np.ndarray:
    """A label for every token."""
    lo, hi, own, stop = stretches(shape)
    found = model.decode(shape, lo, hi)
    at = np.arange(len(found)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
    mine = (at >= np.repeat(own, hi - lo)) & (at < np.repeat(stop, hi - lo))
    labels = np.zeros(len(shape), np.int8)
    labels[at[mine]] = found[mine]
    return labels


def plausible(kind: int, found: str) -> bool:
    """What every span of a kind must hold."""
    digits = NO_DIGIT.sub("", found)
    if kind == 0:
        return WRITTEN.fullmatch(found) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9 .-]+", found) is not None
    return 7 <= len(digits) <= 15 and re.fullmatch(r"\+?[0-9 ()./-]+", found) is not None


def field_spans(model: crf.Model, text: str, begins: list[int] | None = None, ends: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the field's plausible spans in one text, or in texts begins..ends that are joined by GAP."""
    start, end, shape = tokens(text)
    if begins:
        first = np.searchsorted(start, begins)
        shape[first[first < len(shape)]] |= 1
        shape[start >= np.asarray(ends)[np.searchsorted(begins, start, "right") - 1]] = BEYOND
    labels = labelled_tokens(model, shape)
    marked = np.flatnonzero(labels)
    out, open_ = [], None
    for i in marked:
        kind, begins = (int(labels[i]) - 1) // 2, labels[i] % 2
        if open_ and not begins and open_[1] == kind and open_[3] == i - 1:
            open_[2], open_[3] = int(end[i]), i
            continue
        if open_:
            out.append(open_)
        open_ = [int(start[i]), kind, int(end[i]), i]
    if open_:
        out.append(open_)
    return [(s, k, e) for s, k, e, _ in out if plausible(k, text[s:e]) and not text[max(0, s - 1) : s].isalnum() and not text[e : e + 1].isalnum()]


def pieces(texts: list[str], piece: int = PIECE, overlap: int = OVERLAP) -> Iterator[tuple[str, list[tuple[int, int, int, int]]]]:
    """Texts joined up to about ``piece`` code points, or parts of one that is longer: (joined, [(text, where it begins in joined, offset in the text, its own end)]). Parts keep ``overlap`` to each side."""
    held, parts, n = [], [], 0
    for i, t in enumerate(texts):
        if len(t) > piece:
            for lo in range(0, len(t), piece):
                a = max(0, lo - overlap)
                yield t[a : lo + piece + overlap], [(i, 0, a, lo, lo + piece)]
            continue
        if n + len(t) > piece and held:
            yield GAP.join(held), parts
            held, parts, n = [], [], 0
        parts.append((i, n, 0, 0, len(t) + 1))
        held.append(t)
        n += len(t) + len(GAP)
    if held:
        yield GAP.join(held), parts


def added_spans(model: crf.Model, texts: list[str], base: list[list[tuple[int, int, int]]], piece: int = PIECE, overlap: int = OVERLAP) -> list[list[tuple[int, int, int]]]:
    """For each text the field's spans that overlap no base span."""
    out = [[] for _ in texts]
    for joined, parts in pieces(texts, piece, overlap):
        begins = [p[1] for p in parts]
        for s, kind, e in field_spans(model, joined, begins, [*(b - len(GAP) for b in begins[1:]), len(joined)]):
            i, at, offset, own, stop = parts[int(np.searchsorted(begins, s, "right")) - 1]
            s, e = s - at + offset, e - at + offset
            if own <= s < stop and e <= len(texts[i]):
                out[i].append((s, kind, e))
    for i, spans in enumerate(out):
        if spans and base[i]:
            starts, ends = np.array([b[0] for b in base[i]]), np.maximum.accumulate([b[2] for b in base[i]])
            # base spans that start before e; the farthest end among them tells whether one reaches past s
            out[i] = [(s, k, e) for s, k, e in spans if (n := int(np.searchsorted(starts, e))) == 0 or ends[n - 1] <= s]
    return out


def labelled_table(sentences: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, [(start, kind, end)]): sentences of made-up words with personal data of each kind, and with numbers and marks that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letters = "abcdefghijklmnopqrstuvwxyzéèçñóíäöüß"
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(2, 11)))
    plain = lambda: "".join(rng.choices(letters[:26], k=rng.randrange(2, 9)))
    top = lambda: rng.choice(["com", "org", "net", "de", "fr", "es", "edu", "io"])
    part = lambda: str(rng.randrange(256))
    user = lambda: rng.choice([plain(), f"{plain()}.{digits(2)}", f"{plain()}.{plain()}", f"{plain()}_{plain()}{digits(1)}"])
    host = lambda: rng.choice([f"{plain()}.{top()}", f"mail{digits(1)}.example.{top()}", f"{plain()}-{plain()}.{top()}"])
    grouped = lambda sep, sizes: sep.join(digits(n) for n in sizes)
    made = [
        lambda: rng.choice([f"{user()}@{host()}", f"{user()}@{host()}", f"{plain()} at {plain()} dot {top()}", f"{plain()} (at) {plain()} (dot) {top()}", f"{plain()} [at] {host()}", f"{user()} @ {host()}"]),
        lambda: rng.choice([".", ".", ".", " . "]).join(part() for _ in range(4)),
        lambda: rng.choice([digits(16), digits(16), digits(rng.randrange(13, 20)), grouped(rng.choice(" -"), [4] * 4), grouped(rng.choice(" -"), [4, 6, 5])]),
        lambda: rng.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}", grouped(rng.choice("-. "), [3, 3, 4]), f"0{digits(3)} {digits(7)}", f"0{digits(2)}/{digits(7)}"]),
    ]
    none = [
        lambda: f"version {digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{rng.randrange(1900, 2100)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}",
        lambda: digits(rng.randrange(1, 9)), lambda: f"{digits(1)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f'token = "{"".join(rng.choices("0123456789abcdef", k=12))}"',
        lambda: f"isbn 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"order {digits(8)}", lambda: f"@{plain()}", lambda: f"section {digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(3)}-{digits(3)}", lambda: f"{plain()}.{top()}", lambda: f"{digits(3)} + {digits(2)} = {digits(3)}",
    ]
    cues = [CUES[3], CUES[6], CUES[5], CUES[4]]
    rows = []
    for i in range(sentences):
        text, spans = "", []
        noise = rng.choice(["", "", "", "", "!!", "%%%", "###", "***", ","])
        shout = rng.random() < 0.1
        for _ in range(rng.randrange(3, 7)):
            kind = rng.choice([None, None, None, "none", 0, 1, 2, 3] if i % 3 else [None, None, None, "none"])
            if kind is None:
                piece = " ".join(rng.choice([word, word, word, lambda: rng.choice(["at", "a", "the"])])() for _ in range(rng.randrange(1, 4)))
                piece = piece.capitalize() if rng.random() < 0.3 else piece
                piece = piece.upper() if shout else piece
            elif kind == "none":
                piece = rng.choice(none)()
            else:
                if rng.random() < 0.3:
                    text += rng.choice(cues[kind]) + rng.choice([" ", ": "])
                piece = made[kind]()
                spans.append((len(text), kind, len(text) + len(piece)))
            text += piece + (noise if kind != "none" or rng.random() < 0.5 else "") + rng.choice([" ", " ", " ", ". ", ".\n", ", ", " | "])
        rows.append((text, spans))
    return rows


def fit(labelled: list[tuple[str, list[tuple[int, int, int]]]] | None = None) -> crf.Model:
    """The field of labelled texts, at most MOST_LABELLED of them."""
    rows = labelled_table() if labelled is None else labelled
    if not 0 < len(rows) <= MOST_LABELLED:
        raise ValueError(f"1 to {MOST_LABELLED} labelled texts are needed")
    cut = [(tokens(text), spans) for text, spans in rows]
    return crf.fit([(shape, labels_of(start, end, spans)) for (start, end, shape), spans in cut if len(shape)], SHAPES, 1 + 2 * len(KINDS))


def named(spans: list[tuple[int, int, int]]) -> list[str]:
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]


def find(docs: DataFrame, model: crf.Model | None = None, piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, added, spans) of every row; counts are of base spans, the lists hold kind:start:end."""
    model = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, piece):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(model, texts, base, piece, overlap)
                counts = [[sum(k == kind for _, k, _ in b) for b in base] for kind in range(len(KINDS))]
                lists = [[named(b) for b in base], [named(m) for m in more], [named(sorted(b + m)) for b, m in zip(base, more)]]
                arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], *[pa.array(l, pa.list_(pa.string())) for l in lists]]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, RESULT)


def bounded(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text, or one longer text."""
    sizes = np.array([len(t) if t else 0 for t in batch.column("text").to_pylist()])
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes):
        yield batch.slice(start)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
