import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from treeloom.llm import crf, pii

SCHEMA = "doc_id long, text string, spans string, base int"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    """The patterns as they are stated."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def model():
    return pii.fit()


@pytest.mark.parametrize("seed", range(4))
def test_patterns_equal_the_stated_ones(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choices(["a", "B", "@", "@", ".", ".", "-", "+", " ", "1", "2", "55", "4111111111111111", "é", "\n", "(", ")", "_", "%"], k=rng.randrange(25)))
        assert pii.base_spans(text) == brute(text), text


def test_patterns_are_linear_in_long_texts():
    for text in ("a." * 300_000 + "@", "1" * 600_000, "1." * 300_000, "+1" * 300_000, "a@" * 300_000, "1 " * 300_000, "0" * 400_000 + ".1.1.1"):
        pii.base_spans(text)


def test_viterbi_and_likelihood_equal_brute_force():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(11, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    labels = np.zeros(11, np.int8)
    crf.viterbi(e, t, np.array([0, 1, 7]), np.array([1, 7, 11]), labels)
    for a, b in ((0, 1), (1, 7), (7, 11)):
        score = lambda y: e[np.arange(a, b), list(y)].sum() + sum(t[i, j] for i, j in itertools.pairwise((0, *y, 0)))  # noqa: B023, E731
        assert tuple(labels[a:b]) == max(itertools.product(range(3), repeat=b - a), key=score)
    # the gradient is that of the likelihood over all labellings: two shapes that tell two labels apart are learnt
    found = crf.fit([(np.array([0, 1, 1, 0]), np.array([0, 1, 1, 0])), (np.array([1, 0]), np.array([1, 0]))] * 5, 2, 2)
    assert found.decode(np.array([0, 1, 0, 1, 1]), np.array([0]), np.array([5])).tolist() == [0, 1, 0, 1, 1]


def test_held_out_sentences(model):
    hit = wrong = missed = 0
    for text, spans in pii.labelled_table(300, seed=99):
        got = set(pii.field_spans(model, text))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + missed) > 0.95 and hit / (hit + wrong) > 0.98


def test_adds_to_the_patterns_and_leaves_clean_texts(spark, model):
    texts = {
        1: "the order came from here and 9807915762804491 was paid by us",
        2: "write to anna dot lee at mailhost dot org or anna@mailhost.org today",
        3: "please call (017) 555-7713 before noon",
        4: "Licensed under CC BY-NC 4.0. See the GNU General Public License, version 3.\nIt was 12:30 on 2024-05-01, at 1,234.50 for 17 of them.",
        5: "nothing of note is said in these words at all",
        6: 'he said token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" and left',
    }
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([(i, t, "x", 0) for i, t in texts.items()], SCHEMA), model).collect()}
    found = lambda i: [(s.split(":")[0], texts[i][slice(*map(int, s.split(":")[1:]))]) for s in got[i].spans]
    assert found(1) == [("card", "9807915762804491")] and not got[1].base and got[1].n_card == 0
    assert ("email", "anna@mailhost.org") in found(2) and got[2].n_email == 1
    assert found(3) == [("phone", "(017) 555-7713")]
    assert found(4) == found(5) == found(6) == []


def test_added_spans_do_not_overlap_base_ones(model):
    rng = random.Random(5)
    for text, _ in pii.labelled_table(150, seed=7):
        text += " " + "".join(rng.choices("0123456789@.+-() ", k=60))
        base = pii.base_spans(text)
        (more,) = pii.added_spans(model, [text], [base])
        assert not any(s < be and bs < e for s, _, e in more for bs, _, be in base)


def test_pieces_and_batches_give_the_same_spans(model):
    texts = [t for t, _ in pii.labelled_table(60, seed=3)]
    alone = [pii.added_spans(model, [t], [[]])[0] for t in texts]
    assert pii.added_spans(model, texts, [[]] * len(texts)) == alone
    long = "word of a text " * 400
    whole = long.join(texts)
    (once,), (cut,) = pii.added_spans(model, [whole], [[]]), pii.added_spans(model, [whole], [[]], piece=3_000, overlap=1_000)
    assert once == cut and len(once) > 60
    assert len(pii.added_spans(model, ["17 (3) 99 " * 20_000], [[]])) == 1  # one stretch of all tokens


def test_nulls_repeats_and_empty_table(spark, model):
    rows = [(1, None, "x", 0), (None, "a@b.cd", "x", 0), (2, "", None, None), (2, "", None, None), (3, "é 1.2.3.4", "x", 0)]
    out = pii.find(spark.createDataFrame(rows, SCHEMA), model)
    got = sorted(((r.doc_id, ",".join(r.spans)) for r in out.collect()), key=repr)
    assert got == sorted([(1, ""), (None, "email:0:6"), (2, ""), (2, ""), (3, "ip:2:9")], key=repr)
    assert pii.find(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert pii.digest([]) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        pii.fit([])
