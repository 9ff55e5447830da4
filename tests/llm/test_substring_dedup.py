import random
import re

import pytest

from treeloom.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, __chunk string, n_words string"


def brute(rows, window):
    words = [(i if i is not None else 2**63, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, w), (d, _) in zip(words, rows):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [13, 4, 1])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    word = lambda: rng.choice("a b c dd é Æon A a. 中文".split()) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "\t \x0b", " "]).join(w)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (5, rows[5][1]), (102, None), (103, ""), (104, " \n "), (None, rows[5][1]), (None, rows[5][1]), (105, "x y " * 30 + "z"), (106, "a0 " * 3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "c", "n") for i, t in rows], SCHEMA)
    out = remove_repeats(df, window=window, chunk_bytes=3000)
    assert set(out.columns) == {"doc_id", "text", "__chunk", "kept_text", "n_words", "n_removed"}
    got = out.collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=repr) == brute(rows, window)
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows, key=repr) and {r["__chunk"] for r in got} == {"c"}


def test_chunks_do_not_matter(spark):
    text = " ".join(f"w{i % 50}" for i in range(400))
    df = spark.createDataFrame([(i, text if i % 2 else text[: 7 * i]) for i in range(30)], "doc_id long, text string")
    a, b = (sorted(map(tuple, remove_repeats(df, chunk_bytes=c).collect())) for c in (100, 10_000_000))
    assert a == b


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
