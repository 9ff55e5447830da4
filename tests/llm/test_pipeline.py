import hashlib
import os
import random

import pytest

import corpus_pipeline as cp
from treeloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def corpus():
    rng = random.Random(3)
    words = {l: ["".join(rng.choice(s) for _ in range(rng.randrange(2, 5))) for _ in range(600)] for l, s in {"en": ["th", "ing", "er", "wh", "ou"], "fr": ["é", "eau", "tre", "qu", "oi"]}.items()}
    text = lambda l, n: [rng.choice(words[l]) for _ in range(n)]
    rows = [[i, " ".join(text(l, rng.randrange(80, 200))), l, "s"] for i in range(60) for l in [rng.choice(["en", "fr"])]]
    bench = [(k, " ".join(text("en", 40))) for k in range(5)]
    passage = " ".join(text("en", 70))
    clean = set(range(20))
    exact, near, repeat, leak = [], [], [], []
    for i in range(20, 26):
        exact.append(100 + i), rows.append([100 + i, rows[i][1], rows[i][2], "s"])
        w = rows[i][1].split()
        w[5] = "zz"
        near.append(200 + i), rows.append([200 + i, " ".join(w), rows[i][2], "s"])
    for i in range(30, 34):
        rows[i][1] += " " + passage
        repeat.append(i)
    for i in range(40, 45):
        rows[i][1] = rows[i][1] + " " + bench[i - 40][1]
        leak.append(i)
    rows += [[500, None, "en", "s"], [501, "", None, "s"], [502, "123 456 !!", "en", "s"], [None, " ".join(text("en", 90)), None, None]]
    return rows, bench, passage, clean, exact, near, repeat, leak


def test_stages_on_planted_cases(spark, tmp_path):
    rows, bench, passage, clean, exact, near, repeat, leak = corpus()
    sf = str(tmp_path)
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen.append(docs.collect())
        if name != cp.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r.doc_id for r in rows_} for rows_ in seen]
    assert ids[0] == {r[0] for r in rows} - {500, 501, 502}
    assert ids[1] == ids[0] - set(exact) - set(near)
    texts = {r.doc_id: r.text for r in seen[2]}
    assert ids[2] == ids[1] and passage in texts[30] and not any(passage in texts[i] for i in repeat[1:])
    assert all(texts[i] == rows[i][1] for i in clean)
    assert ids[3] == ids[2] - set(leak)
    last = {r.doc_id: r for r in seen[4]}
    assert set(last) == ids[3] and clean <= set(last)
    assert all(last[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i in last)


def test_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert cp.run(spark, sf).count() == 0


def test_language_stage_keeps_short_clean_texts(spark):
    """One-word texts, repeated ids with other texts, no n_chars, further columns; a text of letters drawn at random goes unless the bound is zero."""
    rows = [r for r in corpus()[0] if r[2] and r[1] and r[1][0].isalpha()]
    noise = " ".join("".join(random.Random(i).choices("bcdfjkmpvxyz", k=8)) for i in range(200))
    short = [(900 + i, " ".join(r[1].split()[: i + 1]), None, "s") for i, r in enumerate(rows[:6])]
    odd = [(900, "the thing", None, "s"), (950, noise, None, "s"), (951, "12 34", None, "s")]
    df = spark.createDataFrame([(*r, 0.5) for r in [*map(tuple, rows), *short, *odd]], "doc_id long, text string, lang string, source string, likeness double")
    some = cp.identify_language(spark, df, "")
    assert some.columns == df.columns
    got = sorted((r.doc_id, r.text) for r in some.collect() if r.doc_id >= 900)
    assert got == sorted((r[0], r[1]) for r in [*short, odd[0]])
    every = {r.doc_id for r in cp.identify_language(spark, df, "", least_likeness=0.0).collect()}
    assert 950 in every and 951 not in every


@needs_data
def test_queries_keep_every_row(spark):
    for n in (1, 3, 5, 9):
        name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
        assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@needs_data
def test_warc_matches_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    q = c.sql(ORACLE_SQL["op10_warc"])
    df = QUERIES["op10_warc"](spark, SF)
    assert sorted(map(tuple, df.select(*q.columns).collect())) == sorted(q.fetchall())
