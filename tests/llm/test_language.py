import random

from treeloom.llm import language

WORDS = {
    "en": "the house and water with strong thing over there should which think through would night light".split(),
    "de": "das haus und wasser mit stark ding über dort sollte welche denken durch würde nacht licht schön".split(),
    "fr": "la maison et eau avec forte chose être là devrait quelle penser à travers où nuit lumière été".split(),
}


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[l]) for _ in range(rng.randrange(4, 120))).capitalize() + ".", l) for i in range(n) for l in [rng.choice(sorted(WORDS))]]


def test_held_out_accuracy(spark):
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows(300, 1)], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language.fit(df.filter(language.fold("doc_id", 3) != 1))
    got = language.identify(df.filter(language.fold("doc_id", 3) == 1), model).collect()
    assert len(got) > 60 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0.5 <= r.score <= 1 for r in got)


def test_edges(spark):
    schema = "doc_id long, text string, lang string"
    model = language.fit(spark.createDataFrame([*rows(60, 2), (900, None, "en"), (901, "text", None), (902, "", "de"), (903, "123", "fr")], schema))
    assert model.languages == ["de", "en", "fr"]
    given = [None, "", " 12 !? ", "the water " * 30_000, "ẞ𝒳𝒳", "WATER WITH THE STRONG LIGHT", "the", "Привет мир"]
    df = spark.createDataFrame([(None if i == 5 else i, t, None) for i, t in enumerate(given)], schema)
    got = {r.text: r for r in language.identify(df, model).collect()}
    assert [got[t].lang_pred for t in given[:3]] == ["und"] * 3 and got[""].score == 0
    assert got[given[3]].lang_pred == got[given[5]].lang_pred == "en"
    assert got[given[4]].lang_pred in model.languages and got["Привет мир"].phrase_letters < 1.5
    none = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_prediction_ignores_labels(spark):
    df = spark.createDataFrame(rows(60, 3), "doc_id long, text string, lang string")
    model = language.fit(df)
    a = {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()}
    b = {r.doc_id: r.lang_pred for r in language.identify(df.selectExpr("doc_id", "text", "'zz' AS lang"), model).collect()}
    assert a == b


def test_parse_against_brute_force():
    rng = random.Random(5)
    text = [rng.randrange(2, 6) for _ in range(300)]
    table = language.automaton(text)
    known = {tuple(text[i:j]) for i in range(300) for j in range(i, min(300, i + 40) + 1)}
    for n in (1, 7, 60, 200):
        s = [rng.randrange(2, 7) for _ in range(n)]  # 6 never occurs
        phrases, i = 0, 0
        while i < n:
            j = i + 1
            while j < n and tuple(s[i : j + 1]) in known and tuple(s[i:j]) in known:
                j += 1
            phrases, i = phrases + 1, j
        got = language.phrases([table], language.np.array([s], language.np.uint8), language.np.array([n]))
        assert got[0, 0] == phrases


def test_long_texts_are_parsed_in_whole_segments():
    model = language.Model(["a"], language.np.zeros(65536, language.np.uint8), [language.automaton([2, 3])])
    model.symbol[[ord("x"), ord("y")]] = 2, 3
    assert language.scored(model, ["xy" * 3000])[2][0] == 2.0


def test_automata_of_any_alphabet_pack_all_transitions():
    rng = random.Random(8)
    for size, n in ((3, 400), (2000, 3000), (1, 1), (1, 0)):
        text = [rng.randrange(2, 2 + size) for _ in range(n)]
        go = language.suffix_automaton(text)
        a = language.double_array(go, size + 2)
        for s in range(1, len(go)):
            for c in range(size + 2) if size < 10 else (*go[s], 2, 3):
                slot = a.base[s] + c
                assert (a.to[slot] if a.owner[slot] == s else None) == go[s].get(c)


def labelled(alphabets, n, seed):
    """Texts over the letters of each label, by a vocabulary of its own."""
    rng = random.Random(seed)
    words = {l: ["".join(rng.choice(a) for _ in range(rng.randrange(1, 6))) for _ in range(60)] for l, a in alphabets.items()}
    return [(len(alphabets) * i + k, " ".join(rng.choice(words[l]) for _ in range(rng.randrange(15, 90))), l) for i in range(n) for k, l in enumerate(alphabets)]


def accuracy(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = language.fit(df.filter(language.fold("doc_id", 3) != 1))
    got = language.identify(df.filter(language.fold("doc_id", 3) == 1), model).collect()
    right: dict = {}
    for r in got:
        right.setdefault(r.lang, []).append((r.lang_pred == r.lang, r.likeness))
    return {l: (sum(x for x, _ in v) / len(v), min(x for _, x in v)) for l, v in right.items()}


def test_large_alphabets(spark):
    span = lambda start, n: [chr(start + i) for i in range(n)]
    alphabets = {"han": span(0x4E00, 1500), "han2": span(0x4E00 + 700, 1500), "hangul": span(0xAC00, 1500), "ext": span(0x20000, 1200), "ru": span(0x430, 32), "el": span(0x3B1, 25), "en": span(97, 26)}
    got = accuracy(spark, labelled(alphabets, 36, 9))
    assert set(got) == set(alphabets) and all(share == 1 and like > 0.12 for share, like in got.values())


def test_forty_languages_and_little_labelled_text(spark):
    rng = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyzéüñçøå"
    rows = labelled({f"l{k}": rng.sample(letters, 14) for k in range(40)}, 18, 11)
    rows = [r for r in rows if r[2] != "l7" or r[0] // 40 < 9]  # few rows of one
    got = accuracy(spark, rows)
    assert len(got) == 40 and sum(share for share, _ in got.values()) / 40 >= 0.98 and got["l7"][0] == 1


def test_repeated_rows(spark):
    df = spark.createDataFrame(rows(40, 6) * 3, "doc_id long, text string, lang string")
    got = language.identify(df, language.fit(df)).collect()
    assert len(got) == 120 and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 40
