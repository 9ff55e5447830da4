import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest

from treeloom.llm import conversation_trie as ct
from treeloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, seq string, head int"
COLUMNS = ct.RESULT


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", -1) for r in rows], SCHEMA)


def brute(rows):
    """Nodes from dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(lender, [])[:h] + turns[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        below = [total[k] for k in kids[p]]
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        total[p] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *total[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    ]


def check(spark, rows, **options):
    got = [tuple(r[c] for c in COLUMNS) for r in ct.prefix_trie(table(spark, rows), **options).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def talk(seed, n, words, longest=9):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices("ab", k=rng.randrange(words)))) for c in range(n) for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("most", [1, 4, 500])
def test_equals_brute_force(spark, most):
    check(spark, talk(most, 150, 3), most=most)


def test_hot_prefix_copies_and_long_conversations(spark):
    hot = [(c, t, "user", f"same {t}") for c in range(300, 460) for t in range(6)]  # copies and one first turn for a third
    tails = [(c, 7, "user", f"tail {c % 40}") for c in range(300, 460, 2)]
    long = [(900 + c, t, "user", f"step {t}" if t < 700 or c else "other") for c in range(3) for t in range(800)]
    check(spark, talk(5, 100, 4) + hot + tails + long, most=20)


def test_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 7)
    check(spark, [(c, 0, "user", "x") for c in range(-50, 200)] + [(c, 1, "user", "y") for c in range(0, 200, 3)], most=2)


def test_many_heads_are_joined_salted(spark, monkeypatch):
    monkeypatch.setattr(ct, "FEW_HEADS", 0)
    check(spark, talk(9, 120, 3), most=3)


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [(1, None, None, None), (1, 0, "user", "é中"), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 1, "user", "x"), (2, None, "", ""), (-5, 0, "user", "b"), (0, 3, "a", "bc"), (0, 4, "ab", "c"), (3, 1, "user", ""), (101, 5, "x", "y" * 200_000)]
    check(spark, rows)
    assert ct.prefix_trie(table(spark, rows).limit(0)).count() == 0
    assert ct.prefix_trie(table(spark, [(None, 1, "a", "b")])).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_matches_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    q = c.sql(ORACLE_SQL["op11_conversation_trie"])
    df = QUERIES["op11_conversation_trie"](spark, "/root/testdata/sf0.01")
    assert sorted(q.columns) == sorted(df.columns) == sorted(COLUMNS)
    at = [q.columns.index(n) for n in COLUMNS]
    assert sorted((tuple(r[n] for n in COLUMNS) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in q.fetchall()), key=repr)
