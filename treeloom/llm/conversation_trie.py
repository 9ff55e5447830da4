"""Prefix trie of conversations, built by burst tries.

Every turn becomes an element of 20 bytes: 16 bytes of the SHA-256 of its role and text, and the text's
code points. A conversation is the concatenation of its elements, and equal conversations are one row with
their number, their smallest id and the digest of all their ids. All rows start in the container of the root.
A container of more than ``MOST`` distinct sequences bursts: its head stays as a trie node and its sequences go
to the containers of their next turn, one round for each turn that an oversized container shares. Small
containers are sorted and swept: a task reads a container's sequences in order and keeps the open path, so its
memory is one container. The subtrees of the burst heads are summed from below, head by head.

A hot turn is split by the turns behind it, copies of a conversation meet before they are dealt out, and ids of
one end are packed in blocks of ``BLOCK`` ids before they meet in the task that hashes them in order.
One conversation is one row of 20 bytes a turn, so one of a hundred million turns is beyond this.

Input: (conv_id, turn, role, text); further columns are left out. Turns are ordered by ``turn``, null first; equal
turns by the digest of role and text. A null role or text is an empty one. Rows without conv_id belong to no
conversation and are left out. Repeated rows are turns of their own. An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_PARTITIONS, written

MOST = 500  # distinct sequences of a container
BLOCK = 10_000  # ids that are gathered in one row
ELEMENT = 20  # bytes of a turn
SALTS = 16
FEW_HEADS = 10_000  # that are broadcast, at some 60 bytes each
GROUP, LENDER_TURNS = 100, 6
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b""
SEQUENCES = "seq binary, n long, first long, ends string"
NODES = "head binary, up binary, is_head boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
RESULT = [c.split()[0] for c in NODES.split(", ")[3:]]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, element): every turn with its place from 1. Texts go no further than their digest."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    element = F.concat(key, F.lpad(F.lower(F.hex(F.length(text).cast("long"))), 8, "0"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", element.alias("element"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "element")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "element")


def sequences_of(turns: DataFrame) -> DataFrame:
    """(conv_id, seq) of turns(conv_id, pos, element)."""
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "element"))).alias("l"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("l", lambda t: t["element"]), "")).alias("seq"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq) of every conversation c: the first h turns of conversation c - c % 100 and its own behind its first h, with h = crc32(c) % 6."""
    own = written(turns_of(conversations), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENDER_TURNS).cast("int")
    every = own.filter("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("lender"))
    lent = own.filter((F.col("pos") < LENDER_TURNS) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("lender"), "pos", "element")
    before = every.join(lent, "lender").filter("pos <= h").select("conv_id", "pos", "element")
    after = own.filter(F.col("pos") > h).select("conv_id", "pos", "element")
    found = sequences_of(before.unionByName(after))
    return every.select("conv_id").join(found, "conv_id", "left").select("conv_id", F.coalesce("seq", F.lit(ROOT)).alias("seq"))


def distinct_sequences(sequences: DataFrame, partitions: int) -> DataFrame:
    """(seq, n, first, ends): each distinct sequence with its number of conversations, their smallest id, and the digest of all ids in ascending order."""
    part = F.floor(F.col("conv_id") / BLOCK)
    ids = F.array_sort(F.collect_list("conv_id"))
    keyed = sequences.withColumn("key", F.sha2("seq", 256))
    # at most BLOCK ids to a row, since ids of conversations are distinct
    blocks = keyed.groupBy("key", part.alias("part")).agg(F.first("seq").alias("seq"), ids.alias("ids"))
    pieces = blocks.select("key", "part", "seq", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"), F.array_join("ids", ",").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = now = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key:
                        done.append((*now, digest.hexdigest()))
                    key, now, digest = r["key"], [r["seq"], 0, r["first"]], hashlib.sha256()
                elif now[1]:
                    digest.update(b",")
                digest.update(r["piece"].encode())
                now[1] += r["n"]
            if done:
                yield batch_of(done, SEQUENCES)
        if key:
            yield batch_of([(*now, digest.hexdigest())], SEQUENCES)

    return pieces.repartition(partitions, "key").sortWithinPartitions("key", "part").mapInArrow(run, SEQUENCES)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for (_, k), v in zip(fields, zip(*rows))], names=[n for n, _ in fields])


def at_heads(rows: DataFrame, key: str, heads: DataFrame, how: str, few: bool) -> DataFrame:
    """rows joined to heads on a key that may be hot: heads are broadcast if they are few, else rows are dealt to SALTS copies of them."""
    if few:
        return rows.join(F.broadcast(heads), key, how)
    salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], how).drop("salt")


def bursts(sequences: DataFrame, most: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Containers of at most ``most`` sequences, and for each round the burst heads and the digests (head, ends) of what ends at them.

    Containers: (head, up, at, seq, n, first, ends); ``at`` is the depth of head, ``up`` the burst head above it.
    """
    pending = sequences.select(F.lit(ROOT).alias("head"), F.lit(None).cast("binary").alias("up"), F.lit(0).alias("at"), *[c.split()[0] for c in SEQUENCES.split(", ")])
    ready, rounds = [], []
    while True:
        here = F.length("seq") == F.col("at") * ELEMENT
        last = F.when(F.col("at") > 0, F.conv(F.hex(F.expr(f"substring(seq, at * {ELEMENT} - 3, 4)")), 16, 10).cast("long")).otherwise(0)
        sizes = pending.groupBy("head", "up", "at").agg(F.count("*").alias("sequences"), F.max(last).alias("length"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"))
        over = written(sizes.filter(F.col("sequences") > most), "heads")
        n = over.count()
        if not n:
            break
        if rounds:
            marked = at_heads(pending, "head", over.select("head", F.lit(True).alias("over")), "left", n <= FEW_HEADS)
        else:  # all rows are in the root's container
            marked = pending.withColumn("over", F.lit(True))
        marked = written(marked, "burst")
        rounds.append((over, marked.filter(F.col("over") & here).select("head", "ends")))  # one row at most ends at a head
        ready.append(marked.filter("over is null").drop("over"))
        element = F.expr(f"substring(seq, at * {ELEMENT} + 1, {ELEMENT})")
        child = F.unhex(F.substring(F.sha2(F.concat("head", element), 256), 1, 32))
        pending = marked.filter(F.col("over") & ~here).select(child.alias("head"), F.col("head").alias("up"), (F.col("at") + 1).alias("at"), "seq", "n", "first", "ends")
    for t in ready:
        pending = pending.unionByName(t)
    return pending, rounds


def swept(rows: list[dict]) -> list[tuple]:
    """Nodes of one container, its head first, from its sequences in order."""
    head, up, base = rows[0]["head"], rows[0]["up"], rows[0]["at"]
    # a node: parent, depth, conversations, smallest id, children, leaves, saved, length of its last text, ends
    size = lambda s, d: int.from_bytes(s[d * ELEMENT - 4 : d * ELEMENT], "big") if d else 0
    nodes = [[None, base, 0, None, 0, 0, 0, size(rows[0]["seq"], base), None]]
    path, before = [0], rows[0]["seq"]

    def close(depth: int) -> None:
        while len(path) - 1 + base > depth:
            node = nodes[path.pop()]
            add(nodes[path[-1]], node[2], node[3])
            finish(node)
            above = nodes[path[-1]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]

    def add(node: list, n: int, first: int) -> None:
        node[2] += n
        node[3] = first if node[3] is None else min(node[3], first)

    def finish(node: list) -> None:
        node[5] = node[5] or 1
        node[6] += (node[2] - 1) * node[7]

    for r in rows:
        seq, depth = r["seq"], base
        shared = min(len(seq), len(before)) // ELEMENT
        while depth < shared and seq[depth * ELEMENT : (depth + 1) * ELEMENT] == before[depth * ELEMENT : (depth + 1) * ELEMENT]:
            depth += 1
        close(min(depth, base + len(path) - 1))
        for d in range(base + len(path), len(seq) // ELEMENT + 1):
            nodes.append([path[-1], d, 0, None, 0, 0, 0, size(seq, d), None])
            path.append(len(nodes) - 1)
        add(nodes[path[-1]], r["n"], r["first"])
        nodes[path[-1]][8] = r["ends"]
        before = seq
    close(base)
    finish(nodes[0])
    return [(head, up, i == 0, n[3], n[1], None if i == 0 else nodes[n[0]][3], n[2], n[4], n[5], n[6], n[8] or NO_ENDS) for i, n in enumerate(nodes)]


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of every container of a partition that is sorted by head and sequence."""
    held = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["head"] != held[0]["head"]:
                yield batch_of(swept(held), NODES)
                held = []
            held.append(r)
    if held:
        yield batch_of(swept(held), NODES)


def trie(sequences: DataFrame, most: int = MOST) -> DataFrame:
    """Nodes of sequences(conv_id, seq): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    count = sequences.count()
    partitions = max(1, min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 50_000)))
    containers, rounds = bursts(written(distinct_sequences(sequences, partitions), "sequences"), most)
    nodes = written(containers.repartition(partitions, "head").sortWithinPartitions("head", "seq").mapInArrow(sweep, NODES), "nodes")
    if not rounds:
        return nodes.select(*RESULT)
    few = sum(over.count() for over, _ in rounds) <= FEW_HEADS
    # from the deepest burst heads to the root: a head's subtree is its containers' heads and the burst heads below it
    below, tops = nodes.filter("is_head").select("up", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("depth")), []
    deeper = None
    for at, (over, ends) in reversed(list(enumerate(rounds))):
        kids = below.filter(F.col("depth") == at + 1).drop("depth")
        kids = kids if deeper is None else kids.unionByName(deeper)
        sums = kids.groupBy(F.col("up").alias("head")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        total = over.join(sums, "head", "left").join(ends, "head", "left").withColumn("saved_tokens", F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("length"))
        total = written(total.select("head", "up", "conv_id", F.col("at").cast("long").alias("depth"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")), "tops")
        deeper = total.select("up", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        tops.append(total)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    ids = top.select(F.col("head").alias("up"), F.col("conv_id").alias("upper"))
    named = at_heads(nodes.filter("is_head"), "up", ids, "left", few).withColumn("parent_conv_id", F.col("upper")).select(*RESULT)
    burst = at_heads(top, "up", ids, "left", few).withColumn("parent_conv_id", F.col("upper")).select(*RESULT)
    return nodes.filter("not is_head").select(*RESULT).unionByName(named).unionByName(burst)


def prefix_trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(written(rebuilt(conversations), "rebuilt"), most)
