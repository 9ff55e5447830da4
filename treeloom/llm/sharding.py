"""Minimax contiguous sharding by bytes.

Equal texts are one atomic group, ordered by the 64-bit hash of the text. The smallest
capacity at which a greedy pass over the groups needs at most k shards is found by
binary search, and the shards are cut there. Groups as large as a fair share get a shard
of their own first, so that the others stay even.

The driver never sees the groups. It holds sums of hash ranges, at most 4,096 to a
range, and splits only the ranges in which a cut can fall, one job for all of them at
each step, until every cut is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BITS = 12  # a range is split into 2**BITS
ROWS_PER_CELL = 20_000  # rows numbered by one window partition


@dataclass
class Ranges:
    """Sums of ranges of the group order: range i is [low[i], low[i] + 2**width[i])."""

    low: list[int] = field(default_factory=list)
    width: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)


def greedy(sizes: np.ndarray, capacity: int, k: int, splittable: np.ndarray) -> tuple[bool, list[int]]:
    """Whether k shards of this capacity hold everything, and the ranges in which cuts fall.

    A cut inside a splittable range is taken as if it could fall on any byte, so False is certain.
    """
    ends = np.cumsum(sizes)
    base, cuts = 0, []
    for _ in range(k):
        i = int(np.searchsorted(ends, base + capacity, "right"))
        if i == len(ends):
            return True, cuts
        cuts.append(i)
        base = base + capacity if splittable[i] else int(ends[i] - sizes[i])
    return False, cuts


def smallest(sizes: np.ndarray, k: int, splittable: np.ndarray) -> int:
    low, high = max(1, -(-int(sizes.sum()) // k)), max(1, int(sizes.sum()))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(sizes, mid, k, splittable)[0] else (mid + 1, high)
    return low


def cut_points(groups: DataFrame, k: int) -> list[int]:
    """First order key of shards 1, 2, ... . groups(key long, size long); keys are ordered as signed numbers."""
    flipped = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order

    def sums(parts: DataFrame, shift: int) -> list:
        return parts.groupBy("part", F.shiftrightunsigned(flipped, shift).bitwiseAND((1 << BITS) - 1).alias("sub")).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).collect()

    def ranges_of(rows, lows: list[int], shift: int) -> dict[int, list]:
        out: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["part"], r["sub"])):
            out.setdefault(r["part"], []).append((lows[r["part"]] + (r["sub"] << shift), shift, r["size"], r["groups"]))
        return out

    shift = 64 - BITS
    found = ranges_of(sums(groups.withColumn("part", F.lit(0)), shift), [0], shift).get(0, [])
    if not found:
        return []
    while True:
        sizes = np.array([x[2] for x in found], np.int64)
        splittable = np.array([x[3] > 1 and x[1] > 0 for x in found])
        low = smallest(sizes, k, splittable)
        high = smallest(sizes, k, np.zeros(len(found), bool))
        first, last = greedy(sizes, low, k, splittable)[1], greedy(sizes, high, k, splittable)[1]
        ends = np.cumsum(sizes)
        open_ = set()
        for i, (a, b) in enumerate(zip(first, [*last, *[len(found) - 1] * len(first)])):  # where cut i can fall at any capacity from low to high
            reach = int(np.searchsorted(ends, int(ends[a]) + (i + 1) * (high - low), "right"))
            open_ |= {j for j in range(min(a, b), min(max(a, b, reach), len(found) - 1) + 1) if splittable[j]}
        if not open_:
            break
        now = max(found[j][1] for j in open_)  # ranges of one width are split together
        split = sorted(j for j in open_ if found[j][1] == now)
        step = max(0, now - BITS)
        hit = F.lit(None).cast("int")
        for part, j in enumerate(split):
            hit = F.when(F.shiftrightunsigned(flipped, now) == F.lit(found[j][0] >> now), F.lit(part)).otherwise(hit)
        width = now - step
        rows = groups.withColumn("part", hit).filter("part is not null").groupBy("part", F.shiftrightunsigned(flipped, step).bitwiseAND((1 << width) - 1).alias("sub")).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).collect()
        finer = ranges_of(rows, [found[j][0] for j in split], step)
        where = {j: finer[p] for p, j in enumerate(split)}
        found = [y for j, x in enumerate(found) for y in where.get(j, [x])]
    sizes = np.array([x[2] for x in found], np.int64)
    none = np.zeros(len(found), bool)
    cuts = greedy(sizes, smallest(sizes, k, none), k, none)[1]
    return [found[i][0] - (1 << 63) for i in cuts]


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 1. A null text has size 1, crc 0 and stands with the empty texts. Texts
    whose 64-bit hashes are equal share a group. slot numbers the rows of a shard from 0 without gaps;
    rows that share an id get slots in no fixed order. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")

    total, left = groups.agg(F.sum("size")).first()[0] or 0, shards
    alone = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if r["size"] * left < total or left == 1:
            break
        alone.append(r["key"])
        total, left = total - r["size"], left - 1
    cuts = cut_points(groups.filter(~F.col("key").isin(alone)) if alone else groups, left)

    shard = F.lit(0)
    for i, key in enumerate(cuts):
        shard = F.when(F.col("key") >= F.lit(key), F.lit(i + 1)).otherwise(shard)
    for i, key in enumerate(alone):
        shard = F.when(F.col("key") == F.lit(key), F.lit(left + i)).otherwise(shard)
    return numbered(rows.withColumn("shard", shard.cast("int"))).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds slot: rows are dealt into cells of bounded size by id, cells are offset by the counts before them."""
    cells = max(1, -(-rows.count() // ROWS_PER_CELL))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("shard", "cell").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id")) - 1
    return rows.withColumn("within", within).join(offset, ["shard", "cell"]).withColumn("slot", (F.col("offset") + F.col("within")).cast("long"))
