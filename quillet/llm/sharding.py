"""Sharding by minimax contiguous partition over ordered atomic groups.

Documents of equal text form an atomic group. Groups are ordered by a 60-bit hash of the
text; groups that alone reach the average of what is left come first and take a shard
each. The ordered sizes of the rest are summed into ``2**BIN_BITS`` hash ranges of whole
groups. Over these the smallest feasible capacity is found by binary search with a greedy
check. Ranges of several groups in which a cut may lie are then split, ``SPLIT_CELLS`` at
a time, until every place of a cut is a single group: the capacity is the smallest over
the ordered groups, while the driver sees range sums only, a bounded number each time.
The shards are cut within that capacity, each at the bound nearest to an equal share of
what is left.

Only DataFrame functions are used on the data; one shuffle sums group sizes and one
numbers the slots, both of narrow rows.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import stored

ROW_BYTES = 8
KEY_BITS = 60
BIN_BITS = 16
SPLIT_BITS = 6
SPLIT_CELLS = 1024
SLOT_BUCKETS = 512


def group_hash(text: Column) -> Column:
    """60 bits of the text's MD5; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def greedy_cuts(prefix: list[int], capacity: int) -> list[int]:
    """Ends of the parts when each takes what fits; ``prefix`` are the inclusive sums."""
    cuts, base = [], 0
    while not cuts or cuts[-1] < len(prefix):
        end = bisect_right(prefix, base + capacity)
        cuts.append(end)
        base = prefix[end - 1]
    return cuts


def minimax_cuts(sizes: list[int], parts: int) -> list[int]:
    """Ends of at most ``parts`` contiguous parts whose largest sum is as small as can be."""
    if not sizes:
        return []
    prefix = list(accumulate(sizes))
    return level_cuts(prefix, smallest_capacity(sizes, prefix, parts), parts)


def smallest_capacity(sizes: list[int], prefix: list[int], parts: int) -> int:
    """The smallest largest sum of ``parts`` contiguous parts."""
    low, high = max(max(sizes), -(-prefix[-1] // parts), 1), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(prefix, middle)) <= parts:
            high = middle
        else:
            low = middle + 1
    return low


def level_cuts(prefix: list[int], capacity: int, parts: int) -> list[int]:
    """Ends of ``parts`` parts within the capacity, each as near as can be to an equal
    share of what is left, so that the last part does not get a mere remainder."""
    n = len(prefix)
    need = [0] * (n + 1)  # parts that a greedy filling of the groups from i on takes
    for i in range(n - 1, -1, -1):
        base = prefix[i - 1] if i else 0
        need[i] = 1 + need[bisect_right(prefix, base + capacity)]
    cuts, start, base = [], 0, 0
    for left in range(parts, 0, -1):
        if start == n:
            break
        share = base + (prefix[-1] - base) / left
        last = bisect_right(prefix, base + capacity)
        end = min(bisect_right(prefix, share), last)
        if end < last and prefix[end] - share < share - (prefix[end - 1] if end else 0):
            end += 1
        end = max(end, start + 1)
        while need[end] > left - 1:
            end += 1
        cuts.append(end)
        start, base = end, prefix[end - 1]
    return cuts


class Cell(NamedTuple):
    """A range of 2**bits keys from ``first`` on, with the bytes and number of its groups."""

    first: int
    bits: int
    bytes: int
    groups: int


def open_cells(cells: list[Cell], parts: int) -> list[int]:
    """Numbers of the cells of several groups in which a greedy cut of the groups, at their
    smallest capacity, may lie. Where there are none, cuts between cells are as good as
    cuts between groups.

    Moving a cut to the end of its cell adds at most that cell to a part. So the capacity of
    the groups is less than that of the cells by no more than the largest cell with a cut.
    """
    prefix = list(accumulate(c.bytes for c in cells))
    high = smallest_capacity([c.bytes for c in cells], prefix, parts)
    found = [i for i, c in enumerate(cells) if c.groups > 1]
    while found:
        low = max(high - max(cells[i].bytes for i in found), -(-prefix[-1] // parts))
        places, begin, end = set(), 0, 0
        for _ in range(parts - 1):
            # the cut lies in or after cell ``begin`` at the lower capacity, in or before ``end`` at the upper one
            begin = bisect_right(prefix, (prefix[begin - 1] if begin else 0) + low)
            end = min(bisect_right(prefix, (prefix[end - 1] if end else 0) + high) + 1, len(cells))
            places.update(range(begin, end))
        fewer = [i for i in found if i in places]
        if len(fewer) == len(found):
            break
        found = fewer
    return found


def group_cells(groups: DataFrame, parts: int) -> list[Cell]:
    """Cells in order of their keys, split until none is open; ``groups`` has key and bytes."""

    def summed(rows: DataFrame, bits: int) -> list[Cell]:
        sums = rows.groupBy(F.shiftright("key", bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))
        return [Cell(r["cell"] << bits, bits, r["bytes"], r["groups"]) for r in sums.collect()]

    cells = sorted(summed(groups, KEY_BITS - BIN_BITS))
    while still := open_cells(cells, parts) if cells else []:
        bits = max(cells[i].bits for i in still)
        wide = sorted((i for i in still if cells[i].bits == bits), key=lambda i: -cells[i].bytes)[:SPLIT_CELLS]
        inside = groups.where(F.shiftright("key", bits).isin([cells[i].first >> bits for i in wide]))
        gone = set(wide)
        cells = sorted([c for i, c in enumerate(cells) if i not in gone] + summed(inside, max(bits - SPLIT_BITS, 0)))
    return cells


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 bytes of the text plus 8; a null text has none and is in one
    group with empty texts. Slots count from 0 without gaps in each shard. A group of
    copies stays whole, so one that exceeds an equal share makes its shard larger, and
    the others are balanced among themselves. Rows of one doc_id are separate documents.
    With fewer groups than shards some shards stay empty; an empty table has no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), group_hash(F.col("text")).alias("key"),
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, left = [], shards
    for row in groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect():
        if left == 1 or row["bytes"] * left < total:
            break
        alone.append(row["key"])
        total -= row["bytes"]
        left -= 1
    light = groups.where(~F.col("key").isin(alone)) if alone else groups
    cells = group_cells(light, left)
    cuts = minimax_cuts([c.bytes for c in cells], left)

    shard = F.lit(len(alone))
    for cut in cuts[:-1]:
        shard = shard + (F.col("key") >= cells[cut].first).cast("int")
    for number, key in enumerate(alone):
        shard = F.when(F.col("key") == key, number).otherwise(shard)
    placed = stored(
        rows.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket")),
        "placed",
    )
    # slots: numbers within (shard, bucket) on top of the rows of the buckets before
    counts = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "doc_id")
    numbered = placed.withColumn("rank", F.row_number().over(inside) - 1)
    # at most shards * SLOT_BUCKETS rows
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot")
    )
