"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents of equal text are one group. Groups enter in order of falling size; each
goes to the bin with the tightest sufficient remaining capacity, found in a balanced
tree. Groups of one size are a run: best fit puts as many of a run into the tightest
bin as it holds before it turns to the next, so a run costs a step for each bin that
it touches and not one for each group, with the same result.

The driver sees the runs (size, number of groups), not the groups: with distinct sizes
s1 < s2 < ... that sum to the table's bytes at most, there are at most the square
root of twice the bytes of them, and in practice the number of text lengths. The
groups of a size are then ranked in Spark, in parts, and dealt to the bins of its run.

For a given number of shards, the capacity is found by bisection between an even share
and that plus the largest group, where best fit always succeeds. (Best fit decreasing
isn't monotone in the capacity, so a smaller one might exist.) Groups too large for an
even share get a shard of their own first.

Defined results: a null text counts as an empty one, with 0 bytes and that CRC, in
one group with the empty texts; rows that repeat a doc_id are placed each; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitcast.llm.common import small, table, text_of, written

#: Bytes that each document takes besides its text.
OVERHEAD = 8
#: Rows that are numbered in one task, about.
PART = 50_000


class Capacities:
    """Remaining capacities of bins in order: a balanced tree of two levels, leaves of LEAF entries at most."""

    LEAF = 256

    def __init__(self, entries: list[tuple[int, int]]) -> None:
        entries = sorted(entries)
        self.leaves = [entries[i : i + self.LEAF // 2] for i in range(0, len(entries), self.LEAF // 2)]
        self.tops = [leaf[-1] for leaf in self.leaves]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest (remaining, bin) with remaining >= size."""
        i = bisect_left(self.tops, (size, -1))
        if i == len(self.tops):
            return None
        leaf = self.leaves[i]
        found = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[i] = leaf[-1]
        else:
            del self.leaves[i], self.tops[i]
        return found

    def put(self, entry: tuple[int, int]) -> None:
        i = min(bisect_left(self.tops, entry), len(self.tops) - 1)
        if i < 0:
            self.leaves, self.tops = [[entry]], [entry]
            return
        insort(self.leaves[i], entry)
        if len(self.leaves[i]) > self.LEAF:
            half = self.LEAF // 2
            self.leaves[i : i + 1] = [self.leaves[i][:half], self.leaves[i][half:]]
            self.tops[i : i + 1] = [leaf[-1] for leaf in self.leaves[i : i + 2]]
        else:
            self.tops[i] = self.leaves[i][-1]


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each run (size, number), sizes falling, what goes where: (bin, number) pairs. None if more than `most` bins are needed.

    A size above the capacity gets a bin of its own. With `most`, all bins are open
    from the start; without, a bin opens when no open one has room.
    """
    tree = Capacities([(capacity, b) for b in range(most or 0)])
    out, opened = [], most or 0
    for size, number in runs:
        parts = []
        while number:
            found = tree.take(min(size, capacity))
            if found is None:
                if most is not None:
                    return None
                found, opened = (capacity, opened), opened + 1
            n = min(number, max(1, found[0] // size)) if size else number
            parts.append((found[1], n))
            tree.put((max(0, found[0] - n * size), found[1]))
            number -= n
        out.append(parts)
    return out


def pack(runs: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """(shard, number) pairs of each run: oversize groups alone, the rest at the smallest capacity found that best fit meets."""
    own, rest, left = 0, sum(s * n for s, n in runs), [list(x) for x in runs]
    out: list[list[tuple[int, int]]] = [[] for _ in runs]
    for i, (size, _) in enumerate(runs):
        while left[i][1] and own < shards - 1 and size * (shards - own) > rest:
            out[i].append((own, 1))
            left[i][1] -= 1
            rest -= size
            own += 1
    todo = [(i, s, n) for i, (s, n) in enumerate(left) if n]
    if not todo:
        return out
    bins, some = shards - own, [(s, n) for _, s, n in todo]
    low = max(-(-rest // bins), some[0][0])
    high = -(-rest // bins) + some[0][0]
    found = best_fit_decreasing(some, high, bins)
    while low < high:
        middle = (low + high) // 2
        if (x := best_fit_decreasing(some, middle, bins)) is None:
            low = middle + 1
        else:
            high, found = middle, x
    for (i, _, _), parts in zip(todo, found, strict=True):
        out[i] += [(own + b, n) for b, n in parts]
    return out


def _narrow(docs: DataFrame) -> DataFrame:
    size = F.octet_length(text_of()).cast("long") + OVERHEAD
    return docs.select("doc_id", size.alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), F.xxhash64(text_of()).alias("g1"), F.xxhash64(F.lit(1), text_of()).alias("g2"))


def _numbered(df: DataFrame, rows: int, group: str, by: list[str], name: str) -> DataFrame:
    """df, of so many rows, with `name`: a gapless number from 0 within each value of `group`, counted in parts so that no task numbers a large group whole."""
    parts = max(1, rows // PART)
    dealt = written(df.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")), "sharding-parts")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_part").agg(F.count("*").alias("n")).select(group, "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*by))
    return dealt.withColumn("_place", place).join(small(starts), [group, "_part"]).withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_part", "_start", "_place")


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: `shards` near-equal shards, or as few as best fit needs for `capacity` bytes each.

    With `capacity`, a group larger than it has a shard to itself.
    """
    spark: SparkSession = docs.sparkSession
    rows = written(_narrow(docs), "sharding-rows")
    groups = written(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")), "sharding-groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes")).toPandas()
    runs = [(int(s), int(n)) for s, n in zip(sizes["bytes"], sizes["n"], strict=True)]
    placed = pack(runs, shards) if shards else best_fit_decreasing(runs, capacity)
    table_: list[tuple[int, int, int, int]] = []
    for (size, _), parts in zip(runs, placed, strict=True):
        at = 0
        for b, n in parts:
            table_.append((size, at, at + n, b))
            at += n
    import pandas as pd

    bins = spark.createDataFrame(pd.DataFrame(table_, columns=["bytes", "lo", "hi", "shard"]), "bytes long, lo long, hi long, shard int")
    ranked = _numbered(groups, sum(n for _, n in runs), "bytes", ["g1", "g2"], "rank")
    where = ranked.join(small(bins), "bytes").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("g1", "g2", "shard")
    put = rows.join(where, ["g1", "g2"]).select("doc_id", "size", "text_crc32", "shard")
    return _numbered(put, rows.count(), "shard", ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op4_best_fit_sharding(spark, sf_dir: str) -> DataFrame:
    put = shard(table(spark, sf_dir, "documents"), shards=24)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
