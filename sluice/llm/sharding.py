"""Minimax contiguous sharding: the smallest capacity at which ordered atomic groups fit into the given shards.

Groups are equal texts, ordered by a 64-bit hash of the text, so a hot text is one group and neighbours are unrelated.
The driver holds bounded statistics only: bytes of 2**14 cells of the hash range, and of finer cells where a cut may
fall. A binary search finds the smallest capacity for cells taken whole (an upper bound) and for cells taken as
divisible (a lower bound); cells in which a cut may fall are refined, down to single groups, until both bounds agree.
The cuts are then laid within that capacity, as near to equal sizes as it allows.

Defined results: a null text has no bytes and is grouped with the empty text; a row's size is its bytes plus 8;
repeated rows and null ids stay; an empty table has no rows and needs no cuts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize

#: The first cells are the top 14 bits of the hash; each refinement looks at 10 bits more.
TOP, FINER = 14, 10
#: Rows of one numbering task beyond which a cell is split by doc_id, at least; four times the mean cell, if that is more.
CELL_ROWS = 256


class Cells:
    """Consecutive cells of the ordered groups: first hash (unsigned), shift, bytes and number of groups."""

    def __init__(self, first: np.ndarray, shift: np.ndarray, size: np.ndarray, groups: np.ndarray):
        order = np.argsort(first, kind="stable")
        self.first, self.shift, self.size, self.groups = first[order], shift[order], size[order], groups[order]
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.total = int(self.end[-1]) if len(self.end) else 0

    def reach(self, at: int, capacity: int, whole: bool) -> int:
        """Furthest byte at which a shard from byte `at` may end; between cells, or anywhere in a divisible cell."""
        to = at + capacity
        if to >= self.total:
            return self.total
        k = int(np.searchsorted(self.end, to, "right"))
        return to if not whole and self.groups[k] > 1 else max(at, int(self.start[k]))

    def cuts(self, capacity: int, shards: int, whole: bool) -> list[int] | None:
        """Greedy ends of the shards, None if the last falls short."""
        ends = [0]
        for _ in range(shards):
            ends.append(self.reach(ends[-1], capacity, whole))
        return ends if ends[-1] == self.total else None

    def smallest(self, shards: int, whole: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, shards, whole) else (middle + 1, high)
        return low

    def doubtful(self, low: int, high: int, shards: int) -> np.ndarray:
        """Cells of several groups in which a cut may fall at capacities from low to high."""
        found = np.zeros(len(self.first), bool)
        least, most = [0], [0]
        for _ in range(shards):
            least.append(self.reach(least[-1], low, True))
            most.append(self.reach(most[-1], high, False))
            a, b = np.searchsorted(self.end, least[-1], "right"), np.searchsorted(self.start, most[-1], "left")
            found[a : b + 1] = True
        return found & (self.groups > 1) & (self.shift > 0)

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Ends of the shards within the capacity, each as near to an equal share of the rest as that allows."""
        need = [self.total]  # from the back: the least byte from which the rest fits into the shards left
        for _ in range(shards):
            k = int(np.searchsorted(self.start, need[-1] - capacity, "left"))
            need.append(int(self.start[k]) if k < len(self.start) and self.start[k] < need[-1] else need[-1])
        need.reverse()
        edges = np.concatenate(([0], self.end))
        ends = [0]
        for k in range(1, shards):
            goal = ends[-1] + (self.total - ends[-1]) / (shards - k + 1)
            near = int(edges[np.abs(edges - goal).argmin()])
            ends.append(min(max(near, need[k], ends[-1]), self.reach(ends[-1], capacity, True)))
        return [*ends, self.total]


def keyed(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """doc_id with the text's size, CRC and hash; the hash is shifted so that signed order is unsigned order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(doc_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))


def cells_of(groups: DataFrame, shift: int) -> Cells:
    """Statistics of the cells of 2**shift hashes; as many rows as cells."""
    rows = groups.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).toPandas()
    first = ((rows["cell"].to_numpy(np.int64).astype(object) << shift) + (1 << 63)).astype(np.uint64) if len(rows) else np.zeros(0, np.uint64)
    return Cells(first, np.full(len(rows), shift), rows["bytes"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def plan(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the first key of each shard but the first, of groups (key, bytes)."""
    cells = cells_of(groups, 64 - TOP)
    while True:
        high, low = cells.smallest(shards, True), cells.smallest(shards, False)
        doubt = cells.doubtful(low, high, shards)
        if low == high or not doubt.any():
            break
        parts = [Cells(cells.first[~doubt], cells.shift[~doubt], cells.size[~doubt], cells.groups[~doubt])]
        for shift in np.unique(cells.shift[doubt]).tolist():
            prefixes = [(int(x) - (1 << 63)) >> shift for x in cells.first[doubt & (cells.shift == shift)]]
            parts.append(cells_of(groups.where(F.shiftright("key", shift).isin(prefixes)), max(0, shift - FINER)))
        cells = Cells(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("first", "shift", "size", "groups")))
    ends = cells.balanced(high, shards)
    keys = []
    for end in ends[1:-1]:
        k = int(np.searchsorted(cells.start, end, "left"))
        keys.append(int(cells.first[k]) - (1 << 63) if k < len(cells.first) else (1 << 63))
    return high, keys


def shard_of(key, keys: list[int]):
    """Number of shards that begin at or before the key."""
    at = F.lit(0)
    for first in keys:
        if first < 1 << 63:
            at = at + (key >= F.lit(first).cast("long")).cast("int")
        # a shard that would begin after the last key stays empty
    return at


def groups_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("size").alias("bytes"))


def assign(docs: DataFrame, shards: int = 24, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard and a gapless slot in it, ordered by text hash and doc_id within a cell of hashes.

    Only narrow rows move, never texts. Rows are numbered within cells; cells with many rows, such as those of a hot
    text, are split by a hash of doc_id, so no task numbers a whole shard or group; there slots go by that hash first.
    Rows equal in text and doc_id are numbered in one task.
    """
    rows = materialize(keyed(docs, doc_col, text_col))
    _, keys = plan(materialize(groups_of(rows)), shards)
    placed = rows.withColumn("shard", shard_of(F.col("key"), keys)).withColumn("cell", F.shiftright("key", 64 - TOP))
    counts = placed.groupBy("shard", "cell").count()
    limit = max(CELL_ROWS, 4 * rows.count() >> TOP)
    # Fewer than a quarter of the cells hold over four times their mean, so this list is bounded.
    hot = counts.where(F.col("count") > limit).select("shard", "cell", F.ceil(F.col("count") / limit).alias("parts"))
    dealt = placed.join(F.broadcast(hot), ["shard", "cell"], "left").withColumn("part", F.expr("pmod(xxhash64(doc_id), coalesce(parts, 1))")).drop("parts")
    dealt = materialize(dealt)
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    # At most twice as many rows as there are cells, so this is bounded too.
    offsets = dealt.groupBy("shard", "cell", "part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("shard", "cell", "part").orderBy("key", "doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("row", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "cell", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("row") - 1).cast("long").alias("slot"))


def with_shard(docs: DataFrame, shards: int = 24, text_col: str = "text", column: str = "shard") -> DataFrame:
    """The documents with their shard in one more column, for writing by partitionBy; no join and no shuffle of texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    _, keys = plan(materialize(groups_of(docs.select((F.octet_length(text) + 8).cast("long").alias("size"), F.xxhash64(text).alias("key")))), shards)
    return docs.withColumn(column, shard_of(F.xxhash64(text), keys).cast("int"))
