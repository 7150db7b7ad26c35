"""Minimax contiguous sharding: the least capacity under which ordered atomic groups fit a number of shards.

A group is all rows of one text; groups are ordered by the SHA-256 of the
text. The capacity is found by binary search, each candidate checked by a
greedy left-to-right fill over prefix sums. A group larger than the capacity
stands alone, so one huge group of copies does not blow up the other shards.

The search never holds the groups. It sees cells, sums of the groups that
share a digest prefix: first at most 65,536 of them. Filling cells as atoms
bounds the capacity from above, letting shards cut through cells bounds it
from below, and only cells between the cuts of both fills are split further,
until the bounds meet; the capacity is then exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.ranges import block_of
from larkspan.session import discard, materialize

#: Hex digits of the first cells, rows of cells that are split into whole groups at once, and cells split in one round.
FIRST_DIGITS, WHOLE_ROWS, SPLIT_CELLS = 4, 20_000, 256


def fill(ends: np.ndarray, capacity: int, most: int) -> list[int] | None:
    """Cell numbers that start the 2nd, 3rd... shard of a greedy fill, or None where `most` shards don't do.

    ends: prefix sums of the cells, from 0.
    """
    starts, at = [], 0
    while True:
        at = max(at + 1, int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1)
        if at >= len(ends) - 1:
            return starts
        starts.append(at)
        if len(starts) >= most:
            return None


def fill_through(ends: np.ndarray, whole: np.ndarray, capacity: int, most: int) -> list[int] | None:
    """Offsets where shards start if those cells that aren't whole groups may be cut anywhere."""
    starts, at, total = [], 0, int(ends[-1])
    while True:
        to = at + capacity
        if to >= total:
            return starts
        cell = int(np.searchsorted(ends, to, "right")) - 1
        if whole[cell] and ends[cell] < to:
            to = int(ends[cell]) if ends[cell] > at else int(ends[cell + 1])
            if to >= total:
                return starts
        at = to
        starts.append(at)
        if len(starts) >= most:
            return None


def least(feasible, low: int, high: int) -> int:
    """The smallest feasible number in [low, high]; high is feasible."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) is not None else (mid + 1, high)
    return low


def even_starts(sizes: np.ndarray, shards: int) -> list[int]:
    """Cell numbers that start the 2nd... shard under the minimax capacity.

    Between cells that stand alone, each run of shards is cut again under the
    least capacity for that run, so that it comes out even.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    capacity = least(lambda c: fill(ends, c, shards), 1, int(ends[-1]))
    edges = [0, *fill(ends, capacity, shards), len(sizes)]
    starts, k = [], 0
    while k < len(edges) - 1:
        m = k
        while m < len(edges) - 1 and ends[edges[m + 1]] - ends[edges[m]] <= capacity:
            m += 1
        if m == k:
            starts.append(edges[k])
            k += 1
            continue
        run = ends[edges[k] : edges[m] + 1] - ends[edges[k]]
        inner = least(lambda c: fill(run, c, m - k), 1, int(run[-1]))  # noqa: B023
        starts += [edges[k], *(edges[k] + s for s in fill(run, inner, m - k))]
        k = m
    return starts[1:]


def _cells(rows: DataFrame, digits: int, within: list[str] | None = None) -> list:
    """(p, size, n, whole) of the groups that share a prefix p of the key; whole where that is one group."""
    if within is not None:
        rows = rows.where(F.substring("key", 1, len(within[0])).isin(within))
    grouped = rows.groupBy(F.substring("key", 1, digits).alias("p"))
    return grouped.agg(F.sum("size").alias("size"), F.count("*").alias("n"), (F.min("key") == F.max("key")).alias("whole")).collect()


def minimax_cuts(rows: DataFrame, shards: int, first_digits: int = FIRST_DIGITS, whole_rows: int = WHOLE_ROWS) -> list[str]:
    """Prefixes of keys that start shards 1, 2...: fewer than shards - 1 where there are fewer groups.

    rows: key (hex digest), size. What the driver holds is bounded: at most
    16 ** first_digits cells, and for each round of splitting at most
    SPLIT_CELLS cells into 256 parts each, or whole_rows groups. Cells between
    the cuts of both fills are split first; where those are whole groups, the
    largest of the others are.
    """
    cells = sorted(_cells(rows, first_digits), key=lambda c: c.p)
    if not cells:
        return []
    while True:
        sizes = np.array([c.size for c in cells], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        whole = np.array([c.whole for c in cells])
        total = int(ends[-1])
        # only a single group may stand alone above the capacity, so cells of several bound it from below
        high = max(least(lambda c: fill(ends, c, shards), 1, total), int(sizes[~whole].max(initial=0)))  # noqa: B023
        low = least(lambda c: fill_through(ends, whole, c, shards), 1, high)  # noqa: B023
        if low == high or whole.all():
            break
        late = [*fill_through(ends, whole, low, shards), total]
        early = [*(int(ends[i]) for i in fill(ends, high, shards)), total]
        hit = np.zeros(len(cells), bool)
        for a, b in zip(late, early, strict=False):
            first, last = (int(np.searchsorted(ends, x, "right")) - 1 for x in (min(a, b), max(a, b)))
            hit[max(first - 1, 0) : last + 1] = True
        hit |= sizes > low  # what may stand alone must be known
        chosen = [c for c, h, w in zip(cells, hit, whole, strict=True) if h and not w] or [c for c, w in zip(cells, whole, strict=True) if not w]
        at = min(len(c.p) for c in chosen)
        chosen = sorted((c for c in chosen if len(c.p) == at), key=lambda c: -c.size)[:SPLIT_CELLS]
        digits = 64 if sum(c.n for c in chosen) <= whole_rows else at + 2
        gone = {c.p for c in chosen}
        cells = [c for c in cells if c.p not in gone] + _cells(rows, digits, sorted(gone))
        cells.sort(key=lambda c: c.p)
    return [cells[i].p for i in even_starts(sizes, shards)]


def _offsets(spark: SparkSession, counts: list) -> DataFrame:
    """What to add to a row's number in its file for its slot: one row for each file and shard in it."""
    seen: dict[int, int] = {}
    out = []
    for r in sorted(counts, key=lambda r: (r.file, r.shard)):
        out.append((r.file, r.shard, seen.get(r.shard, 0) - r.first))
        seen[r.shard] = seen.get(r.shard, 0) + r.n
    return spark.createDataFrame(out, "file long, shard int, add long")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, spread_copies: bool = False) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of docs, by the law `bytes`.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty and is
    grouped with empty ones. Rows of one text share a shard. slot numbers a
    shard's rows from 0 without gaps, by text digest, then id (nulls first);
    rows equal in both are interchangeable. grown_shard is null. Fewer texts
    than shards leave the last shards empty; an empty table gives an empty
    result. Other columns are not read.

    With spread_copies a row is a group of its own, ordered by a digest of its
    text, id and the number of the copy: the copies of a mixture's document
    then lie anywhere, as its shuffle wants, and not side by side in one shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    if spread_copies:
        numbered = F.row_number().over(Window.partitionBy("id", "key").orderBy("id"))  # as many as a document has copies
        narrow = narrow.withColumn("key", F.sha2(F.concat_ws("|", "key", F.col("id").cast("string"), numbered.cast("string")), 256))
    narrow = materialize(narrow, "narrow")
    place = F.monotonically_increasing_id()
    rows = materialize(narrow.repartitionByRange("key", "id").sortWithinPartitions("key", "id").withColumn("place", place), "rows")
    discard(narrow)
    placed = rows.withColumn("shard", block_of(F.col("key"), minimax_cuts(rows, shards)))
    placed = placed.withColumn("file", F.shiftright("place", 33)).withColumn("number", F.col("place").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("file", "shard").agg(F.count("*").alias("n"), F.min("number").alias("first")).collect()
    # as many rows as there are files plus shards
    out = placed.join(F.broadcast(_offsets(spark, counts)), ["file", "shard"])
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("number") + F.col("add")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
