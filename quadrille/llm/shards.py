"""Sharding: documents to shards of almost equal bytes, groups of copies undivided.

Karmarkar-Karp differencing. A partial partition is a list of as many parts as
there are shards; two are combined by uniting the fullest part of the one with
the emptiest of the other, and so on, and always the two with the largest
spread between fullest and emptiest part are next. The heaviest groups, of which there
are no more than shards times LEAF, are combined first, in one task. The others are
spread over leaves of about LEAF groups by hash; each leaf begins with its share of the
imbalance that the heaviest have left, as one more partial partition, and so makes up for it. What
comes out depends on the groups alone, not on the number of Spark's partitions.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.cluster import Shelf, text_key

#: Shards unless told otherwise.
SHARDS = 16
#: Groups that a leaf combines, about.
LEAF = 1 << 14


def whole(size: np.ndarray, k: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Combines single groups, and a partial partition to start with: the sums of its parts then, and for each group its part.

    Of equal spreads the group that comes first is next, of equal sums the part that comes first.
    """
    n = len(size)
    start = np.zeros(k, np.int64) if start is None else start
    begun = np.argsort(-start, kind="stable")
    # Only the first part of a group's own partition has something in it.
    heap = [(-int(s), i) for i, s in enumerate(size)] + [(-int(start.max() - start.min()), n)]
    heapq.heapify(heap)
    last: dict[int, np.ndarray] = {n: start[begun]}
    # Which of its two halves each union takes, kept as a tree: nothing is copied before the end.
    tree: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        one, other = last.pop(a, None), last.pop(b, None)
        if one is None:
            one = np.zeros(k, np.int64)
            one[0] = size[a]
        if other is None:
            other = np.zeros(k, np.int64)
            other[0] = size[b]
        united = one + other[::-1]
        order = np.argsort(-united, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        new = n + 1 + len(tree)
        tree.append((a, b, place))
        last[new] = united[order]
        heapq.heappush(heap, (-int(united[order[0]] - united[order[-1]]), new))
    goes: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    part = np.zeros(n, np.int64)
    for new, (a, b, place) in zip(range(n + len(tree), n, -1), reversed(tree)):
        own = goes.pop(new)
        for child, way in ((a, own[place]), (b, own[place[::-1]])):
            if child < n:
                part[child] = way[0]
            else:
                goes[child] = way
    # The parts are called as those of the partition to start with.
    name = np.empty(k, np.int64)
    name[goes[n]] = begun
    sums = np.empty(k, np.int64)
    sums[name] = last[heap[0][1]]
    return sums, name[part]


def _leaf(table: pa.Table, k: int, rest: np.ndarray, count: int) -> pa.Table:
    """Every group's part, given what the heaviest groups left and the number of leaves."""
    node = table.column("node")[0].as_py()
    size = table.column("bytes").to_numpy()
    order = np.lexsort((table.column("g2").to_numpy(), table.column("g1").to_numpy(), -size))
    part = np.empty(len(size), np.int32)
    part[order] = whole(size[order], k, rest * (node + 1) // count - rest * node // count)[1]
    return table.select(["g1", "g2", "bytes"]).append_column("part", pa.array(part))


def shards(df: DataFrame, k: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_bytes, shard) for each row of df: shards 0 to k - 1, numbered by falling size.

    Rows with equal values of group_col stay together; without group_col, rows with equal texts do, so that no copy
    of a text of one shard is in another. n_bytes is the length of the text in UTF-8, 0 for a null text. Rows
    with a null group are one group. Null and repeated ids stay. With fewer groups than k some shards get
    nothing. Groups of equal size are taken in the order of a hash. A hot group is one row here, and its documents find their shard by a
    join that adaptive execution splits. An empty table gives no rows. Other columns are not read.
    """
    shelf = Shelf(df.sparkSession)
    group = F.col(group_col or text_col).cast("string")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n_bytes"), text_key(group).alias("g1"), F.coalesce(F.when(group.isNotNull(), F.hash(group, F.lit(7))), F.lit(0)).cast("long").alias("g2"))
    groups = shelf.keep(docs.groupBy("g1", "g2").agg(F.sum("n_bytes").alias("bytes")))
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    count = max(1, -(-n // leaf))
    made = "g1 long, g2 long, bytes long, part int"
    heavy = F.col("bytes") > total / (k * leaf)
    first = shelf.keep(groups.where(heavy).withColumn("node", F.lit(0).cast("long")).groupBy("node").applyInArrow(lambda t: _leaf(t, k, np.zeros(k, np.int64), 1), made))
    left = np.zeros(k, np.int64)
    for part, sum_ in first.groupBy("part").agg(F.sum("bytes")).collect():
        left[part] = sum_
    # What all parts have is no imbalance.
    left -= left.min()
    noded = groups.where(~heavy).withColumn("node", F.pmod(F.xxhash64("g1", "g2"), F.lit(count)))
    rest = shelf.keep(noded.groupBy("node").applyInArrow(lambda t: _leaf(t, k, left, count), made))
    shelf.drop(groups)
    sums = dict(first.union(rest).groupBy("part").agg(F.sum("bytes")).collect())
    number = np.argsort(np.argsort([-sums.get(p, 0) for p in range(k)], kind="stable")).tolist()
    placed = first.union(rest).select("g1", "g2", F.get(F.array(*map(F.lit, number)), F.col("part")).alias("shard"))
    return docs.join(placed, ["g1", "g2"]).select("doc_id", "n_bytes", "shard")


def balance(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """(shard, n_docs, n_bytes) of what shards() gave."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
