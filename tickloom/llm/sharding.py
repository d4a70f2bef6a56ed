"""Operator 4: shards of nearly equal bytes, groups kept whole, by Karmarkar-Karp differencing.

Method: every group of equal texts is a partial partition with its bytes in one
of the shards and none in the others.  The two partial partitions of largest
spread are combined, one in descending and one in ascending order, until one is
left.

Any order of combining keeps groups whole, so blocks of groups are differenced
in parallel and each block leaves one partial partition of a few bytes' spread.
The driver differences these: one row of `shards` numbers per block.

Scale: texts stay in the scan; what is shuffled is a digest, a size and an id per
row.  Copies are added up before the shuffle.  Slots are numbered per (shard,
bucket) with one offset per bucket, so no task numbers a whole shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.lineage import cut

#: Groups differenced together in one task.  Affects memory, and the spread by a few bytes.
BLOCK = 100_000


def difference(parts: Sequence[Sequence[int]]) -> list[tuple[int, ...]]:
    """For each partial partition (k sums) the shard that each of its k sums goes to, by largest differencing.

    Ties are combined in input order.  With one partial partition nothing moves.
    """
    if not parts:
        return []
    k = len(parts[0])
    sums, order = [], []  # of nodes: sums in descending order, and for each of them the place in the node's own parts
    for p in parts:
        places = sorted(range(k), key=lambda j: (-p[j], j))
        sums.append([p[j] for j in places])
        order.append(places)
    children: list[tuple | None] = [None] * len(parts)
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        left, right = sums[a], sums[b]
        added = [left[j] + right[k - 1 - j] for j in range(k)]
        places = sorted(range(k), key=lambda j: (-added[j], j))
        sums[a] = sums[b] = None
        sums.append([added[j] for j in places])
        children.append((a, b, places))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    result: list[tuple[int, ...]] = [()] * len(parts)
    todo = [(heap[0][1], tuple(range(k)))]  # a node, and the shard of each of its sorted sums
    while todo:
        node, target = todo.pop()
        if children[node] is None:
            shard = [0] * k
            for place, own in enumerate(order[node]):
                shard[own] = target[place]
            result[node] = tuple(shard)
            continue
        a, b, places = children[node]
        of_left = [0] * k
        for place, j in enumerate(places):
            of_left[j] = target[place]
        todo.append((a, tuple(of_left)))
        todo.append((b, tuple(reversed(of_left))))
    return result


def assign_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Shards of nearly equal bytes; equal texts share a shard.

    A row's size is the UTF-8 bytes of its text plus 1; null counts as empty.  Returns one row per input row: doc_id, size,
    text_crc32, law ('bytes'), shard (from 0), slot (gapless from 0 in each shard, by bucket of doc_id, then doc_id) and
    grown_shard (null: growing by one shard moves rows under this law).

    A group larger than a shard's equal share gets a shard alone as far as possible.  Repeated rows and null ids are rows
    like any other.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("key"),
    ))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def settle(table: pa.Table) -> pa.RecordBatch:
            table = table.sort_by([("bytes", "descending"), ("key", "ascending")]).combine_chunks()
            sizes = table.column("bytes").to_pylist()
            places = difference([(s, *[0] * (shards - 1)) for s in sizes])
            return pa.RecordBatch.from_arrays(
                [table.column("key").combine_chunks(), table.column("bytes").combine_chunks(), pa.array([part * 2**32 + number] * len(sizes), pa.int64()),
                 pa.array([p[0] for p in places], pa.int32())],
                names=["key", "bytes", "block", "subset"],
            )

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield settle(pa.Table.from_batches(held))
                number, held = number + 1, []
        if held:
            yield settle(pa.Table.from_batches(held))

    placed = cut(groups.mapInArrow(differenced, "key binary, bytes bigint, block bigint, subset int"))
    # One row of `shards` numbers per block comes to the driver: documents / BLOCK rows, at least one per task.
    sums = placed.groupBy("block").pivot("subset", list(range(shards))).sum("bytes").orderBy("block").collect()
    moves = difference([[r[str(j)] or 0 for j in range(shards)] for r in sums])
    table = [(r["block"], j, m[j]) for r, m in zip(sums, moves) for j in range(shards)]
    to = spark.createDataFrame(table, "block bigint, subset int, shard int")
    of_group = placed.join(to, ["block", "subset"]).select("key", "shard")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A text with very many copies: its rows are few bytes each, and adaptive execution splits such a join partition.
    found = cut(rows.join(of_group, "key").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row per bucket
    starts = found.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    in_bucket = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32")
    numbered = found.withColumn("place", F.row_number().over(in_bucket) - 1).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
