"""Operator 3: exact duplicates by content sort.

Method: rows are range-partitioned at sampled splitters, each partition is
sorted (Spark's sort spills to disk), so equal texts lie side by side, and every
row is compared in full with its neighbour.  The order inside a group puts the
row that stays first.

The sort key is the head of the normalised bytes, then the digest of all of them,
then the order of preference.  It has a bounded size, so the sample that Spark
draws for its splitters stays small however long the texts are; texts with one
head are still spread, and so is a group of equal texts, however large: its rows
differ in the last key.  A group cut by a partition border is put together again
from two rows per partition, compared in full by a join.

Scale: one shuffle of the texts.  The table of borders has one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.lineage import cut
from tickloom.llm.arrow import ASCII_SPACE, byte_column, in_slices

_SPACE_BYTES = ASCII_SPACE.encode()


def normalised(text: Column) -> Column:
    """The text without any character of `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _sorted_runs(docs: DataFrame, carried: list[str], doc_id: str, text: str, whole: bool, partitions: int | None) -> DataFrame:
    """Rows of the content sort with partition, run of equal texts and, at the ends of a partition, the normalised bytes.

    `whole`: the first row of each run only, with all carried columns; otherwise every row with its run's size.
    """
    session = docs.sparkSession
    n = partitions or int(session.conf.get("spark.sql.shuffle.partitions"))
    bare = normalised(F.col(text))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"),
        F.substring(bare, 1, 24).alias("head"), F.sha2(bare.cast("binary"), 256).alias("sha"),
    )
    if whole:
        keyed = keyed.drop("text").withColumn("text", F.coalesce(F.col(f"row.`{text}`"), F.lit("")))
    order = [F.col("head"), F.col("sha"), F.col("chars").desc(), F.col("id").asc_nulls_last()]
    placed = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    id_field, row_field = keyed.schema["id"], keyed.schema["row"]
    schema = T.StructType([
        *([row_field] if whole else [T.StructField("id", id_field.dataType), T.StructField("sha", T.StringType()), T.StructField("size", T.LongType())]),
        T.StructField("keep", id_field.dataType), T.StructField("first", T.BooleanType()),
        T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("edge", T.BinaryType()),
    ])

    def heads(batch: pa.RecordBatch, before: bytes | None) -> tuple[list[bytes], np.ndarray]:
        """Normalised texts, and which of them differ from the text before."""
        texts = [x.translate(None, _SPACE_BYTES) for x in byte_column(batch.column("text"))]
        return texts, np.fromiter((a != b for a, b in zip([before, *texts], texts)), bool, len(texts))

    def every_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is held until the end of the partition are ids, digests and run numbers, never texts."""
        part, before, ids, shas, new, first_text = TaskContext.get().partitionId(), None, [], [], [], None
        for batch in in_slices(batches, 1024):
            texts, fresh = heads(batch, before)
            first_text = texts[0] if before is None else first_text
            before = texts[-1]
            ids.append(batch.column("id"))
            shas.append(batch.column("sha"))
            new.append(fresh)
        if not ids:
            return
        ids, shas, new = pa.concat_arrays(ids), pa.concat_arrays(shas), np.concatenate(new)
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff([*starts, len(new)])
        for at in range(0, len(new), 10_000):
            r = run[at:at + 10_000]
            fresh = new[at:at + 10_000]
            edge = [None] * len(r)
            for i in np.flatnonzero(fresh & ((r == 0) | (r == run[-1]))):
                edge[i] = first_text if r[i] == 0 else before
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, 10_000), shas.slice(at, 10_000), pa.array(sizes[r]), ids.take(pa.array(starts[r])), pa.array(fresh),
                 pa.array(np.full(len(r), part, np.int32)), pa.array(r), pa.array(edge, pa.binary())],
                names=schema.names,
            )

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, run, held = TaskContext.get().partitionId(), None, 0, None
        def made(rows, at, edges):
            k = len(at)
            return pa.RecordBatch.from_arrays(
                [rows.column("row").take(pa.array(at)), rows.column("id").take(pa.array(at)), pa.array([True] * k),
                 pa.array([part] * k, pa.int32()), pa.array(range(run, run + k), pa.int64()), pa.array(edges, pa.binary())],
                names=schema.names,
            )
        for batch in in_slices(batches, 1024):
            texts, fresh = heads(batch, before)
            before = texts[-1]
            at = np.flatnonzero(fresh)
            if not len(at):
                continue
            if held is not None:
                yield held[0] if held[1] else held[0].set_column(len(schema) - 1, "edge", pa.nulls(1, pa.binary()))
            if len(at) > 1:
                yield made(batch, at[:-1], [texts[0] if run + i == 0 else None for i in range(len(at) - 1)])
                run += len(at) - 1
            held = made(batch, at[-1:], [texts[at[-1]]]), run == 0
            run += 1
        if held is not None:
            yield held[0]

    return placed.mapInArrow(first_rows if whole else every_row, schema)


def _borders(runs: DataFrame) -> DataFrame:
    """One row per partition: what its first run continues (null: nothing), and the whole size of the runs at its ends.

    Windows run over this table only: its size is the number of partitions, whatever the rows.
    """
    sized = "size" in runs.columns
    ends = runs.filter(F.col("edge").isNotNull()).select("part", "run", "edge", "keep", *(["size"] if sized else []))
    size = F.col("size") if sized else F.lit(0).cast("long")
    table = ends.groupBy("part").agg(
        F.max("run").alias("last"), F.max_by("keep", "run").alias("last_keep"), F.max_by(size, F.col("run")).alias("last_size"),
        F.min_by(size, F.col("run")).alias("first_size"),
    ).withColumn("ord", F.row_number().over(Window.orderBy("part")))
    # Full comparison across each border.
    place = table.select("part", "ord", "last")
    opening = ends.filter("run = 0").join(place, "part").select("ord", F.col("edge").alias("opens"))
    closing = ends.join(place, "part").filter("run = last").select((F.col("ord") + 1).alias("ord"), F.col("edge").alias("closes"))
    joined = table.join(opening.join(closing, "ord").select("ord", (F.col("opens") == F.col("closes")).alias("continued")), "ord", "left")
    joined = joined.withColumn("continued", F.coalesce("continued", F.lit(False)))
    ordered = Window.orderBy("ord")
    past = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # A run that starts here and not before: its partition has more runs, or its only run continues nothing.
    starts_here = ~F.col("continued") | (F.col("last") > 0)
    joined = joined.withColumn("from_ord", F.when(F.col("continued"), F.last(F.when(starts_here, F.col("ord")), True).over(past)))
    joined = joined.withColumn("from_keep", F.when(F.col("continued"), F.last(F.when(starts_here, F.struct("last_keep")), True).over(past)["last_keep"]))
    more = joined.filter("continued").groupBy(F.col("from_ord").alias("ord")).agg(F.sum("first_size").alias("more"))
    joined = joined.join(more, "ord", "left").withColumn("closing_size", F.col("last_size") + F.coalesce("more", F.lit(0)))
    origin = joined.select(F.col("ord").alias("from_ord"), F.col("closing_size").alias("opening_size"))
    return joined.join(origin, "from_ord", "left").select("part", "last", "continued", "from_keep", "opening_size", "closing_size")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Groups of texts that are equal without white space `[\\x20\\x09-\\x0D]`.

    Returns one row per input row: doc_id, keep_id (the row of the group that stays), group_size, kept, text_sha256 (of
    the normalised text).  The row with the most code points in its original text stays, of these the smallest doc_id.

    Null text counts as empty, and all empty texts form one group.  A null doc_id comes after all others.  Rows that agree
    in text and doc_id are one group of which one row is kept.  Other columns are not read and so cannot clash.  An empty
    table gives an empty table.
    """
    runs = cut(_sorted_runs(docs, [doc_id], doc_id, text, False, partitions))
    found = runs.drop("edge").join(cut(_borders(runs)), "part")
    opening = (F.col("run") == 0) & F.col("continued")
    return found.select(
        F.col("id").alias("doc_id"), F.when(opening, F.col("from_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(opening, F.col("opening_size")).when(F.col("run") == F.col("last"), F.col("closing_size")).otherwise(F.col("size")).alias("group_size"),
        (F.col("first") & ~opening).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """The rows that `exact_groups` keeps, with all their columns, whatever their names."""
    runs = cut(_sorted_runs(docs, docs.columns, doc_id, text, True, partitions))
    found = runs.join(cut(_borders(runs).select("part", "continued")), "part").filter(~((F.col("run") == 0) & F.col("continued")))
    return found.select("row.*")
