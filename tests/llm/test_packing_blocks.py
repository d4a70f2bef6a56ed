"""Rows of one id, or of none, do not meet in one block."""

from pyspark.sql import functions as F

from tickloom.llm.packing import pack


def test_null_and_repeated_ids_spread_over_blocks(spark):
    for doc_id in (F.lit(None).cast("bigint"), F.lit(7).cast("bigint")):
        pieces = spark.range(30_000, numPartitions=6).select(
            doc_id.alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (900 + F.col("id") % 50).alias("length"), F.col("id").alias("ids_crc32"))
        packed = pack(pieces).cache()
        assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and packed.count() == 30_000
        blocks = packed.groupBy((F.col("sequence_id") / 2**20).cast("long").alias("b")).count().filter("b < 1000").collect()
        assert len(blocks) >= 8 and max(r["count"] for r in blocks) < 6_000
        per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"), F.count("*").alias("rows"))
        assert per.filter("n <> top OR n > 4096").count() == 0 and per.agg(F.sum("rows")).first()[0] == 30_000


def test_texts_reach_the_workers_in_bounded_batches(spark):
    import pyarrow as pa

    from tickloom.llm.arrow import TEXT_ROWS

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def sizes(batches):
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array([0] * n, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def longest(limit):
        spark.conf.set(name, str(limit))
        pieces = spark.range(3_000).coalesce(1).mapInArrow(sizes, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
        packed = pack(pieces, capacity=4096)
        assert packed.count() == 3_000 and spark.conf.get(name) == str(limit)
        return packed.agg({"length": "max"}).first()[0]

    before = spark.conf.get(name)
    try:
        assert longest(10_000) == longest(0) == TEXT_ROWS
        assert longest(200) == 200  # the session's own lower limit holds
    finally:
        spark.conf.set(name, before)
