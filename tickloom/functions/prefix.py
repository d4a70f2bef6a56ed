"""Running totals, ranks and exact quantiles over groups of any size.

`Window.partitionBy(key).orderBy(x)` puts a whole key into one task.  The
helpers here split every key into ordered buckets first: the window runs
inside a bucket, one row per bucket carries the totals forward, and the carry
is joined back.  Results are the same as those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.lineage import cut, small

CELLS_PER_OCTAVE = 1024
#: Rows of an ordered cell above which it is split by its own range of values.
CELL_ROWS = 100_000


def order_cell(value: Column) -> Column:
    """Map a double to a long that never decreases with it.

    Cells are 1/1024 of a power of two wide, so about 40,000 of them cover
    twelve decimal orders of magnitude.  Equal values share a cell, which makes
    the map a safe bucket for anything ordered by the value.
    """
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    position = (exponent + 1100 + size / F.pow(F.lit(2.0), exponent) - 1) * CELLS_PER_OCTAVE
    return (
        F.when(size == 0, F.lit(0))
        .when(value > 0, F.floor(position))
        .otherwise(-F.floor(position))
        .cast("long")
    )


def fine_cells(df: DataFrame, keys: list[str], value: str, out: str = "_cell", rows: int | None = None) -> DataFrame:
    """Add ordered cells of a written table's `value`, none of which has more than `rows` rows unless they all are equal.

    A cell is the path of a tree: first the cell of `order_cell`, then, where that is too full, an equal part of the range
    of values that it really holds, and so on until no cell is too full.  Paths are arrays, which compare like the values.
    Each level is one aggregate over the table, combined before its shuffle; usually the first finds nothing to split.
    """
    most = CELL_ROWS if rows is None else rows
    celled = df.withColumn(out, F.array(order_cell(F.col(value))))
    while True:
        full = celled.groupBy(*keys, out).agg(F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        full = full.filter((F.col("_n") > most) & (F.col("_low") < F.col("_high")))
        split = cut(full.select(*keys, out, "_low", "_high", (2 * F.ceil(F.col("_n") / most)).alias("_parts")))
        if split.isEmpty():
            return celled
        # Halved, so that the range of a cell cannot overflow.
        place = (F.col(value) / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * F.col("_parts")
        part = F.least(F.floor(place), F.col("_parts") - 1)
        path = F.when(F.col("_parts").isNotNull(), F.array_append(out, part)).otherwise(F.col(out))
        celled = celled.join(small(split), [*keys, out], "left").withColumn("_path", path).select(*df.columns, F.col("_path").alias(out))


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums and running maxima of each key in `order`.

    `bucket` must not decrease along `order` and must be deterministic, since
    it is evaluated both for the rows and for the bucket totals.  Keys must not
    be NULL.
    """
    sums, maxima = sums or {}, maxima or {}
    names = [*sums, *maxima]
    tagged = df.withColumn("_bucket", bucket)
    for name, value in {**sums, **maxima}.items():
        tagged = tagged.withColumn(f"_in_{name}", value)

    totals = tagged.groupBy(*keys, "_bucket").agg(
        *[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_t_{n}") for n in maxima],
    )
    # One row per bucket: the window over a whole key only sees bucket totals.
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_bucket",
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxima],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = tagged.select(
        *df.columns, "_bucket",
        *[F.sum(f"_in_{n}").over(inside).alias(f"_l_{n}") for n in sums],
        *[F.max(f"_in_{n}").over(inside).alias(f"_l_{n}") for n in maxima],
    )
    # The rows are already partitioned and sorted by (keys, bucket) for the window.
    joined = local.join(carry, [*keys, "_bucket"], "left")
    return joined.select(
        *[c for c in df.columns if c not in names],
        *[
            (F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n)
            for n in sums
        ],
        *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in maxima],
    )


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rn") -> DataFrame:
    """1-based row number of each key in `order`, without one task per key."""
    return running(df, keys, bucket, order, sums={name: F.lit(1).cast("long")})


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "q") -> DataFrame:
    """Exact, linearly interpolated percentiles per key as an array column.

    First pass: rows per value cell (map-side combined, a bounded number of
    cells).  Second pass: only rows of the cells that hold a wanted rank are
    shuffled, already counted by distinct value.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    if not keys:
        keys, rows = ["_all"], rows.withColumn("_all", F.lit(0))
    rows = rows.withColumn("_cell", order_cell(F.col("_v")))

    by_key = Window.partitionBy(*keys)
    cells = (
        rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
        .withColumn("_total", F.sum("_n").over(by_key))
        .withColumn(
            "_upto",
            F.sum("_n").over(by_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)),
        )
    )
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), ((F.col("_total") - 1) * F.lit(float(p))).alias("at"))
        for i, p in enumerate(probs)
    ])
    ranked = cells.select("*", F.explode(wanted).alias("_w")).select(
        *keys, "_cell", (F.col("_upto") - F.col("_n")).alias("_skip"), "_n", "_upto",
        F.col("_w.i").alias("_i"), (F.col("_w.at") - F.floor("_w.at")).alias("_part"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.floor("_w.at").alias("r")),
            F.struct(F.lit(1).alias("side"), F.ceil("_w.at").alias("r")),
        )).alias("_s"),
    )
    targets = ranked.filter("_s.r >= _skip AND _s.r < _upto").select(
        *keys, "_cell", "_i", "_part", F.col("_s.side").alias("_side"),
        (F.col("_s.r") - F.col("_skip")).alias("_r"),
    )
    needed = targets.select(*keys, "_cell").distinct()
    counted = cut(rows.join(small(needed), [*keys, "_cell"], "left_semi").groupBy(*keys, "_cell", "_v").agg(F.count("*").alias("_n")))
    inside = running(fine_cells(counted, [*keys, "_cell"], "_v", "_fine"), [*keys, "_cell"], F.col("_fine"), [F.col("_v")], sums={"_upto": F.col("_n")})
    found = inside.join(targets, [*keys, "_cell"]).filter("_r >= _upto - _n AND _r < _upto")
    picks = []
    for i in range(len(probs)):
        low = F.max(F.when((F.col("_i") == i) & (F.col("_side") == 0), F.col("_v")))
        high = F.max(F.when((F.col("_i") == i) & (F.col("_side") == 1), F.col("_v")))
        part = F.max(F.when(F.col("_i") == i, F.col("_part")))
        picks.append(low + (high - low) * part)
    result = found.groupBy(*keys).agg(F.array(*picks).alias(out))
    return result.drop("_all")


def average_ranks(df: DataFrame, keys: list[str], value: str, weights: dict[str, Column]) -> DataFrame:
    """Collapse a table to distinct values per key with their average rank.

    `weights` are summed per distinct value (for example the positives among
    the rows) and summed up to it as `<name>_upto`.  Adds `n` (rows with the
    value), `upto` (rows up to it) and `avg_rank` (1-based).
    """
    table = cut(df.groupBy(*keys, value).agg(
        F.count("*").alias("n"), *[F.sum(w).alias(name) for name, w in weights.items()]
    ))
    ranked = running(
        fine_cells(table, keys, value), keys, F.col("_cell"), [F.col(value)],
        sums={"upto": F.col("n"), **{f"{name}_upto": F.col(name) for name in weights}},
    ).drop("_cell")
    return ranked.withColumn("avg_rank", F.col("upto") - F.col("n") / 2.0 + 0.5)


def top_rows(
    df: DataFrame,
    keys: list[str],
    score: str,
    limits: dict[str, Column],
    tie_bucket: Column,
    tie_order: list[Column],
    size: str = "group_size",
) -> DataFrame:
    """Rows of the k best scores of each key, for one or several k.

    `limits` maps a label to an expression of `size` (rows of the key) giving
    k.  The score at which each list ends is found from counts per distinct
    score; only rows tied exactly there are ranked, in `tie_order`, split by
    `tie_bucket` so that a score shared by very many rows stays parallel.
    Returns the rows with `list` (label), `k` and `group_size`.
    """
    hist = cut(df.groupBy(*keys, score).agg(F.count("*").alias("_n")).withColumn("_down", -F.col(score).cast("double")))
    cum = running(fine_cells(hist, keys, "_down"), keys, F.col("_cell"), [F.desc(score)], sums={"_upto": F.col("_n")})
    sizes = df.groupBy(*keys).agg(F.count("*").alias(size))
    lists = sizes.select(
        *keys, size,
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("list"), k.cast("long").alias("k")) for name, k in limits.items()
        ])).alias("_l"),
    ).select(*keys, size, "_l.list", "_l.k")
    ends = (
        cum.join(lists, keys)
        .filter("k > _upto - _n AND k <= _upto")
        .select(*keys, size, "list", "k", F.col(score).alias("_end"), (F.col("k") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    chosen = df.join(small(ends), keys).filter(F.col(score) >= F.col("_end"))
    clear = chosen.filter(F.col(score) > F.col("_end"))
    ties = number_rows(
        chosen.filter(F.col(score) == F.col("_end")), [*keys, "list"], tie_bucket, tie_order, "_tie"
    ).filter("_tie <= _need")
    columns = [*df.columns, "list", "k", size]
    return clear.select(*columns).unionByName(ties.select(*columns))
