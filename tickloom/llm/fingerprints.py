"""Operator 2: document fingerprints by a homomorphic multiset hash.  DataFrame functions only.

Method: every paragraph (line) is hashed to a wide vector, and the vectors of a
text are added lane by lane modulo 2^30.  The order of paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its
vector (`combined`, `without`).

A vector has three parts: counts; 16 lanes of 30 bits hashed from the whole
paragraph, which decide equality; and 64 lanes of small numbers hashed from the
paragraph's pieces (sentences, or 96 characters where none ends).  The sums of
these small numbers, less their mean, keep inner products: their cosine estimates
the share of common pieces, with a standard error of about 1/8.

Two lanes share one 64-bit number, each below a guard bit, so that one addition
and one mask add two lanes and nothing overflows.

Scale: fingerprints are made in the scan.  Finding the next document shuffles
every row once, by a bucket of its id: buckets start at ids sampled as quantiles,
and the first row of each bucket is also given to the bucket before.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LANE = 2**30 - 1
_MASK = _LANE | _LANE << 31  # two lanes
_GUARD = 1 << 30 | 1 << 61
_SMALL = 15 | 15 << 31
WHOLE, PIECES = 8, 32  # numbers, of two lanes each, for paragraphs and for pieces
WIDTH = 1 + WHOLE + PIECES

#: Rows of a bucket when looking for the next document, and the most buckets (numbers that the driver holds).
BUCKET_ROWS, BUCKETS = 500, 20_000


def _sum(units: Column, vector, width: int) -> Column:
    zero = F.array_repeat(F.lit(0).cast("long"), width)
    return F.aggregate(units, zero, lambda acc, u: F.zip_with(acc, vector(u), lambda a, b: (a + b).bitwiseAND(F.lit(_MASK))))


def fingerprint(text: Column) -> Column:
    """The vector of a text as array<bigint>.  Null and empty texts, and texts of line ends only, have the zero vector."""
    whole = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(whole, "\n"), lambda p: p != "")
    pieces = F.regexp_extract_all(whole, F.lit(r"([^\n.!?]{1,96}[.!?]*|[.!?]+)"), F.lit(1))
    count = F.shiftleft(F.size(pieces).cast("long").bitwiseAND(F.lit(_LANE)), 31).bitwiseOR(F.size(paragraphs).cast("long").bitwiseAND(F.lit(_LANE)))
    hashed = lambda n, mask, salt: lambda u: F.array(*[F.xxhash64(u, F.lit(salt + i)).bitwiseAND(F.lit(mask)) for i in range(n)])
    return F.concat(F.array(count), _sum(paragraphs, hashed(WHOLE, _MASK, 1000), WHOLE), _sum(pieces, hashed(PIECES, _SMALL, 0), PIECES))


def combined(a: Column, b: Column) -> Column:
    """The vector of both texts' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MASK)))


def without(a: Column, b: Column) -> Column:
    """The vector of a's paragraphs less b's, which must be among them."""
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(F.lit(_GUARD)) - y).bitwiseAND(F.lit(_MASK)))


def as_text(vector: Column) -> Column:
    """Lowercase hexadecimal digits, 16 for each number."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _pieces_of(vector: Column) -> Column:
    return F.shiftrightunsigned(F.element_at(vector, 1), 31).cast("double")


def _inner(a: Column, b: Column) -> Column:
    mean_a, mean_b = _pieces_of(a) * 7.5, _pieces_of(b) * 7.5
    low = lambda x: x.bitwiseAND(F.lit(_LANE))
    high = lambda x: F.shiftrightunsigned(x, 31)
    products = F.zip_with(
        F.slice(a, 2 + WHOLE, PIECES), F.slice(b, 2 + WHOLE, PIECES),
        lambda x, y: (low(x) - mean_a) * (low(y) - mean_b) + (high(x) - mean_a) * (high(y) - mean_b),
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common pieces, 0 to 1; 1 for equal vectors, 0 where only one of them is zero."""
    size = F.sqrt(_inner(a, a) * _inner(b, b))
    cosine = F.when(size > 0, _inner(a, b) / F.nullif(size, F.lit(0.0))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def _bucket(doc_id: Column, starts: list) -> Column:
    """Number of the last start that is not above the id, by a coarse and a fine look; null ids belong to the last."""
    if len(starts) < 2:
        return F.lit(0)
    width = math.isqrt(len(starts)) + 1
    every = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")
    coarse = F.from_json(F.lit(json.dumps(starts[::width])), "array<bigint>")
    below = F.greatest(F.size(F.filter(coarse, lambda x: x <= doc_id)), F.lit(1)) - 1
    fine = F.size(F.filter(F.slice(every, below * width + 1, width), lambda x: x <= doc_id))
    return F.when(doc_id.isNull(), len(starts) - 1).otherwise(F.greatest(below * width + fine - 1, F.lit(0)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every whole text, of its edited text and the likeness to that and to the next document.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending doc_id; after the last comes the first, and a single document is its own next one.  Returns one
    row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next.

    Null text counts as empty.  Equal ids follow each other in the order of length and digest; null ids come last.  Other
    columns are not read and so cannot clash.  `doc_id` is an integer column.  An empty table gives an empty table.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, = slim.agg(F.count("*")).first()
    # Numbers on the driver: one per bucket, BUCKETS at most; beyond that buckets hold more rows and their sort spills.
    n = max(1, min(BUCKETS, -(-rows // bucket_rows)))
    first, cuts = slim.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()
    starts = [] if first is None else sorted({int(first), *([int(x) for x in cuts] if n > 1 else [])})
    bucket = _bucket(F.col("doc_id"), starts)
    placed = slim.withColumn("bucket", bucket).withColumn("vector", fingerprint(F.col("text")))
    opens = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(starts or [0])), "array<bigint>"), F.col("bucket") + 1) == F.col("doc_id"), F.lit(False))
    before = F.pmod(F.col("bucket") - 1, F.lit(max(1, len(starts))))
    spread = placed.withColumn("at", F.explode(F.when(
        opens, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ahead")), F.struct(before.alias("bucket"), F.lit(True).alias("ahead"))),
    ).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ahead"))))))
    spread = spread.select("doc_id", "text", "vector", "at.*", F.char_length("text").cast("long").alias("n_chars"))
    order = Window.partitionBy("bucket").orderBy("ahead", F.col("doc_id").asc_nulls_last(), "n_chars", F.sha2(F.col("text").cast("binary"), 256))
    following = spread.withColumn("next", F.lead(F.struct("text", "vector")).over(order)).filter("NOT ahead")
    k = F.floor(F.col("n_chars") / 4)
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"), F.coalesce(F.expr("left(next.text, cast(floor(n_chars / 4) as int))"), F.lit("")))
    made = following.select("doc_id", "n_chars", "vector", F.col("next.vector").alias("next"), F.when(k > 0, edited).otherwise(F.col("text")).alias("edited"))
    made = made.withColumn("edited_vector", fingerprint(F.col("edited")))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"), likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        F.coalesce(likeness(F.col("vector"), F.col("next")), F.lit(0.0)).alias("near_next"),
    )
