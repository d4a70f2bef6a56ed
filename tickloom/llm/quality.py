"""Operator 8: quality scores by compression.

Method: two zstandard dictionaries are built, from good and from bad labelled
text.  A text is compressed with each of them; the difference of both sizes per
byte becomes a probability by a logistic curve fitted on other labelled rows.

Texts are compressed in parts of 1,000 bytes, every part of every text: a long
text compressed in one go soon follows its own words, and the dictionaries stop
to matter.

Scale: the model is fitted on a bounded sample (`Fit`), so the driver never holds
more; scoring is a narrow map over the scan with two dictionaries of 110 KB.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.lineage import cut
from tickloom.llm.arrow import byte_column, in_slices, once


@dataclass(frozen=True)
class Fit:
    """Bounds of the labelled sample: rows for each dictionary, rows for the curve, bytes of a text to be in it, and bytes
    of all texts of a list (about a hundred times a dictionary, as zstandard advises): the driver holds one list at a time.
    """

    dictionary_rows: int = 2_000
    curve_rows: int = 4_000
    most_bytes: int = 100_000
    list_bytes: int = 12_000_000
    dictionary_bytes: int = 112_640
    part: int = 1_000
    level: int = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    intercept: float
    slope: float
    fit: Fit


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out, 1 to 3 fill the dictionaries, 4 fits the curve.  Null: 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(0)).cast("int")


class Sizes:
    """Bytes that a text saves per byte of its own with the good dictionary against the bad one."""

    def __init__(self, good: bytes, bad: bytes, fit: Fit):
        import zstandard

        self._part, self._press = fit.part, []
        for content in (good, bad):
            table = zstandard.ZstdCompressionDict(content)
            table.precompute_compress(level=fit.level)
            press = zstandard.ZstdCompressor(level=fit.level, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._press.append(press.compress)

    def difference(self, text: bytes) -> float:
        good, bad = self._press
        total = 0
        for i in range(0, len(text), self._part):
            part = text[i:i + self._part]
            total += len(bad(part)) - len(good(part))
        return total / (len(text) + 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton's method with a small penalty that keeps them finite."""
    center, scale = float(x.mean()), float(x.std()) or 1.0
    design, w = np.c_[np.ones(len(x)), (x - center) / scale], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + weight * np.eye(2), design.T @ (y - p) - weight * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * center / scale), float(w[1] / scale)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit: Fit = Fit()) -> Model:
    """Dictionaries and curve from labelled rows outside the held-out fold.

    The rows with the smallest hashes of their ids form the sample, whatever the order of the tables.  Null labels, null
    ids and texts above `fit.most_bytes` are not in it.  Where one class has no text, or too little for a dictionary, every
    score is the share of label 1 (0.5 without labels).
    """
    import zstandard

    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    marked = marked.withColumn("fold", fold(F.col("id"))).withColumn("h", F.xxhash64("id"))
    # More than needed: some labelled ids may have no text here or a very long one.
    take = lambda rows, n: rows.orderBy("h", "id", "y").limit(2 * n)
    chosen = take(marked.filter("fold IN (1, 2, 3) AND y = 1"), fit.dictionary_rows).unionByName(
        take(marked.filter("fold IN (1, 2, 3) AND y = 0"), fit.dictionary_rows)).unionByName(take(marked.filter("fold = 4"), fit.curve_rows))
    chosen = chosen.dropDuplicates(["id"])
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.octet_length("text").between(1, fit.most_bytes))
    # `chosen` has a fixed number of rows at most (4 x dictionary_rows + 2 x curve_rows), so it may be broadcast, and the
    # sample is written once.
    sample = cut(texts.join(F.broadcast(chosen), "id").select("id", "y", "fold", "h", "text", F.octet_length("text").alias("size")))
    sizes = sample.select("fold", "y", "h", "id", "size").collect()
    content = []
    for y in (1, 0):
        own = _list(sample, sizes, lambda r, y=y: r["fold"] != 4 and r["y"] == y, (F.col("fold") != 4) & (F.col("y") == y), fit.dictionary_rows, fit.list_bytes)
        parts = [t[i:i + fit.part] for _, t in own for i in range(0, len(t), fit.part)]
        try:
            content.append(zstandard.train_dictionary(fit.dictionary_bytes, parts).as_bytes())
        except zstandard.ZstdError:
            content.append(b"\n".join(parts)[-fit.dictionary_bytes:])
        del own, parts
    curve = _list(sample, sizes, lambda r: r["fold"] == 4, F.col("fold") == 4, fit.curve_rows, fit.list_bytes)
    y = np.array([label for label, _ in curve], float)
    share = float(y.mean()) if len(y) else 0.5
    if not content[0] or not content[1] or len(set(y)) < 2:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(content[0] or b" " * 8, content[1] or b" " * 8, math.log(share / (1 - share)), 0.0, fit)
    ratio = Sizes(*content, fit)
    return Model(*content, *_logistic(np.array([ratio.difference(t) for _, t in curve]), y), fit)


def _list(sample: DataFrame, sizes: list, mine, where: Column, rows: int, most: int) -> list[tuple[int, bytes]]:
    """(label, text) of the sample's rows with the smallest hashes, up to a number of rows and of bytes; whole texts."""
    ordered, last, total = sorted((r["h"], r["id"], r["size"]) for r in sizes if mine(r)), None, 0
    for h, i, size in ordered[:rows]:
        total += size
        if total > most:
            break
        last = (h, i)
    if last is None:
        return []
    upto = (F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("id") <= last[1]))
    found = sample.filter(where & upto).select("h", "id", "y", F.col("text").cast("binary").alias("text")).collect()
    return [(r["y"], bytes(r["text"])) for r in sorted(found, key=lambda r: (r["h"], r["id"], r["text"]))]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, keep_row: bool = False) -> DataFrame:
    """Scores of every whole text: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    `keep_row` adds all columns of `docs` as the struct `row`, whatever their names.  Null counts as empty, and an empty
    text saves no bytes: its score is the curve at 0.  Null ids count as held out.  An empty table gives an empty table.
    """
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = once(lambda: Sizes(model.good, model.bad, model.fit), "sizes", hash(model.good), hash(model.bad), model.fit)
        for batch in in_slices(batches, 512):
            x = np.array([sizes.difference(t) for t in byte_column(batch.column("text"))], float)
            values = pa.array(1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -700, 700))), pa.float64())
            kept = [batch.column(c) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, values], names=names)

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []))
    names = ["doc_id", *(["row"] if keep_row else []), "score"]
    schema = slim.drop("text").withColumn("score", F.lit(0.0)).schema
    scored = slim.mapInArrow(scores, schema)
    return scored.select("doc_id", *(["row"] if keep_row else []), (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
