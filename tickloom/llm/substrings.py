"""Operator 7: repeated passages, by Rabin-Karp hashes of every window of words.

Method: the rolling hash of every window of 50 words; equal windows are counted
in Spark, a window that also starts in a document with a smaller id is a repeat,
and the repeats of a document merge into maximal intervals of words to remove.

Most windows occur once, and shuffling all of them would move several times the
input.  So each window first names an anchor: the smallest rolling hash among its
own 16-word windows.  Equal windows have equal anchors, and neighbours mostly
share one, so anchors are few.  A window whose anchor occurs in one document only
cannot be a repeat.  Only the others are counted, by two 64-bit hashes.

Scale: a task counts the windows of many documents at once and sends only those of
the smallest document of each; all others are repeats already.  So a passage in
a third of all documents sends one row per task and window, and no group grows
with the number of its copies.  The texts are shuffled once, by id, to the
anchors that they share.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.lineage import cut
from tickloom.llm.arrow import TEXT_ROWS, byte_column, in_slices, once
from tickloom.llm.hashing import BASES, Rolling, Words, mixed, sliding_min

#: Words of an anchor; words of a text hashed at once; windows counted at once in a task.
ANCHOR, STRETCH, BLOCK = 16, 500_000, 500_000

_SPACES = re.compile(rb"[ \t\n\r\x0b\f]+")
_LAST = 2**63 - 1


class _Windows:
    """Anchors and hashes of the windows of one text, in stretches that overlap, so that a long text needs no large arrays."""

    def __init__(self, size: int):
        self.size, self._words = size, Words()
        self._anchor = Rolling(min(ANCHOR, size), BASES[0])
        self._whole = tuple(Rolling(size, b) for b in BASES)

    def stretches(self, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first window, word hashes, anchor of each window)."""
        words = text.split()
        for start in range(0, max(0, len(words) - self.size + 1), STRETCH):
            h = self._words.hashes(words[start:start + STRETCH + self.size - 1])
            yield start, h, sliding_min(mixed(self._anchor.windows(h)), self.size - self._anchor.size + 1)

    def pairs(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._whole[0].windows(h)[at], self._whole[1].windows(mixed(h))[at]


def _anchors(size: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = once(lambda: _Windows(size), "windows", size)
        for batch in in_slices(batches, 512):
            ids, keys = [], []
            for i, text in enumerate(byte_column(batch.column("text"))):
                own = [np.unique(anchor) for _, _, anchor in windows.stretches(text)]
                if own:
                    own = np.unique(np.concatenate(own))
                    ids.append(np.full(len(own), i))
                    keys.append(own)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), batch.column("doc").take(pa.array(np.concatenate(ids)))], names=["anchor", "doc"])

    return found


def _runs(positions: np.ndarray) -> np.ndarray:
    """Ascending positions as pairs (first, end) of runs of neighbours."""
    cuts = np.flatnonzero(np.diff(positions) > 1) + 1
    first = positions[np.concatenate([[0], cuts])]
    last = positions[np.concatenate([cuts - 1, [len(positions) - 1]])]
    return np.stack([first, last + 1], axis=1).astype("<i4").ravel()


def _counted(size: int):
    """Windows that share an anchor.  place >= 0: a window to be counted further; place -1: windows that are repeats."""

    def settle(h1, h2, doc, row, place) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, row, place = map(np.concatenate, (h1, h2, doc, row, place))
        order = np.lexsort((place, row, doc, h2, h1))
        h1, h2, doc, row, place = (x[order] for x in (h1, h2, doc, row, place))
        fresh = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        smallest = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        repeat = doc > smallest
        out = [[], [], [], [], [], []]
        # The rest: one line per window and row, with further places of the same window in it.
        keep = np.flatnonzero(~repeat)
        a, b, d, r, p = (x[keep] for x in (h1, h2, doc, row, place))
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (r[1:] != r[:-1])]))
        end = np.concatenate([start[1:], [len(a)]])
        more: list[bytes | None] = [None] * len(start)
        for i in np.flatnonzero(end - start > 1):
            more[i] = _runs(p[start[i] + 1:end[i]]).tobytes()
        for column, values in zip(out, (a[start], b[start], d[start], r[start], p[start])):
            column.append(values)
        gone = np.flatnonzero(repeat)
        gone = gone[np.lexsort((place[gone], row[gone]))]
        for part in np.split(gone, np.flatnonzero(np.diff(row[gone])) + 1) if len(gone) else []:
            key = np.array([row[part[0]]]).astype(np.uint64)  # dealt out by the row
            for column, values in zip(out, (mixed(key), key, doc[part[:1]], row[part[:1]], np.array([-1]))):
                column.append(values)
            more.append(_runs(np.unique(place[part])).tobytes())
        h1, h2, doc, row, place, _ = (np.concatenate(x) if x else x for x in out)
        for i in range(0, len(doc), 20_000):
            s = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int64)), pa.array(doc[s]), pa.array(row[s]), pa.array(place[s].astype(np.int32)), pa.array(more[s], pa.binary())],
                names=["h1", "h2", "doc", "row", "place", "more"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = once(lambda: _Windows(size), "windows", size)
        held, total = ([], [], [], [], []), 0
        for batch in in_slices(batches, 64):
            docs, rows = batch.column("doc").to_pylist(), batch.column("row").to_pylist()
            shared = batch.column("anchors")
            for i, text in enumerate(byte_column(batch.column("text"))):
                own = np.sort(np.asarray(shared[i].values, np.int64).view(np.uint64))
                for start, h, anchor in windows.stretches(text):
                    at = np.flatnonzero(own[np.minimum(np.searchsorted(own, anchor), len(own) - 1)] == anchor)
                    if len(at):
                        a, b = windows.pairs(h, at)
                        for column, values in zip(held, (a, b, np.full(len(at), docs[i]), np.full(len(at), rows[i]), at + start)):
                            column.append(values)
                        total += len(at)
                    if total >= BLOCK:
                        yield from settle(*held)
                        held, total = ([], [], [], [], []), 0
        if total:
            yield from settle(*held)

    return found


def _removed(count: int, places: list[int], more: list[bytes | None], size: int) -> np.ndarray:
    """Which of `count` words some repeated window covers."""
    change = np.zeros(count + 1, np.int64)
    starts = np.array([p for p in places if p >= 0], np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    pairs = np.frombuffer(b"".join(m for m in more if m), "<i4").reshape(-1, 2).astype(np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 1] + size - 1, -1)
    return np.cumsum(change[:count]) > 0


def _kept_text(text: bytes, removed: np.ndarray) -> bytes:
    """The text without the removed words and the white space behind each; all else is unchanged."""
    spaces, words = _SPACES.findall(text), text.split()
    lead = spaces.pop(0) if spaces and text[:1].isspace() else b""
    spaces += [b""] * (len(words) - len(spaces))
    return lead + b"".join([w + s for w, s, gone in zip(words, spaces, removed) if not gone])


def _results(size: int, whole: bool, spans_type: pa.DataType):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 256):
            found = batch.column("found")
            counts, gone, digests, spans, texts = [], [], [], [], []
            for i, text in enumerate(byte_column(batch.column("text"))):
                words = text.split()
                cells = found[i].as_py() if found[i].is_valid else []
                removed = _removed(len(words), [c["place"] for c in cells], [c["more"] for c in cells], size)
                counts.append(len(words))
                gone.append(int(removed.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                if whole:
                    texts.append(_kept_text(text, removed).decode() if gone[-1] else None)
                else:
                    digests.append(hashlib.sha256(b" ".join([w for w, r in zip(words, removed) if not r])).hexdigest())
            if whole:
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(texts, pa.string())], names=["kept", "new_text"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests), pa.array(spans, spans_type)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return made


def _repeats(docs: DataFrame, doc_id: str, text: str, window: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Rows whose text shares an anchor, with `found` (their repeated windows), and what tells the other rows.

    That is, with `whole`, the other rows themselves, else the ids (`doc`) of the first kind.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")] if whole else []
    base = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), *kept)
    anchors = cut(base.select("doc", "text").mapInArrow(_anchors(window), "anchor bigint, doc bigint"), TEXT_ROWS)
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("anchor")
    of_doc = anchors.join(shared, "anchor").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"))
    if whole:
        joined = cut(base.join(cut(of_doc), "doc", "left").withColumn("row", F.monotonically_increasing_id()))
        rest = joined.filter("anchors IS NULL")
        joined = joined.filter("anchors IS NOT NULL")
    else:
        of_doc = cut(of_doc)
        joined = cut(base.join(of_doc, "doc").withColumn("row", F.monotonically_increasing_id()))
        rest = of_doc.select("doc")
    counted = joined.select("doc", "row", "text", "anchors").mapInArrow(
        _counted(window), "h1 bigint, h2 bigint, doc bigint, row bigint, place int, more binary")
    # Rows of one window: one from each block of a task at most, and one for each row that repeats a doc_id.
    least = F.min("doc").over(Window.partitionBy("h1", "h2"))
    repeats = counted.withColumn("least", least).filter("place < 0 OR doc > least")
    found = repeats.groupBy("row").agg(F.collect_list(F.struct("place", "more")).alias("found"))
    return joined.drop("anchors").join(found, "row", "left"), rest


def repeated_passages(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words covered by a window of words that also starts in a document with a smaller id.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; windows are judged on the input.  Returns one row per input row: doc_id,
    n_words, n_removed, kept_sha256 (of the kept words, joined by one space) and removed (maximal intervals of word numbers,
    start inclusive, end exclusive).

    Null and empty texts have no words.  Texts shorter than a window lose none.  Rows with one doc_id are one document:
    they do not repeat each other.  A null doc_id is larger than any other.  Other columns are not read and so cannot clash.
    An empty table gives an empty table.
    """
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ])
    sharing, present = _repeats(docs, doc_id, text, window, False)
    changed = sharing.select("id", "text", "found").mapInArrow(_results(window, False, spans), schema)
    plain = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("array<struct<place:int,more:binary>>").alias("found"))
    unchanged = plain.mapInArrow(_results(window, False, spans), schema)
    alone = unchanged.join(present, F.coalesce(unchanged["doc_id"].cast("long"), F.lit(_LAST)) == present["doc"], "left_anti")
    return alone.unionByName(changed)


def remove_repeated_passages(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns of `docs`, the repeated passages cut out of `text` with the white space behind each word.

    `length`, where `docs` has it, is set to the new number of code points.  A text without repeats stays as it is, also null.
    """
    sharing, rest = _repeats(docs, doc_id, text, window, True)
    schema = T.StructType([T.StructField("kept", sharing.schema["kept"].dataType), T.StructField("new_text", T.StringType())])
    changed = sharing.select("kept", "text", "found").mapInArrow(_results(window, True, pa.null()), schema)
    parts = changed.unionByName(rest.select("kept", F.lit(None).cast("string").alias("new_text")))
    columns = []
    for c in docs.columns:
        value = F.col(f"kept.`{c}`")
        if c == text:
            value = F.coalesce(F.col("new_text"), value)
        elif c == length:
            value = F.when(F.col("new_text").isNotNull(), F.char_length("new_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return parts.select(*columns)
