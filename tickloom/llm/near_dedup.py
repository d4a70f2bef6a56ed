"""Operator 10: near-duplicates by MinHash bands, odd sketches and exact confirmation.

Method: 128 MinHash samples of a document's shingles give 32 band keys of four
samples each.  A pair at similarity 0.8 shares no band with probability
(1 - 0.8^4)^32 = 5e-8.  The samples are also folded into an odd sketch, a bitmap
of 256 parities; the population count of two sketches' XOR estimates their
similarity with a standard error of about 0.04 near 0.8, and pairs estimated
below 0.6 are not looked at further.  Every link is confirmed on full sets.

Documents with equal sets are one class, and only its smallest id is compared.
Components need some links of a group, not all pairs, so links are sought in
rounds.  First every class meets the smallest id of its buckets; then, twice,
the likeliest partner in another component; at last every pair that still lies
in one bucket and in two components, in the tile of the first bucket that both
share: there the full sets lie side by side, the likeliest pair comes first, pairs
that links have joined meanwhile are skipped, and only links leave the task.  So a
link is missed only if band keys or sketch miss it, and no pairs are listed.

Scale: signatures are made in the scan.  What is shuffled is a band key and an id
per class and band, once, and then only buckets with two classes or more; texts
of documents in such buckets are shuffled once, by id.  Buckets beyond a tile's
number of classes are compared in tiles of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.lineage import batches_of, cut
from tickloom.llm.arrow import TEXT_ROWS, byte_column, in_slices, once
from tickloom.llm.components import components, counted, merge_join
from tickloom.llm.hashing import Rolling, Words, mixed

SAMPLES, BANDS, BITS = 128, 32, 256
#: Similarity that a sketch must estimate for a pair at a threshold of 0.8: five standard errors less.
MARGIN = 0.2
#: Classes of a block, when sketches and when full sets are compared.
TILE, SET_TILE = 1_024, 256
#: Rows of an Arrow batch with full sets.
SET_ROWS = 256


class Shingles:
    """Sets of shingle hashes, MinHash samples, band keys and odd sketches."""

    def __init__(self, size: int):
        self.size, self._words = size, Words()
        self._rolling = {k: Rolling(k, 0x9E3779B97F4A7C15) for k in range(1, size + 1)}
        draw = np.random.default_rng(20)
        self._times = draw.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._plus = draw.integers(0, 2**63, SAMPLES, dtype=np.uint64)
        self._salt = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64))

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes.  With fewer words than a shingle has, the whole sequence counts as one."""
        h = self._words.hashes(text.lower().split())  # bytes.lower() changes A-Z only
        if not len(h):
            return h
        k = min(self.size, len(h))
        return np.unique(mixed(self._rolling[k].windows(h) + np.uint64(k)))

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(SAMPLES, 2**64 - 1, np.uint64)
        for i in range(0, len(shingles), 2_048):
            least = np.minimum(least, (shingles[i:i + 2_048, None] * self._times + self._plus).min(axis=0))
        return least

    def bands(self, samples: np.ndarray) -> np.ndarray:
        """Keys of each band, with the band in them; one row per document."""
        rows = samples.reshape(-1, BANDS, SAMPLES // BANDS)
        key = np.broadcast_to(self._salt[:BANDS], rows.shape[:2])
        for j in range(rows.shape[2]):
            key = mixed(key ^ rows[:, :, j]) + np.uint64(j)
        return key

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        """256 parities in four numbers: sample i with its value flips one bit."""
        bit = mixed(samples ^ self._salt) % np.uint64(BITS)
        parity = np.zeros((len(samples), BITS), np.uint8)
        np.add.at(parity, (np.arange(len(samples))[:, None], bit.astype(np.int64)), 1)
        return np.packbits(parity & 1, axis=1).view(np.uint64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of every sketch in `a` (rows) to every sketch in `b` (columns)."""
    apart = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        apart += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    share = np.maximum(1 - 2 * apart / BITS, 1 / BITS)
    return 1 + BITS / (4 * SAMPLES) * np.log(share)


def _signatures(size: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = once(lambda: Shingles(size), "shingles", size)
        for batch in in_slices(batches, 512):
            sets = [shingles.of(t) for t in byte_column(batch.column("text"))]
            samples = np.array([shingles.samples(s) for s in sets], np.uint64).reshape(-1, SAMPLES)
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            half = lambda shift: pa.array(np.array([(d >> shift) & (2**64 - 1) for d in digests], np.uint64).view(np.int64))
            keys = shingles.bands(samples).view(np.int64).ravel()
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            sketch = shingles.sketches(samples)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), half(64), half(0), pa.ListArray.from_arrays(ends, pa.array(keys)),
                 pa.array([s.tobytes() for s in sketch], pa.binary())],
                names=["id", "n", "d1", "d2", "bands", "sketch"])

    return made


def _sets(size: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = once(lambda: Shingles(size), "shingles", size)
        for batch in in_slices(batches, 512):
            sets = [shingles.of(t).tobytes() for t in byte_column(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return made


def _likeliness(rows: dict, percent: int) -> np.ndarray:
    """Estimated similarity of each pair of a tile; -1 for pairs that need no look."""
    comp, n, side = rows["component"], rows["n"], rows["side"]
    likely = estimated(rows["sketch"], rows["sketch"])
    likely[comp[:, None] == comp[None, :]] = -1
    likely[100 * np.minimum(n[:, None], n[None, :]) < percent * np.maximum(n[:, None], n[None, :])] = -1
    if (side != side[0]).any():  # a tile of two blocks: pairs inside a block belong to that block's own tile
        likely[side[:, None] == side[None, :]] = -1
    return likely


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _partners(rows: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each class of a tile with its likeliest partner in another component."""
    likely = _likeliness(rows, percent)
    b = likely.argmax(axis=1)
    a = np.flatnonzero(likely[np.arange(len(b)), b] >= percent / 100 - MARGIN)
    b, node = b[a], rows["node"]
    return np.maximum(node[a], node[b]), np.minimum(node[a], node[b])


def _joined(rows: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between components of a tile, confirmed on full sets; one for each pair of components that meet."""
    likely = _likeliness(rows, percent)
    a, b = np.nonzero(np.triu(likely >= percent / 100 - MARGIN, 1))
    if not len(a):
        return a, b
    bands = rows["bands"]
    first = (bands[a] == bands[b]).argmax(axis=1)
    own = np.flatnonzero(bands[a, first] == rows["key"][0])  # other pairs meet in another bucket
    own = own[np.argsort(-likely[a[own], b[own]], kind="stable")]
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    parent: dict[int, int] = {}

    def find(c: int) -> int:
        while c in parent:
            c = parent[c]
        return c

    comp, found = rows["component"].tolist(), []
    for i, j in zip(a[own].tolist(), b[own].tolist()):
        x, y = find(comp[i]), find(comp[j])
        if x != y and _similar(sets[i], sets[j], percent):
            parent[max(x, y)] = min(x, y)
            found.append((i, j))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    node = rows["node"]
    return np.maximum(node[a], node[b]), np.minimum(node[a], node[b])


def _in_tiles(compare, percent: int):
    """Pairs (a, b) that `compare` finds in each tile; rows come sorted by key and tile."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def columns(batch: pa.RecordBatch) -> dict:
            out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tile", "side", "node", "component", "n")}
            out["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, BITS // 64)
            if "bands" in batch.schema.names:
                out["bands"] = np.array(batch.column("bands").flatten(), np.int64).reshape(batch.num_rows, BANDS)
                out["shingles"] = np.array([*batch.column("shingles").to_pylist(), None], object)[:-1]
            return out

        def settle(rows: dict, end: int) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((np.diff(rows["key"][:end]) != 0) | (np.diff(rows["tile"][:end]) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, end]):
                own = {c: v[i:j] for c, v in rows.items()}
                if j - i > 1 and (own["component"] != own["component"][0]).any():
                    a, b = compare(own, percent)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(columns(batch))
            if (held[0]["key"][0], held[0]["tile"][0]) == (held[-1]["key"][-1], held[-1]["tile"][-1]):
                continue
            rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            last = (rows["key"] != rows["key"][-1]) | (rows["tile"] != rows["tile"][-1])
            end = int(np.flatnonzero(last)[-1]) + 1  # the last tile may go on in the next batch
            yield from settle(rows, end)
            held = [{c: v[end:] for c, v in rows.items()}]
        if held:
            rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            yield from settle(rows, len(rows["node"]))

    return found


def _confirmed(percent: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 512):
            good = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                good.append(_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return made


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(_confirmed(percent), "a bigint, b bigint")


def _merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after new links between nodes."""
    ends = merge_join(links, of.withColumnRenamed("node", "a").withColumnRenamed("component", "ca"), "a")
    ends = merge_join(ends, of.withColumnRenamed("node", "b").withColumnRenamed("component", "cb"), "b")
    return _moved(of, components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))


def _moved(of: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, component) after components have become part of others."""
    moved = joined.filter("node <> component").select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut(merge_join(of, moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, a set holds the distinct shingles of `words` words, or the whole
    sequence as one where a text has fewer.  Returns one row per input row: doc_id, n_shingles (size of the set),
    component_id (smallest doc_id reachable, itself included), kept (doc_id = component_id).

    Null, empty and blank texts have empty sets and are linked with nothing.  Rows with one doc_id are one document whose
    links are those of all its rows.  A null doc_id is linked with nothing: component_id is null and the row is kept.
    `doc_id` is an integer column.  Other columns are not read and so cannot clash.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = cut(slim.mapInArrow(_signatures(words), "id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"), TEXT_ROWS)
    linked = signed.filter("n > 0 AND id IS NOT NULL")
    classes = cut(linked.groupBy("d1", "d2").agg(F.min("id").alias("node"), F.min_by("sketch", "id").alias("sketch"), F.min("n").alias("n"), F.min_by("bands", "id").alias("bands")))
    banded = classes.select(F.explode("bands").alias("key"), "node")
    buckets = banded.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1")
    members = cut(merge_join(banded, buckets, "key"))
    of = cut(members.select("node").distinct().withColumn("component", F.col("node")))
    features = cut(merge_join(classes.select("node", "sketch", "n", "bands"), of.select("node"), "node"))
    sets = cut(slim.join(of.select(F.col("node").alias("id")), "id").select(F.col("id").alias("node"), "text").mapInArrow(_sets(words), "node bigint, shingles binary"), TEXT_ROWS)

    star = members.filter("node <> first").groupBy("node").agg(F.min("first").alias("b")).select(F.col("node").alias("a"), "b")
    of = _moved(of, components(_links(star, sets, percent)))  # every node is its own component so far
    for last in (False, False, True):
        placed = merge_join(members.select("key", "node", "size"), of, "node")
        # Buckets that still have two components; larger ones in tiles of two blocks, all of whose pairs meet once.
        split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
        blocks = F.ceil(F.col("size") / (SET_TILE if last else TILE)).cast("int")
        open_ = merge_join(placed, split, "key").withColumn("blocks", blocks)
        open_ = open_.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
        tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("side")).cast("long") * F.col("blocks") + F.greatest(j, F.col("side")))
        open_ = merge_join(open_.withColumn("tile", F.explode(tiles)).select("key", "tile", "side", "node", "component"), features if last else features.drop("bands"), "node")
        open_ = open_.join(sets, "node") if last else open_
        dealt = open_.repartition(partitions, "key", "tile").sortWithinPartitions("key", "tile", "node")
        found = dealt.mapInArrow(_in_tiles(_joined if last else _partners, percent), "a bigint, b bigint")
        if last:
            with batches_of(spark, SET_ROWS):
                links, many = counted(found)
        else:
            links, many = counted(_links(found.distinct(), sets, percent))
        if many:
            of = _merged(of, links)

    grouped = merge_join(classes.select("d1", "d2", "node"), of, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    rows = signed.select("id", "n", "d1", "d2")
    # Copies of one text share a key here: narrow rows, whose join adaptive execution splits.
    result = merge_join(rows.filter("n > 0 AND id IS NOT NULL"), grouped, ["d1", "d2"]).select("id", "n", "component")
    alone = rows.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    kind: T.DataType = docs.schema[doc_id].dataType
    return result.unionByName(alone).select(
        F.col("id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the rows that `near_duplicates` keeps: one document of each component, those with null ids included."""
    gone = cut(near_duplicates(docs, words, percent, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
