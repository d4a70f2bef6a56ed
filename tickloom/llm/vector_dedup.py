"""Operator 12: near-duplicate vectors by learned binary codes, multi-index Hamming tables and exact cosines.

Fit (driver, at most `SAMPLE` vectors in the order of a hash of their id): unit vectors are centred, projected onto
their principal directions and turned by a rotation that brings them close to the corners of the cube (iterative
quantisation), which makes balanced bits that cut few near pairs.  `ROTATIONS` rotations from different starts give as
many 64-bit codes.  Each code is four substrings of 16 bits, so there are 24 tables.  A table uses the longest leading
piece of its substring for which pairs planted at exactly the threshold around the sample's vectors meet in some table
in at least `FOUND` of the cases (one half of the sample teaches, pairs are planted around the other); so data that lies in a narrow cone gets shorter keys, not fewer links.

Index (all rows): equal vectors are one class.  A class puts its codes, not its vector, into the 24 tables.  Inside a
bucket two classes are candidates if their 384 bits differ in no more places than those of any planted pair (about 60;
unrelated vectors differ in half).  Only classes with a candidate fetch their vectors, into the bucket in which the pair meets
first, and every pair there gets its cosine in double precision: what is linked is exact, and only a pair that shares
no bucket is missed.  Buckets beyond `TILE` classes are compared in tiles of two blocks.  No pairs leave a task: a tile
returns for each class how many vectors it links with and the smallest id of its part of the component.

Defined cases: vectors that are null, of zero length, or hold null or non-finite components link with nothing, nor do
rows with a null id; a shorter vector counts as followed by zeros; repeated rows are copies and link with each other;
different vectors under one id have links of their own, and groups that both name it as smallest id are one component;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.lineage import cut, small
from tickloom.llm.components import components
from tickloom.llm.vector_codes import finite, padded

SAMPLE, ROTATIONS, BITS, PIECE = 8_192, 6, 64, 16
TABLES = ROTATIONS * BITS // PIECE
#: Share of planted pairs at the threshold that must meet in a table.
FOUND = 0.99
TILE = 1_024
#: Pairs that are looked at together: this many, or as many doubles of their vectors.
PAIRS, DOUBLES = 1 << 18, 1 << 22


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    x = x / np.maximum(np.abs(x).max(1, initial=0), np.finfo(float).tiny)[:, None]
    length = np.sqrt((x * x).sum(1))
    return x / np.where(length > 0, length, 1)[:, None]


class Codes:
    """Learned codes of unit vectors and their table keys."""

    def __init__(self, sample: np.ndarray, threshold: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        # One half teaches the rotations, pairs are planted around the other.
        sample, rest = (sample[::2], sample[1::2]) if len(sample) > 1 else (sample, sample)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        directions = np.linalg.svd(centred.T @ centred)[0][:, :BITS]
        flat, size = centred @ directions, directions.shape[1]
        planes = []
        for _ in range(ROTATIONS * -(-BITS // size)):
            turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
            for _ in range(30):
                u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
                turn = (u @ v).T
            planes.append(directions @ turn)
        each = -(-BITS // size)  # short vectors: several rotations make one code
        self.planes = np.concatenate([np.concatenate(planes[i * each:(i + 1) * each], axis=1)[:, :BITS] for i in range(ROTATIONS)], axis=1)
        planted = np.tile(rest, (-(-SAMPLE // len(rest)), 1))
        near = unit(planted + self._across(planted, rng) * np.sqrt(1 / threshold**2 - 1))
        a, b = self.of(planted), self.of(near)
        self.apart = int(np.bitwise_count(a ^ b).sum(1).max())
        self.length = next((n for n in range(PIECE, 1, -1) if (self.keys(a, n) == self.keys(b, n)).any(1).mean() >= FOUND), 1)

    @staticmethod
    def _across(x: np.ndarray, rng) -> np.ndarray:
        """A random unit vector at right angles to each row."""
        other = rng.standard_normal(x.shape)
        other -= (other * x).sum(1)[:, None] * x
        return unit(other)

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, rotations) codes."""
        bits = (x - self.mean) @ self.planes >= 0
        return np.packbits(bits, axis=1).view(np.uint64).reshape(len(x), ROTATIONS)

    def keys(self, codes: np.ndarray, length: int | None = None) -> np.ndarray:
        """(rows, tables): a code's substrings without the bits beyond the key length."""
        pieces = np.ascontiguousarray(codes).view(">u2").astype(np.int64).reshape(len(codes), TABLES)
        return pieces >> (PIECE - (length or self.length))


def _encoded(codes: Codes, width: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(padded(batch.column("vector"), width)) + 0.0  # no negative zeros
            digest = [xxhash.xxh3_128_intdigest(v.tobytes()) for v in x]
            half = lambda shift: pa.array(np.array([(d >> shift) & (2**64 - 1) for d in digest], np.uint64).view(np.int64))
            code = codes.of(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), half(64), half(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["id", "d1", "d2", "code", "unit"])

    return made


def _keyed(codes: Codes):
    """Codes with their table keys; the table number stands above the key."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(-1, ROTATIONS)
            keys = codes.keys(code) + (np.arange(TABLES) << PIECE)
            offsets = pa.array(np.arange(len(code) + 1, dtype=np.int32) * TABLES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("d1"), batch.column("code"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().astype(np.int32)))],
                names=["node", "d1", "code", "keys"])

    return made


def _pairs(bucket: np.ndarray, side: np.ndarray, block: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows in one bucket, in bounded blocks; `bucket` is sorted.

    In a tile of two blocks the pairs inside a block belong to that block's own tile.
    """
    ends = np.flatnonzero(np.diff(bucket, append=bucket[-1:] + 1)) + 1
    starts = np.concatenate([[0], ends[:-1]])
    mixed = np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)
    two = np.repeat(mixed, ends - starts)
    left = np.repeat(ends, ends - starts) - np.arange(len(bucket)) - 1  # partners after each row
    row, step = np.flatnonzero(left), 1
    while len(row):
        for at in range(0, len(row), block):
            a = row[at:at + block]
            b = a + step
            good = ~two[a] | (side[a] != side[b])
            yield a[good], b[good]
        step += 1
        row = row[left[row] >= step]


def _tiles(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], binary: dict[str, tuple]) -> Iterator[dict]:
    """Rows of whole tiles, several tiles at a time; rows come sorted by key and tile."""
    held: list[dict] = []

    def rows(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        for c, (kind, width) in binary.items():
            out[c] = np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(-1, width)
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(rows(batch))
        last = held[-1]
        if (held[0]["key"][0], held[0]["tile"][0]) == (last["key"][-1], last["tile"][-1]):
            continue
        whole = {c: np.concatenate([h[c] for h in held]) for c in last}
        end = int(np.flatnonzero((whole["key"] != whole["key"][-1]) | (whole["tile"] != whole["tile"][-1]))[-1]) + 1
        yield {c: v[:end] for c, v in whole.items()}
        held = [{c: v[end:] for c, v in whole.items()}]
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


_PLACE = ("key", "tile", "side", "node", "d1")


def _bucket(rows: dict) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((np.diff(rows["key"]) != 0) | (np.diff(rows["tile"]) != 0))])


def _first_here(rows: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the tile's table is the first one in which both rows meet."""
    keys = rows["keys"]
    return (keys[a] == keys[b]).argmax(1) == rows["key"][a] >> PIECE


def _candidates(codes: Codes):
    """Rows of a tile that have a candidate whose first common table this is."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches, _PLACE, {"code": (np.uint64, ROTATIONS)}):
            rows["keys"] = codes.keys(rows["code"])
            active, code = np.zeros(len(rows["node"]), bool), rows["code"]
            for a, b in _pairs(_bucket(rows), rows["side"]):
                near = np.bitwise_count(code[a] ^ code[b]).sum(1) <= codes.apart
                a, b = a[near], b[near]
                here = _first_here(rows, a, b)
                active[a[here]] = active[b[here]] = True
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][active]) for c in _PLACE], names=list(_PLACE))

    return made


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the rows a[i] and b[i]; `root` holds each row's smallest row."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _linked(codes: Codes, threshold: float, width: int):
    """Each class of a tile with the number of vectors that it links with here and the smallest id it reaches here."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches, (*_PLACE, "copies"), {"code": (np.uint64, ROTATIONS), "unit": (np.float64, width)}):
            rows["keys"] = codes.keys(rows["code"])
            node, copies, x = rows["node"], rows["copies"], rows["unit"]
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for a, b in _pairs(_bucket(rows), rows["side"], max(1_024, DOUBLES // width)):
                here = _first_here(rows, a, b)
                a, b = a[here], b[here]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[near], b[near]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                _merge(root, a, b)
            least, some = node.copy(), links > 0
            np.minimum.at(least, root, node)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(rows["d1"][some]), pa.array(links[some]), pa.array(least[root[some]])], names=["node", "d1", "links", "low"])

    return made


def near_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    valid = F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    sound = every.filter(valid)
    kind = every.schema["id"].dataType
    sample = sound.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    if not len(sample):
        return every.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = sound.agg(F.max(F.size("vector"))).first()[0]
    codes = Codes(unit(padded(sample, width)), threshold)

    rows = cut(sound.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(_encoded(codes, width), "id long, d1 long, d2 long, code binary, unit binary"))
    least = rows.groupBy("d1", "d2").agg(F.min(F.struct("id", "code", "unit")).alias("first"), F.count("*").alias("copies"))
    classes = cut(least.select("d1", "d2", "copies", F.col("first.id").alias("node"), "first.code", "first.unit"))
    keyed = classes.select("node", "d1", "code").mapInArrow(_keyed(codes), "node long, d1 long, code binary, keys array<int>")
    members = keyed.select("node", "d1", "code", F.explode("keys").alias("key"))
    large = small(members.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > TILE))
    placed = members.join(large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int"))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("side")).cast("long") * F.col("blocks") + F.greatest(j, F.col("side")))
    placed = placed.select("key", F.explode(tiles).alias("tile"), "side", "node", "d1", "code")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(partitions, "key", "tile").sortWithinPartitions("key", "tile")
    active = cut(dealt.mapInArrow(_candidates(codes), "key int, tile long, side int, node long, d1 long"))
    fetched = active.join(classes.select("node", "d1", "copies", "code", "unit"), ["node", "d1"])
    dealt = fetched.repartition(partitions, "key", "tile").sortWithinPartitions("key", "tile")
    found = cut(dealt.mapInArrow(_linked(codes, threshold, width), "node long, d1 long, links long, low long"))

    joined = components(found.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("node", "d1").agg(F.sum("links").alias("links"))
    # Copies of one vector share a key: narrow rows, whose join adaptive execution splits.
    member = rows.select("id", "d1", "d2").join(classes.select("d1", "d2", "node", "copies"), ["d1", "d2"])
    result = member.join(links, ["node", "d1"], "left").join(joined, "node", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    alone = every.filter(~F.coalesce(valid, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return result.unionByName(alone).select(
        F.col("id").cast(kind).alias("vec_id"), "n_links", F.col("component").cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
