"""Operator 13: product-quantised vector codes, learned by Lloyd rounds over cover trees.

Every component x becomes the integer floor(256 x); a vector is cut into 16 equal parts and each part position has a
codebook of 64 entries.  The trees are built once: a task turns each chunk of its rows into one cover tree per part
(a node covers its points within a radius, its first point is its centre and the centre of its first child, and the
centres of its children lie further apart than half that radius, which covers theirs).  Points are stored in the order
of the tree, so a subtree is a range and its sum is the difference of two cumulative sums.

A round reads the written trees.  At a node of radius R the nearest entry at distance d wins the whole subtree if all
others are further than d + 2 R (triangle inequality); entries further than that are out for the subtree; nodes that
stay ambiguous hand the rest to their children, and leaves are compared point by point in integers, ties to the lower
index.  Only 64 sums and counts a part leave a task; Spark adds them up, and the driver sees 1,024 rows a round.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped; a vector shorter than the
longest counts as followed by zeros, and so do all if the length is no multiple of 16 (zeros change no distance); ties of
vec_id for the 64 first rows go by vector, null ids come last; repeated rows each get their row; null labels are one
label; fewer than 64 rows give a codebook of as many entries; an empty table gives an empty result.  Components beyond
2^19 in size (2^27 after scaling) raise an error, since squared distances would not fit into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.lineage import cut, small
from tickloom.llm.arrow import in_slices

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of one tree, and points below which a node is a leaf.
CHUNK, LEAF = 4_096, 8
LARGEST = 2**27


def finite(vector) -> F.Column:
    """Whether a vector column is there and holds neither null nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def padded(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles; short rows end in zeros."""
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def scaled(column: pa.ListArray, width: int) -> np.ndarray:
    x = np.floor(padded(column, width) * SCALE)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
    return x.astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    before = np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.arange(size.sum()) + np.repeat(start - before, size)


class Forest:
    """Cover trees over the rows of `points` (parts, rows, width of a part), all parts side by side."""

    FIELDS = ("order", "start", "stop", "reach", "child", "children")

    def __init__(self, points: np.ndarray, grown: dict[str, np.ndarray] | None = None):
        self.parts, self.rows, self.width = points.shape
        self.points = points.reshape(-1, self.width)
        if grown is None:
            self._grow()
        else:
            self.__dict__.update(grown)

    def _grow(self) -> None:
        order, points = np.arange(self.parts * self.rows), self.points
        start = np.arange(self.parts) * self.rows
        stop, levels, known = start + self.rows, [], self.parts
        while True:
            size = stop - start
            owner = np.repeat(np.arange(len(start)), size)
            position = _ranges(start, size)
            item = order[position]
            away = ((points[item] - points[order[start]][owner]) ** 2).sum(1)
            reach = np.maximum.reduceat(away, np.concatenate([[0], np.cumsum(size)[:-1]]))
            inner = (size > LEAF) & (reach > 0)
            levels.append([start, stop, reach, np.full(len(start), -1), np.zeros(len(start), np.int64)])
            if not inner.any():
                break
            open_ = inner[owner]
            owner, position, item = owner[open_], position[open_], item[open_]
            group, rest, turn = np.zeros(len(item), np.int64), np.arange(len(item)), 0
            while len(rest):  # the first point left in each node is the next child's centre
                own = owner[rest]
                first = np.concatenate([[True], own[1:] != own[:-1]])
                centre = item[rest[first]][np.cumsum(first) - 1]
                near = 4 * ((points[item[rest]] - points[centre]) ** 2).sum(1) <= reach[own]
                group[rest[near]] = turn
                rest, turn = rest[~near], turn + 1
            sort = np.lexsort((group, owner))
            order[position] = item[sort]
            owner, group = owner[sort], group[sort]
            head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])]))
            of = owner[head]
            levels[-1][4] = np.bincount(of, minlength=len(size))
            levels[-1][3][inner] = known + np.concatenate([[0], np.cumsum(levels[-1][4][inner])[:-1]])
            known += len(head)
            start = position[head]
            stop = start + np.diff(np.concatenate([head, [len(owner)]]))
        self.order = order
        self.start, self.stop, self.reach, self.child, self.children = (np.concatenate(x) for x in zip(*levels))

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of each part's codebook (parts, entries, width) for every point, with counts and sums by entry.

        Points are in the order of `points`; whole subtrees are counted by their cumulative sums.
        """
        parts, many, width = entries.shape
        cumulative = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(self.points[self.order], axis=0)])
        code = np.zeros(len(self.order), np.uint8)
        count, total = np.zeros(parts * many, np.int64), np.zeros((parts * many, width), np.int64)
        node, open_ = np.arange(parts), np.ones((parts, many), bool)
        while len(node):
            below, masks = [], []
            for at in range(0, len(node), CHUNK):
                own, mask = node[at:at + CHUNK], open_[at:at + CHUNK]
                start, part = self.start[own], self.start[own] // self.rows
                best, close = self._nearest(self.order[start], part, entries, mask, self.reach[own])
                done = (close.sum(1) == 1) | (self.reach[own] == 0)
                size = self.stop[own] - start
                code[_ranges(start[done], size[done])] = np.repeat(best[done], size[done])
                slot = part[done] * many + best[done]
                np.add.at(count, slot, size[done])
                np.add.at(total, slot, cumulative[self.stop[own][done]] - cumulative[start[done]])
                leaf = ~done & (self.child[own] < 0)
                for point, part_of, of in self._points(own[leaf], part[leaf], close[leaf]):
                    best, _ = self._nearest(self.order[point], part_of, entries, of, 0)
                    code[point] = best
                    np.add.at(count, part_of * many + best, 1)
                    np.add.at(total, part_of * many + best, self.points[self.order[point]])
                inner = ~done & ~leaf
                below.append(_ranges(self.child[own[inner]], self.children[own[inner]]))
                masks.append(np.repeat(close[inner], self.children[own[inner]], axis=0))
            node, open_ = np.concatenate(below), np.concatenate(masks)
        by_point = np.empty_like(code)
        by_point[self.order] = code
        return by_point.reshape(self.parts, self.rows), count.reshape(parts, many), total.reshape(parts, many, width)

    def _points(self, leaves: np.ndarray, part: np.ndarray, close: np.ndarray):
        size = self.stop[leaves] - self.start[leaves]
        point, of = _ranges(self.start[leaves], size), np.repeat(np.arange(len(leaves)), size)
        for at in range(0, len(point), CHUNK):
            own = of[at:at + CHUNK]
            yield point[at:at + CHUNK], part[own], close[own]

    def _nearest(self, item, part, entries, mask, reach) -> tuple[np.ndarray, np.ndarray]:
        """Lowest index of the nearest entry in `mask`, and the entries that can win anywhere within the square root of `reach`."""
        away = ((self.points[item][:, None, :] - entries[part]) ** 2).sum(2)
        away[~mask] = np.iinfo(np.int64).max
        best = away.argmin(1)
        distance = np.sqrt(away)
        limit = distance[np.arange(len(best)), best] + 2 * np.sqrt(reach)
        return best, mask & (distance <= (limit * (1 + 1e-9) + 1e-6)[:, None])


def _trees(width: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, CHUNK):
            x = scaled(batch.column("vector"), width)
            forest = Forest(np.ascontiguousarray(x.reshape(len(x), PARTS, -1).swapaxes(0, 1)))
            one = pa.array([0, len(x)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(one, batch.column("id")), pa.ListArray.from_arrays(one, batch.column("label")), pa.array([x.astype(np.int32).tobytes()], pa.binary())]
                + [pa.array([getattr(forest, f).tobytes()], pa.binary()) for f in Forest.FIELDS],
                names=["ids", "labels", "points", *Forest.FIELDS])

    return made


def _forests(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Forest]]:
    for row in in_slices(batches, 1):
        x = np.frombuffer(row.column("points")[0].as_py(), np.int32).astype(np.int64).reshape(-1, width)
        grown = {f: np.frombuffer(row.column(f)[0].as_py(), np.int64) for f in Forest.FIELDS}
        yield row, x, Forest(np.ascontiguousarray(x.reshape(len(x), PARTS, -1).swapaxes(0, 1)), grown)


def _sums(width: int, entries: np.ndarray):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, 0
        for _, _, forest in _forests(batches, width):
            _, n, s = forest.assign(entries)
            count, total = count + n, total + s
        if isinstance(count, np.ndarray):
            part, entry = np.nonzero(count)
            sums = total[part, entry]
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * sums.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))],
                names=["part", "entry", "n", "sums"])

    return made


def _codes(width: int, entries: np.ndarray):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, forest in _forests(batches, width):
            code, _, _ = forest.assign(entries)
            error = ((forest.points.reshape(PARTS, len(x), -1) - entries[np.arange(PARTS)[:, None], code]) ** 2).sum((0, 2))
            text = np.ascontiguousarray(code.T).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [row.column("ids").flatten(), row.column("labels").flatten(), pa.array([text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error)],
                names=["id", "label", "code", "error"])

    return made


def learn_codebooks(trees: DataFrame, start: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width of a part) after Lloyd rounds over the written trees; unused entries stay."""
    entries, each = start.copy(), width // PARTS
    for _ in range(rounds):
        sums = trees.select("points", *Forest.FIELDS).mapInArrow(_sums(width, entries), "part int, entry int, n long, sums array<long>")
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(each)])
        for r in found.collect():  # at most one row for each part and entry
            entries[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(each)]
    return entries


def compress_vectors(vectors: DataFrame, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error and codebooks_sha256."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(finite(F.col("vector")))
    kind = {f.name: f.dataType for f in kept.schema}
    out = T.StructType([T.StructField("vec_id", kind["id"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], out)
    width = max(1, -(-longest // PARTS)) * PARTS
    names = ", ".join([f"ids array<{kind['id'].simpleString()}>, labels array<{kind['label'].simpleString()}>, points binary", *[f"{f} binary" for f in Forest.FIELDS]])
    trees = cut(kept.mapInArrow(_trees(width), names))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow().column("vector").combine_chunks()
    start = scaled(first, width).reshape(len(first), PARTS, -1).swapaxes(0, 1)
    entries = learn_codebooks(trees, np.ascontiguousarray(start), width, rounds)
    coded = cut(trees.mapInArrow(_codes(width, entries), T.StructType([T.StructField("id", kind["id"]), T.StructField("label", kind["label"]), *out.fields[1:3]])))
    by_label = small(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["same"])).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
