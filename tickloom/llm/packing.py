"""Operator 6: documents packed into token sequences by bin completion.

Method: a branch and bound over bins.  A node takes the largest document left
and tries the undominated fillings of its bin: no document left would fit beside
them, and no document left could replace some of them and fill the bin better.
Waste so far plus the bins that the rest needs at least prunes a node, and the
best-fit solution is the first incumbent; where it meets the lower bound, which
is the usual case, it is optimal and no search runs.

Scale: texts become rows of a few numbers in the scan (one per piece).  Blocks of
pieces, dealt by a hash, are packed in parallel.  Each block hands on the pieces
of its emptiest sequence, and these are packed together in the next round, so
what is lost at block borders shrinks to one sequence.  No task holds more than a
few blocks of numbers, and nothing but counts comes to the driver.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.lineage import batches_of, cut
from tickloom.llm.arrow import TEXT_ROWS, give_back, in_slices, once

#: Pieces of a block; words that a worker remembers, some 150 bytes each: two workers share an executor with its whole heap.
BLOCK, MEMO = 4_000, 200_000
#: Bytes of texts that are taken apart at once, on average; words that are one text for the tokenizer library.
SLICE_BYTES, RUN = 2_000_000, 100
#: Steps of a block's search (lengths tried in fillings), and fillings of a node.  They set effort: a search that reaches its
#: limit keeps its best solution, which is always complete.
STEPS, FILLINGS = 100_000, 64

#: Marks that end a word and never join another token of the split pattern.
_TAIL = b".,!?;:*#%&$"
#: Stands between words that are encoded as one text; words that hold it are encoded alone.
_MARK = b"\x01"


class WordIds:
    """Token ids of texts as little-endian 32-bit numbers, for a vocabulary that drops white space between words.

    Such a vocabulary never joins text across white space, so each word is encoded once and remembered.  It lower-cases
    text, so ASCII capitals are lowered first, unless special strings, which it finds before, could come from that.
    Arrow splits the texts and numbers their distinct words; only these become Python objects.
    """

    def __init__(self, vocabulary: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        self._encode = tokenizer.encode_batch_fast
        self._special = [t["content"].lower() for t in json.loads(vocabulary)["added_tokens"]]
        self._mark = tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._limit = memo // 2

    def _encoded(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part.  Many parts are one text for the library, with a mark of one known id between them."""
        apart = [_MARK, *[s.encode() for s in self._special]] if len(self._mark) == 1 else [b""]
        together = b" ".join(parts).lower()
        alone = [x for x in parts if any(s in x.lower() for s in apart)] if any(s in together for s in apart) else []
        found = dict(zip(alone, [array("I", f.ids).tobytes() for f in self._encode([x.decode() for x in alone], add_special_tokens=False)]))
        rest = [x for x in parts if x not in found] if alone else parts
        runs = [rest[i:i + RUN] for i in range(0, len(rest), RUN)]
        between = b" " + _MARK + b" "
        for run, f in zip(runs, self._encode([between.join(run).decode() for run in runs], add_special_tokens=False)):
            ids = np.array(f.ids, "<u4")
            ends = [*np.flatnonzero(ids == self._mark[0]).tolist(), len(ids)]
            held, start = ids.tobytes(), 0
            for part, end in zip(run, ends, strict=True):
                found[part] = held[4 * start:4 * end]
                start = end + 1
        return [found[x] for x in parts]

    def _learn(self, words: list[bytes]) -> None:
        """Encode distinct words that are not in the young generation; a word and the marks at its end are encoded apart."""
        if len(self._young) > self._limit:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        whole, split = [], []
        for word in words:
            ids = old.get(word)
            if ids is not None:
                young[word] = ids
                continue
            base = word.rstrip(_TAIL)
            if len(base) == len(word) or not base or not 97 <= base[-1] <= 122:
                whole.append(word)
            else:
                split.append((word, base, word[len(base):]))
        parts = set(whole)
        parts.update([base for _, base, _ in split], [tail for _, _, tail in split])
        parts = list(parts.difference(young))
        young.update(zip(parts, self._encoded(parts)))
        young.update([(word, young[base] + young[tail]) for word, base, tail in split])

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        found = list(map(self._young.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            self._learn([words[i] for i in new])
            for i in new:
                found[i] = self._young[words[i]]
        return found

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text of a string column; null counts as empty."""
        texts = pc.fill_null(texts, "")
        lowered = pc.ascii_lower(texts)
        for s in self._special:
            lowered = pc.if_else(pc.match_substring(lowered, s, ignore_case=False), texts, lowered)
        lists = pc.ascii_split_whitespace(lowered)
        words = lists.flatten().dictionary_encode()
        # `to_numpy` makes the Python objects in one go, `to_pylist` a scalar for each.
        found = self._known(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        held = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = words.indices.to_numpy(zero_copy_only=False)
        each = size[at]
        ends = np.cumsum(each)
        # The ids of word w take the places before ends[w]; in `held` they end at the sum of the sizes up to its number.
        place = np.repeat(np.cumsum(size)[at] - ends, each)
        place += np.arange(len(place))
        every = held[place]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]].tolist()
        return [every[start:end].tobytes() for start, end in zip(bounds, bounds[1:])]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's token ids and `end_id`, cut into pieces of `capacity` ids; only the last may be shorter.

    `vocabulary` is the path of a tokenizer file, read on the driver; its size does not depend on the data.  Returns one row per piece: doc_id,
    piece (from 0), start, length, ids_crc32 and, on request, ids (little-endian 32-bit numbers).  Null text counts as
    empty: one piece that holds `end_id`.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once(lambda: WordIds(spec), "ids", hash(spec))
        # Slices of few bytes: of a word its number is held, and of an id its place among those of the distinct words.
        for batch in (part for b in batches for part in in_slices([b], max(1, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))):
            of, number, length, check, kept = [], [], [], [], []
            for i, ids in enumerate(words.ids(batch.column(1))):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k:k + 4 * capacity]
                    of.append(i)
                    number.append(k // (4 * capacity))
                    length.append(len(part) // 4)
                    check.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(np.array(number, np.int64) * capacity),
                       pa.array(length, pa.int64()), pa.array(check, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names=names)
            pa.default_memory_pool().release_unused()  # else the pool keeps what the largest slice took
        give_back()

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(pieces, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths: each length, in descending order, into the fullest bin that takes it."""
    room: list[tuple[int, int]] = []  # (room left, bin) in ascending order
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(room, (x, -1))
        if at == len(room):
            bins.append([x])
            insort(room, (capacity - x, len(bins) - 1))
        else:
            left, b = room.pop(at)
            bins[b].append(x)
            insort(room, (left - x, b))
    return bins


def fewest(lengths: list[int], capacity: int) -> int:
    """Lower bound on bins: for each k, lengths above capacity - k stand without any of at least k, and the rest by size."""
    if not lengths:
        return 0
    size = np.sort(np.asarray(lengths, np.int64))
    total = np.concatenate([[0], np.cumsum(size)])
    best = -(-int(total[-1]) // capacity)
    half = int(np.searchsorted(size, capacity // 2, "right"))  # lengths from here on take a bin each at least
    for k in {0, *size[:half].tolist()}:
        large = int(np.searchsorted(size, capacity - k, "right"))
        small = int(np.searchsorted(size, k, "left"))
        middle = int(total[max(large, half)] - total[half])
        free = (max(large, half) - half) * capacity - middle
        rest = max(0, int(total[half] - total[min(small, half)]) - free)
        best = max(best, len(size) - half + -(-rest // capacity))
    return best


def _undominated(chosen: list[int], slack: int, left: dict[int, int], sizes: list[int]) -> bool:
    """No length left over can stand for some chosen ones and fill the bin better."""
    sums = {0}
    for x in chosen:
        sums |= {s + x for s in sums}
    for s in sums:
        at = bisect_right(sizes, s)
        while at < len(sizes) and sizes[at] <= s + slack:
            if left[sizes[at]] - chosen.count(sizes[at]) > 0:
                return False
            at += 1
    return True


def _fillings(room: int, left: dict[int, int], sizes: list[int], limit: int, effort: list[int]) -> list[list[int]]:
    """Undominated sets of lengths for the room beside the largest one, the fullest first.  `effort` counts down."""
    found: list[tuple[int, list[int]]] = []
    chosen: list[int] = []
    used: dict[int, int] = {}
    stack: list[list[int]] = []  # room and next length to try; a bin may hold thousands of lengths, so no recursion

    def extend(room: int, top: int) -> None:
        end = bisect_right(sizes, room)
        fits = any(left[x] > used.get(x, 0) for x in sizes[:end])
        if not fits and (len(chosen) > 12 or _undominated(chosen, room, left, sizes)):
            found.append((room, chosen.copy()))
        stack.append([room, min(top, end) - 1 if fits else -1])

    extend(room, len(sizes))
    while stack:
        room, at = stack[-1]
        if at < 0 or len(found) >= limit or effort[0] <= 0:
            stack.pop()
            if chosen:
                used[chosen.pop()] -= 1
            continue
        effort[0] -= 1
        stack[-1][1] = at - 1
        x = sizes[at]
        if left[x] > used.get(x, 0):
            chosen.append(x)
            used[x] = used.get(x, 0) + 1
            extend(room - x, at + 1)
    found.sort(key=lambda f: f[0])
    return [f for _, f in found]


def bin_completion(lengths: list[int], capacity: int, steps: int = STEPS, fillings: int = FILLINGS) -> list[list[int]]:
    """Bins of lengths, as few as found within the search limits; never more than best fit needs."""
    best, bound = best_fit(lengths, capacity), fewest(lengths, capacity)
    if len(best) <= bound:
        return best
    left: dict[int, int] = {}
    for x in lengths:
        left[x] = left.get(x, 0) + 1
    sizes = sorted(left)
    count, total, spent = len(lengths), sum(lengths), 0
    path: list[list[int]] = []
    waste, effort = 0, [steps]

    def options() -> Iterator[list[int]]:
        largest = next(x for x in reversed(sizes) if left[x])
        left[largest] -= 1
        rest = _fillings(capacity - largest, left, sizes, fillings, effort)
        left[largest] += 1
        return iter([[largest, *f] for f in rest] or [[largest]])

    stack = [options()]
    while stack and effort[0] > 0 and len(best) > bound:
        filling = next(stack[-1], None)
        if filling is None:
            stack.pop()
            if path:
                back = path.pop()
                waste -= capacity - sum(back)
                count += len(back)
                total += sum(back)
                for x in back:
                    left[x] += 1
            continue
        spent += 1
        effort[0] -= 1
        if waste + capacity - sum(filling) > (len(best) - 1) * capacity - sum(lengths):
            continue  # a better solution cannot waste so much
        for x in filling:
            left[x] -= 1
        count, total, waste = count - len(filling), total - sum(filling), waste + capacity - sum(filling)
        path.append(filling)
        if not count:
            if len(path) < len(best):
                best = [list(b) for b in path]
            stack.append(iter(()))
        elif len(path) + -(-total // capacity) >= len(best):
            stack.append(iter(()))
        else:
            if spent % 64 == 1:  # best fit of the rest completes the path to a candidate
                rest = best_fit([x for x in sizes for _ in range(left[x])], capacity)
                if len(path) + len(rest) < len(best):
                    best = [list(b) for b in path] + rest
            stack.append(options())
    return best


def pack(pieces: DataFrame, capacity: int = 4096, block: int = BLOCK) -> DataFrame:
    """Pieces with a sequence and a place in it: adds sequence_id and offset (tokens before it in its sequence).

    Ties are packed in the order of doc_id and piece.  Repeated rows and null ids are packed like any other; which rows share
    a block follows the layout of the table.  `pieces` has the columns of
    `token_pieces`, lengths of 1 to `capacity`.  An empty table gives an empty table.
    """
    # Blocks are dealt by the number of a written row: rows of one id, or without any, spread over all of them.
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    columns, schema = numbered.columns, numbered.schema
    with batches_of(pieces.sparkSession, TEXT_ROWS):
        waiting, done, level = cut(numbered), [], 0
    while True:
        # A block hands on one sequence at most.  Two sequences of tokens for each block halve what waits in every round; as a
        # piece has a token at least, a block of short pieces averages at most 4 * capacity rows.
        size = waiting.agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        blocks = max(1, min(-(-size.rows // block), size.tokens // (2 * capacity)))
        last = blocks == 1

        def packed(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
            rows: dict[int, list[int]] = {}
            for i in range(len(group) - 1, -1, -1):
                rows.setdefault(int(group["length"][i]), []).append(i)
            bins = bin_completion(group["length"].tolist(), capacity)
            number, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
            for b, content in enumerate(bins):
                at = 0
                for x in content:
                    i = rows[x].pop()
                    number[i], offset[i], at = b, at, at + x
            emptiest = min(range(len(bins)), key=lambda b: sum(bins[b]))
            group["again"] = (number == emptiest) & (not last)
            group["sequence_id"] = level * 2**56 + group["block"].astype(np.int64) * 2**20 + number
            group["offset"] = offset
            return group[[*columns, "sequence_id", "offset", "again"]]

        dealt = waiting.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        result = cut(dealt.groupBy("block").applyInPandas(packed, f"{fields}, sequence_id bigint, offset bigint, again boolean"))
        done.append(result.filter("NOT again").drop("again", "row"))
        if last:
            break
        waiting, level = result.filter("again").select(*columns), level + 1
    for part in done[1:]:
        done[0] = done[0].unionByName(part)
    return done[0]


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole documents in as few sequences of at most `capacity` tokens as found; only longer documents are cut.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null and empty texts are one
    token (`end_id`).  Other columns are not read and so cannot clash.
    """
    return pack(token_pieces(docs, vocabulary, capacity, end_id, doc_id, text), capacity)
