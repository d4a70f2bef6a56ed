"""Operator 1: token counts of a byte-level BPE vocabulary.

Method: a heap of adjacent pairs over a linked list of symbols.  The pair of
lowest rank is popped, its two symbols become one, and the two pairs beside it
enter the heap.  Only merges are counted: tokens = initial symbols - merges, and
no identifier is ever made.

A text is cut where a single space stands between two characters that are not
white space (and at a single line end between such characters).  The split
pattern of the vocabulary has a boundary at each of these places, whatever
stands around, so each part is counted on its own and remembered: texts repeat
words.  Parts and words already seen cost one dictionary lookup.

Scale: a narrow map over the scan; no shuffle, no state beyond two bounded memos.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrow import BoundedCache, in_slices, once

#: Entries that a worker remembers for parts of texts and for words.
MEMO = 600_000

#: An optional space, Latin letters, then marks: always two words of the split pattern, so the pattern need not run.
_EASY = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@{-~]*)")


def byte_marks() -> dict[int, int]:
    """The printable character that a byte-level vocabulary writes for each byte, mapped back to the byte.

    The rule of that file format: printable Latin-1 characters stand for themselves, all others follow from U+0100.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {x: x for x in own} | {0x100 + i: b for i, b in enumerate(sorted(set(range(256)) - set(own)))}


class Counter:
    """Counts tokens as the library does for a byte-level BPE file (JSON text of a tokenizer)."""

    def __init__(self, vocabulary: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        marks = byte_marks()
        self._marks = marks
        number: dict[str, int] = {}  # of a symbol, inside the merging only
        self._start = [number.setdefault(chr(b), len(number)) for b in range(256)]
        self._rank, self._made = {}, []
        for pair in spec["model"]["merges"]:
            left, right = (x.translate(marks) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b = (number.setdefault(x, len(number)) for x in (left, right))
            self._rank[a << 20 | b] = len(self._made)
            self._made.append(number.setdefault(left + right, len(number)))
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._split = Tokenizer.from_str(vocabulary).pre_tokenizer.pre_tokenize_str
        self._word = BoundedCache(self._merged, memo)
        self._part = BoundedCache(self._count_part, memo)
        self._line_end = self._plain("\n")

    def _merged(self, word: bytes) -> int:
        """Symbols left of one word when no pair can merge any more."""
        rank, made, size = self._rank.get, self._made, len(word)
        symbol = list(map(self._start.__getitem__, word))
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # An entry holds rank and place in one number: the lowest rank comes first, of equal ranks the leftmost.
        ranks = map(rank, [a << 20 | b for a, b in zip(symbol, symbol[1:])])
        heap = [r << 32 | i for i, r in enumerate(ranks) if r is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        merges = 0
        while heap:
            entry = pop(heap)
            i, lowest = entry & 0xFFFFFFFF, entry >> 32
            left, j = symbol[i], after[i]
            if left < 0 or j >= size or rank(left << 20 | symbol[j]) != lowest:
                continue  # one of the two has merged with another symbol meanwhile
            joined, k, h = made[lowest], after[j], before[i]
            symbol[i], symbol[j], after[i] = joined, -1, k
            merges += 1
            if k < size:
                before[k] = i
                r = rank(joined << 20 | symbol[k])
                if r is not None:
                    push(heap, r << 32 | i)
            if h >= 0:
                r = rank(symbol[h] << 20 | joined)
                if r is not None:
                    push(heap, r << 32 | h)
        return size - merges

    def _plain(self, part: str) -> int:
        word, marks = self._word, self._marks
        return sum([word[w.translate(marks).encode("latin-1")] for w, _ in self._split(part)])

    def _count_part(self, part: str) -> int:
        """Tokens of a part that neither ends in white space nor starts with any but one space; -1: it does."""
        easy = _EASY.fullmatch(part)
        if easy:
            letters, signs = easy.groups()
            if not signs:
                return self._merged(letters.encode())
            return self._part[letters] + self._word[signs.encode()]
        body = part[1:] if part[:1] == " " else part
        if not body or body[0].isspace() or body[-1].isspace():
            return -1
        return self.whole(part)

    def whole(self, text: str) -> int:
        """Tokens of any text, without remembering parts.  Special strings count one each, where they stand."""
        total = 0
        while text:
            hits = [(text.find(s), s) for s in self._special if s in text]
            if not hits:
                return total + self._plain(text)
            at, special = min(hits)
            total += self._plain(text[:at]) + 1
            text = text[at + len(special):]
        return total

    def count(self, text: str) -> int:
        lines = text.split("\n")
        if len(lines) > 1 and all([x and not x[0].isspace() and not x[-1].isspace() for x in lines]):
            return sum(map(self._count_line, lines)) + self._line_end * (len(lines) - 1)
        return self._count_line(text) if text else 0

    def _count_line(self, text: str) -> int:
        first, *rest = text.split(" ")
        parts = [first, *[" " + x for x in rest]]
        counts = list(map(self._part.__getitem__, parts))
        if min(counts) >= 0:
            return sum(counts)
        # White space stands beside a space: parts around it belong together.
        total, held = 0, ""
        for i, (part, n) in enumerate(zip(parts, counts)):
            held += part
            following = parts[i + 1] if i + 1 < len(parts) else None
            if following is None or (held and not held[-1].isspace() and len(following) > 1 and not following[1].isspace()):
                total += n if held == part and n >= 0 else self.whole(held)
                held = ""
        return total


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text.

    `vocabulary` is the path of a byte-level BPE tokenizer file.  It is read on the driver and travels with the job (its
    size does not depend on the data), so executors need no such file.  Returns one row per input row:
    doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens.  Null ids and repeated rows are counted like any other row.  Other
    columns of `docs` are not read and so cannot clash.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(lambda: Counter(spec), "counter", hash(spec))
        for batch in in_slices(batches, 512):
            column = batch.column(1)
            tokens = [counter.count(x or "") for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).cast(pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    counted = slim.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
