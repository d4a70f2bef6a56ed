"""Operator 9: SentencePiece encoding and decoding, by a shared-prefix Viterbi pass.

Method: the distinct marked words of a batch (a word with the marks for the
spaces before it) are sorted, which lays them out as a depth-first walk of their
trie.  The forward table of a word holds, for each prefix, the best way to end
there; a word keeps the part of the table that its common prefix with the word
before it has filled, and computes the rest.

What "best" means depends on the kind of model.  Unigram models: the largest sum
of scores (where two ways have exactly one sum, the library's choice hangs on how it
rounds sums over the whole text; here the longer last piece stays).  BPE models, such as the vocabulary used here, have no such sum: a sum
of merge ranks would give other pieces than the library.  There, the encoding of
a prefix ends in the only piece that stays apart from the piece before it when
both are merged together, and the encoding before that piece is again that of a
prefix.  So one forward table by prefixes gives the library's pieces for both.

Characters without a piece become byte pieces.  Decoding joins pieces and bytes.

Scale: a narrow map over the scan, with a bounded memo of words.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrow import in_slices, once

#: Words and pairs of pieces that a worker remembers; longest word that shares its table (longer ones are encoded alone).
MEMO, LONGEST = 600_000, 200
MARK = "▁"
_TWO = (2,)


class Pieces:
    """Encoder and decoder of a model (its bytes) whose normaliser changes nothing but spaces and whose pieces hold marks at their start only."""

    def __init__(self, model: bytes, memo: int = MEMO):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.vocab_size()
        self._text = [library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self._id = {self._text[i]: i for i in plain}
        self._score = {self._text[i]: library.get_score(i) for i in plain}
        self._byte = {int(self._text[i][1:-1], 16): i for i in range(n) if library.is_byte(i)}
        self._bytes = [bytes([int(t[1:-1], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else t.replace(MARK, " ").encode() for i, t in enumerate(self._text)]
        self._limit, self._young, self._old = memo // 2, {}, {}
        self._apart: dict[tuple[str, str], bool] = {}
        # A model of merges scores its pieces by their order, in whole numbers.
        self._merges = all(s == int(s) and s <= 0 for s in self._score.values())
        # The library's score of a character that is no piece: 10 below the lowest score (fixed value).
        self._unknown = min(self._score.values(), default=0.0) - 10
        # Lengths of pieces by their last two characters, the longest first.  A piece that merging never makes is none.
        by_end: dict[str, set[int]] = {}
        for t in list(self._id):
            if self._merges and self._merged(list(t)) != [t]:
                del self._id[t]
            elif len(t) > 1:
                by_end.setdefault(t[-2:], set()).add(len(t))
        self._lengths = {e: sorted(n, reverse=True) for e, n in by_end.items()}
        # For merges: lengths by the last three characters, so that few of them are tried in vain.
        by_three: dict[str, set[int]] = {}
        for t in self._id:
            if len(t) > 2:
                by_three.setdefault(t[-3:], {2} if t[-2:] in self._id else set()).add(len(t))
        self._lengths_by_three = {e: sorted(n, reverse=True) for e, n in by_three.items()}

    def _merged(self, symbols: list[str]) -> list[str]:
        """Merging from the definition: the best-scored neighbours first, of equal ones the leftmost."""
        symbols, score = list(symbols), self._score.get
        scores = [score(a + b, -inf) for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = max(scores)
            if best == -inf:
                break
            at = scores.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del scores[at]  # only the pairs beside the new symbol change
            if at:
                scores[at - 1] = score(symbols[at - 1] + symbols[at], -inf)
            if at < len(scores):
                scores[at] = score(symbols[at] + symbols[at + 1], -inf)
        return symbols

    def _stay_apart(self, left: str, right: str) -> bool:
        """Merging the characters of both pieces together ends in these two pieces."""
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) > MEMO:
                self._apart.clear()
            known = self._apart[left, right] = self._merged(list(left + right)) == [left, right]
        return known

    def _extend(self, word: str, end: list[str], total: list[float], start: int) -> None:
        """Fill the forward table from prefix length start + 1 on: end[j] is the last piece of the best way to word[:j]."""
        if self._merges:
            self._extend_merges(word, end, start)
            return
        ids, lengths = self._id, self._lengths
        for j in range(start + 1, len(word) + 1):
            chosen, best = word[j - 1], -inf  # a character without a piece stands alone
            alone = total[j - 1] + self._score.get(chosen, self._unknown)
            for size in lengths.get(word[max(0, j - 2):j], ()):
                if size > j:
                    continue
                i = j - size
                piece = word[i:j]
                if piece not in ids:
                    continue
                if total[i] + self._score[piece] > best:
                    chosen, best = piece, total[i] + self._score[piece]
            if alone > best:  # of equal sums the longer last piece stays
                chosen, best = word[j - 1], alone
            end.append(chosen)
            total.append(best)

    def _extend_merges(self, word: str, end: list[str], start: int) -> None:
        """The same for a model of merges, whose table needs no sums: the longest last piece that stays apart."""
        ids, by_three, known, add = self._id, self._lengths_by_three, self._apart.get, end.append
        for j in range(start + 1, len(word) + 1):
            chosen = word[j - 1]  # a character without a piece stands alone
            for size in by_three.get(word[j - 3:j], _TWO) if j > 2 else _TWO:
                if size > j:
                    continue
                i = j - size
                piece = word[i:j]
                if piece in ids:
                    if i == 0:
                        chosen = piece
                        break
                    left = end[i]
                    apart = known((left, piece))
                    if apart or (apart is None and self._stay_apart(left, piece)):
                        chosen = piece
                        break
            add(chosen)

    def _packed(self, pieces: list[str]) -> bytes:
        try:
            return array("I", [self._id[p] for p in pieces]).tobytes()
        except KeyError:  # a character without a piece
            out = array("I")
        for p in pieces:
            i = self._id.get(p)
            if i is not None:
                out.append(i)
            else:
                out.extend(self._byte[b] for b in p.encode())
        return out.tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self._young) > self._limit:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        new = words.difference(young)
        back = old.keys() & new
        young.update(zip(back, map(old.__getitem__, back)))
        before, end, total = "", [""], [0.0]
        for word in sorted(new - back):
            if len(word) > LONGEST and self._merges:
                young[word] = self._packed(self._merged_long(word))
                continue
            common = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                common += 1
            del end[common + 1:], total[common + 1:]  # a model of merges fills no sums
            self._extend(word, end, total, common)
            pieces, at = [], len(word)
            while at:
                pieces.append(end[at])
                at -= len(end[at])
            young[word], before = self._packed(pieces[::-1]), word

    def _merged_long(self, word: str) -> list[str]:
        """A very long word by the same table, not shared with others."""
        end, total = [""], [0.0]
        self._extend(word, end, total, 0)
        pieces, at = [], len(word)
        while at:
            pieces.append(end[at])
            at -= len(end[at])
        return pieces[::-1]

    @staticmethod
    def words(text: str) -> list[str]:
        """Marked words: marks are pieces' starts only, so no piece spans the place before a mark that follows another character."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        parts = marked.split(MARK)[1:]  # every word has lost its own mark; empty ones are further marks
        if "" not in parts:
            return [MARK + p for p in parts]
        out, run = [], MARK
        for p in parts[:-1]:
            if p:
                out.append(run + p)
                run = MARK
            else:
                run += MARK
        out.append(run + parts[-1])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers."""
        lists = [self.words(t) for t in texts]
        self._learn(set().union(*lists))
        return [b"".join(map(self._young.__getitem__, words)) for words in lists]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes joined, without the space that encoding puts first."""
        joined = b"".join(map(self._bytes.__getitem__, array("I", ids)))
        return joined.decode("utf-8", "replace")[1:] if joined[:1] == b" " else joined.decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Piece ids of every whole text, and the text that they decode to.

    `model` is the path of a SentencePiece model, read on the driver; its size does not depend on the data.  Returns one row per input row: doc_id,
    n_pieces, ids_crc32 (unsigned, of little-endian 32-bit ids), decoded_crc32 (of UTF-8), same (decoding gives the text
    back; a mark character in a text comes back as a space) and, on request, ids and decoded.

    Null counts as empty: no pieces.  Null ids and repeated rows are rows like any other; other columns are not read and so
    cannot clash.  An empty table gives an empty table.
    """
    with open(model, "rb") as file:
        content = file.read()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = once(lambda: Pieces(content), "pieces", hash(content))
        for batch in in_slices(batches, 128):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = pieces.encode(texts)
            decoded = [pieces.decode(i) for i in ids]
            columns = [
                batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()), pa.array([d == t for d, t in zip(decoded, texts)]),
            ]
            if with_ids:
                columns += [pa.array([array("I", i).tolist() for i in ids], pa.list_(pa.int32())), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "same"] + ["ids", "decoded"] * with_ids
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(coded, f"doc_id {kind}, n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, same boolean" + ", ids array<int>, decoded string" * with_ids)
