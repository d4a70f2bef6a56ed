"""Operator 9 with a unigram model, written by hand piece by piece."""

import random
from array import array

import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto
from tickloom.llm.pieces import Pieces


def unigram_model(seed=4):
    rng = random.Random(seed)
    m = proto.ModelProto()
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    m.trainer_spec.byte_fallback = True
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = False, True
    kinds = proto.ModelProto.SentencePiece

    def add(piece, score, kind=kinds.NORMAL):
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind

    add("<unk>", 0, kinds.UNKNOWN)
    add("<s>", 0, kinds.CONTROL)
    add("</s>", 0, kinds.CONTROL)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, kinds.BYTE)
    seen = set()
    for length in (1, 2, 3, 4, 5):
        for _ in range(6 if length == 1 else 40):
            t = "".join(rng.choice("abcdé") for _ in range(length))
            for piece in (t, "▁" + t):
                if piece not in seen:
                    seen.add(piece)
                    add(piece, -rng.uniform(1, 4) - length * rng.uniform(0.5, 1.5))
    add("▁", -3.3)
    return m.SerializeToString()


def test_unigram_pieces_equal_the_library():
    model = unigram_model()
    library, ours = sentencepiece.SentencePieceProcessor(model_proto=model), Pieces(model, memo=400)
    rng = random.Random(9)
    texts = ["".join(rng.choice("aabbcdé  xß漢🙂") for _ in range(rng.randint(0, 40))) for _ in range(3_000)]
    texts += ["", " ", "  a", "a  ", "abcd" * 400]
    lowest = min(library.get_score(i) for i in range(259, library.vocab_size()))

    def total(ids):
        """Sum of scores; a character that is no piece counts once, at its first byte."""
        first = lambda i: not 0x80 <= int(library.id_to_piece(i)[3:5], 16) < 0xC0
        return sum((lowest - 10) * first(i) if library.is_byte(i) else library.get_score(i) for i in ids)

    same = 0
    for t, ids in zip(texts, ours.encode(texts)):
        mine, theirs = array("I", ids).tolist(), library.encode(t)
        same += mine == theirs
        # other pieces only where both ways have one sum
        assert abs(total(mine) - total(theirs)) <= 1e-5 * (1 + abs(total(theirs))), repr(t)
        assert ours.decode(ids) == library.decode(theirs)
    assert same >= 0.75 * len(texts), same / len(texts)


def merge_model():
    """A model of merges whose pieces overlap, so that the longest piece is often not the library's."""
    rng = random.Random(11)
    m = proto.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = proto.TrainerSpec.BPE, True
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = False, True
    kinds = proto.ModelProto.SentencePiece
    listed = [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL)]
    listed += [(f"<0x{b:02X}>", 0, kinds.BYTE) for b in range(256)]
    known, made = ["▁", *"abcé"], []
    while len(made) < 120:
        piece = rng.choice(known) + rng.choice(known)
        if piece not in known and "▁" not in piece[1:] and len(piece) < 9:
            known.append(piece)
            made.append(piece)
    listed += [(p, -i, kinds.NORMAL) for i, p in enumerate(made)] + [(c, -len(made) - i, kinds.NORMAL) for i, c in enumerate("▁abcé")]
    for piece, score, kind in listed:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    return m.SerializeToString()


def test_merged_pieces_equal_the_library():
    model = merge_model()
    library, ours = sentencepiece.SentencePieceProcessor(model_proto=model), Pieces(model, memo=400)
    assert ours._merges
    rng = random.Random(2)
    texts = ["".join(rng.choice("aabbccé x漢") for _ in range(rng.randint(0, 60))) for _ in range(3_000)] + ["", " ", "  a", "abcé" * 300]
    for t, ids in zip(texts, ours.encode(texts)):
        assert array("I", ids).tolist() == library.encode(t), repr(t)
