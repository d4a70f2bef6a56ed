"""Operator 13 against a plain version, with awkward rows."""

import hashlib
import math
import random

from tickloom.llm.vector_codes import Forest, compress_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, id string, error string"


def plain(rows, width, parts=16, many=64, rounds=2):
    rows = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    each = width // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))[:many]
    cut = lambda v, p: v[p * each:(p + 1) * each]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((gap(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in rows:
                own.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [(i, [near(cut(v, p), books[p]) for p in range(parts)], c) for i, v, c in rows]
    errors = {}
    for _, f, c in found:
        errors[c] = errors.get(c, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    return sorted([(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[c], digest) for i, f, c in found], key=order)


def made(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", "y", "z") for i, v, c in rows], SCHEMA)


def found(df):
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()], key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def as_float(spark, rows):
    """What a float column makes of the numbers."""
    return [(r.vec_id, r.embedding, r.label) for r in made(spark, rows).collect()]


def test_codes_equal_plain_lloyd(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 900, [rng.gauss(0, 0.3) for _ in range(32)], rng.choice([0, 1, 2, None])) for i in range(700)]
    rows += [(2_000 + i, rows[5][1], 1) for i in range(300)]  # one vector holds a third of the rows
    rows += [(3_000, None, 1), (3_001, [None] * 32, 1), (3_002, [float("nan")] * 32, 1), (3_003, [float("inf")] + [0.0] * 31, 1)]
    rows += [(None, [0.1] * 32, 2), (4_000, [0.5] * 32, None), (4_000, [0.5] * 32, None), (4_001, [0.25], 0), (4_002, [], 0)]
    df = made(spark, rows).repartition(5)
    got = found(compress_vectors(df))
    assert got == plain(as_float(spark, rows), 32) and len(got) == 1_005


def test_few_rows_and_none(spark):
    rows = [(5, [0.5, -0.5, 0.25], 1), (4, [-0.001, 0.0, 3.0], 1)]
    assert found(compress_vectors(made(spark, rows))) == plain(as_float(spark, rows), 16)
    assert compress_vectors(made(spark, [])).count() == 0
    assert compress_vectors(made(spark, [(1, None, 1)])).count() == 0
    assert compress_vectors(made(spark, [(1, [], 1)])).first().code == "00" * 16


def test_tree_invariants():
    import numpy as np

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-300, 300, (2, 500, 4)), np.zeros((2, 300, 4), np.int64)], axis=1)
    f = Forest(points)
    assert sorted(f.order.tolist()) == list(range(1_600))
    for node in range(len(f.start)):
        own = f.points[f.order[f.start[node]:f.stop[node]]]
        assert ((own - own[0]) ** 2).sum(1).max() == f.reach[node]
        if f.child[node] >= 0:
            kids = range(f.child[node], f.child[node] + f.children[node])
            assert [f.start[k] for k in kids] + [f.stop[node]] == [f.start[node]] + [f.stop[k] for k in kids]
            assert all(4 * f.reach[k] <= f.reach[node] for k in kids)
            centres = np.array([f.points[f.order[f.start[k]]] for k in kids])
            gaps = ((centres[:, None] - centres[None, :]) ** 2).sum(2) + np.eye(len(centres), dtype=int) * 10**9
            assert 4 * gaps.min() > f.reach[node]
    whole = points.reshape(-1, 4)
    entries = np.stack([points[0, :64], points[1, :64]])
    code, count, total = f.assign(entries)
    away = ((points[:, :, None, :] - entries[:, None]) ** 2).sum(3)
    assert (code == away.argmin(2)).all() and count.sum() == 1_600 and (total.sum((0, 1)) == whole.sum(0)).all()
