"""Operator 12 against all pairs, with awkward rows."""

import math

import numpy as np

from tickloom.llm import vector_dedup
from tickloom.llm.vector_dedup import Codes, near_vectors, unit

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, code string, side string"


def plain(rows, threshold=0.95):
    """(n_links, component) by row number of sound rows."""
    width = max((len(v) for _, v in rows if v), default=1)
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([list(rows[k][1]) + [0.0] * (width - len(rows[k][1])) for k in sound]).reshape(len(sound), width)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    parent = list(range(len(sound)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    least = {}
    for n, k in enumerate(sound):
        least[find(n)] = min(least.get(find(n), rows[k][0]), rows[k][0])
    return {rows[k][0]: (int(near[n].sum()), least[find(n)]) for n, k in enumerate(sound)}


def made(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], SCHEMA)


def cloud(rng, centre, n, spread):
    x = centre + rng.standard_normal((n, len(centre))) * spread / math.sqrt(len(centre))
    return x.astype(np.float32)


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 64)  # large buckets meet in tiles of two blocks
    rng = np.random.default_rng(4)
    base = unit(rng.standard_normal((40, 32)))
    x = [unit(rng.standard_normal((400, 32))).astype(np.float32), cloud(rng, base[0], 300, 0.15), *[cloud(rng, b, 12, 0.2) for b in base[1:]]]
    x = np.concatenate([*x, np.repeat(x[0][:1], 200, axis=0), x[0][1:5] * 3])
    rows = [(int(i) * 3 + 2, v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    odd = [(None, rows[0][1]), (5_001, None), (5_004, [None] * 32), (5_007, [float("nan")] * 32), (5_010, [0.0] * 32), (5_013, []), (5_016, [0.5] * 3), (5_019, [1.0] * 3), (5_022, [1e30] * 32)]
    got = near_vectors(made(spark, rows + odd).repartition(6)).collect()
    want = plain([(r.vec_id, r.embedding) for r in made(spark, rows + odd).collect()])
    assert len(got) == len(rows) + len(odd)
    for r in got:
        links, component = want.get(r.vec_id, (0, r.vec_id))
        assert r.component_id == component and r.kept == (r.vec_id == component or r.vec_id is None), r
    found, there = sum(r.n_links for r in got), sum(n for n, _ in want.values())
    assert all(r.n_links <= want.get(r.vec_id, (0, 0))[0] for r in got)
    assert there > 100_000 and found >= 0.999 * there


def test_repeated_rows_and_empty(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    got = near_vectors(made(spark, [(3, v), (3, v), (9, v), (4, w), (8, w), (8, v)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(3, 3, 3), (3, 3, 3), (4, 1, 4), (8, 1, 4), (8, 3, 3), (9, 3, 3)]
    assert near_vectors(made(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors(made(spark, [(1, None), (2, [0.0])])).collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_at_the_threshold():
    """New pairs at exactly the threshold meet in a table, also where all vectors lie in a narrow cone or are short."""
    rng = np.random.default_rng(8)
    for x in (rng.standard_normal((4_000, 64)), rng.standard_normal((4_000, 64)) * 0.5 + 1, rng.standard_normal((4_000, 200)), rng.standard_normal((4_000, 5))):
        x = unit(x)
        codes = Codes(x[:2_000], 0.95)
        rest = x[2_000:]
        near = unit(rest + Codes._across(rest, rng) * math.sqrt(1 / 0.95**2 - 1))
        a, b = codes.of(rest), codes.of(near)
        met = (codes.keys(a) == codes.keys(b)).any(1)
        close = np.bitwise_count(a ^ b).sum(1) <= codes.apart
        assert (met & close).mean() >= 0.97, (x.shape, codes.length)
