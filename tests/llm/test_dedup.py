"""Operators 3, 7 and 10 against plain versions, with awkward rows."""

import brute
from tickloom.llm.components import components
from tickloom.llm.exact_dedup import drop_exact_duplicates, exact_groups
from tickloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from tickloom.llm.substrings import remove_repeated_passages, repeated_passages


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_groups(docs, rows):
    # 13 partitions: the group of 33 copies lies across several borders
    got, want = by_id(exact_groups(docs, partitions=13)), brute.exact(rows)
    assert {i: (r.keep_id, r.group_size, r.text_sha256) for i, r in got.items()} == want
    assert all(r.kept == (r.keep_id == i) for i, r in got.items())


def test_exact_group_over_whole_partitions(spark):
    made = [(i, "same  text" if i % 10 else f"own {i}") for i in range(400)] + [(999, "same text")]
    got = by_id(exact_groups(spark.createDataFrame(made, "doc_id bigint, text string"), partitions=40))
    assert {i: (r.keep_id, r.group_size, r.text_sha256) for i, r in got.items()} == brute.exact(made)


def test_exact_rows_kept_whole(docs, rows, empty, odd_ids):
    kept = drop_exact_duplicates(docs, partitions=13)
    assert kept.schema == docs.schema
    want = {k for k, _, _ in brute.exact(rows).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert drop_exact_duplicates(empty).count() == 0 and exact_groups(empty).count() == 0
    odd = exact_groups(odd_ids).collect()
    assert len(odd) == odd_ids.count() and sum(r.kept for r in odd) == 5
    assert {r.keep_id for r in odd if r.group_size == 3} == {7, 5}
    assert drop_exact_duplicates(odd_ids).count() == 5


def test_repeated_passages(docs, rows, empty, odd_ids):
    got, want = by_id(repeated_passages(docs)), brute.repeats(rows, 50)
    assert len(got) == len(rows) == docs.count()
    for i, (w, gone) in want.items():
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), brute.digest([x for x, g in zip(w, gone) if not g])), i
        assert [k for s in r.removed for k in range(s.start, s.end)] == [k for k, g in enumerate(gone) if g]
    assert sum(sum(g) for _, g in want.values()) > 5_000
    assert repeated_passages(empty).count() == 0
    odd = repeated_passages(odd_ids).collect()
    assert len(odd) == odd_ids.count()
    # rows of one id do not repeat each other, a null id comes after all
    assert sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in odd if r.n_words >= 80) == [(False, 5, 0), (False, 9, 80), (False, 9, 80), (True, None, 80)]


def test_texts_without_repeated_passages(docs, rows, empty):
    out = remove_repeated_passages(docs)
    assert out.schema.names == docs.schema.names
    want = brute.repeats(rows, 50)
    original = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        w, gone = want[r.doc_id]
        if any(gone):
            assert brute.words(r.text) == [x for x, g in zip(w, gone) if not g] and r.n_chars == len(r.text)
        else:
            assert r.text == original[r.doc_id]
    assert remove_repeated_passages(empty).count() == 0


def test_near_duplicates(docs, rows, empty, odd_ids):
    got, want = by_id(near_duplicates(docs, words=4)), brute.components(rows, 4, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert near_duplicates(empty).count() == 0
    odd = near_duplicates(odd_ids).collect()
    assert len(odd) == odd_ids.count()
    assert {(r.doc_id, r.component_id, r.kept) for r in odd} == {(None, None, True), (7, 7, True), (5, 5, True), (9, 5, False)}


def test_near_duplicates_dropped(docs, rows, empty):
    kept = drop_near_duplicates(docs, words=5)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute.components(rows, 5, 80).items() if i == c)
    assert drop_near_duplicates(empty).count() == 0


def test_chain_of_near_copies_is_one_component(spark):
    # each text differs from the next by a little, the first from the last by much
    words = [f"w{i}" for i in range(120)]
    made = [(i + 1, " ".join(f"n{k}" if k < 3 * i else w for k, w in enumerate(words))) for i in range(40)]
    got = by_id(near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string")))
    assert {i: r.component_id for i, r in got.items()} == {i: c for i, (_, c) in brute.components(made, 4, 80).items()}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(1000, 900), (900, 950)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 301)}, 1000: 900, 900: 900, 950: 900}
