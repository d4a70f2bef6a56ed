"""Operators 2, 4, 5 and 8, and the pipeline."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F
from tickloom.llm import fingerprints as fp
from tickloom.llm.license_texts import KNOWN
from tickloom.llm.licenses import canonical, known_licenses, scan_licenses
from tickloom.llm.quality import Fit, score, train
from tickloom.llm.sharding import assign_shards, difference


def test_fingerprints(docs, rows, empty, odd_ids):
    got = {r.doc_id: r for r in fp.fingerprints(docs, bucket_rows=20).collect()}
    ordered = sorted(rows)
    of_text = defaultdict(set)
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(t) // 4
        edited = t[:len(t) - k] + n[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        of_text[t].add(got[i].fingerprint)
        if edited == t:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1
    assert all(len(x) == 1 for x in of_text.values())
    assert fp.fingerprints(empty).count() == 0 and fp.fingerprints(odd_ids, bucket_rows=2).count() == odd_ids.count()


def test_fingerprints_are_homomorphic(spark):
    lines = ["first line. It goes on", "second", "third one here!", "second"]
    one = lambda *x: fp.fingerprint(F.lit("\n".join(x)))
    row = spark.range(1).select(
        (one(*lines) == one(*reversed(lines))).alias("order"),
        (fp.combined(one(*lines[:2]), one(*lines[2:])) == one(*lines)).alias("insert"),
        (fp.without(one(*lines), one(lines[2])) == one("second", "first line. It goes on", "second")).alias("delete"),
        (one("second") != one("second", "second")).alias("multiset"),
        (fp.without(one("x"), one("x")) == fp.fingerprint(F.lit(None).cast("string"))).alias("zero"),
    ).first()
    assert all(row)


def test_fingerprint_likeness_ranks_edits(spark, sf):
    made = fp.fingerprints(spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 800"))
    share, near = made.agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("double")), F.avg("near_edited")).first()
    assert share > 0.97 and 0.5 < near < 0.95


def test_difference_beats_greedy_and_keeps_sums():
    rng = random.Random(1)
    sizes = [rng.randint(1, 10_000) for _ in range(500)]
    places = difference([(s, 0, 0, 0) for s in sizes])
    sums = [0] * 4
    for s, p in zip(sizes, places):
        assert sorted(p) == [0, 1, 2, 3]
        sums[p[0]] += s
    assert max(sums) - min(sums) <= 20
    assert difference([]) == [] and difference([(5, 3)]) in ([(0, 1)], [(1, 0)])
    # two partitions of 4, 5, 6, 7, 8: differencing leaves a spread of 2
    sums = [0, 0]
    for s, p in zip((4, 5, 6, 7, 8), difference([(s, 0) for s in (4, 5, 6, 7, 8)])):
        sums[p[0]] += s
    assert abs(sums[0] - sums[1]) == 2


@pytest.mark.parametrize("block", [100_000, 15])
def test_shards(docs, rows, empty, odd_ids, block):
    got = assign_shards(docs, shards=4, block=block).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    groups, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        groups[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 600  # the larger half of all texts has 500 bytes and more
    assert assign_shards(empty).count() == 0 and assign_shards(odd_ids).count() == odd_ids.count()


def test_license_scan(spark, empty, odd_ids):
    mit = KNOWN["MIT"]
    made = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.replace(" ", "\n").upper()), (2, mit.replace("sublicense", "sub-license") + "\nAll rights reserved."),
        (3, mit + " and more"), (4, None), (5, "..."), (6, "Released under the MIT Licence"), (7, KNOWN["ISC"]), (7, KNOWN["ISC"]), (None, KNOWN["0BSD"]),
    ]
    got = [(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(made, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "MIT-notice"), (7, "ISC"), (7, "ISC"), (None, "0BSD")], key=str)
    own = known_licenses(spark, {"b": "Some text", "a": "some  TEXT!", "none": "?"})
    assert scan_licenses(spark.createDataFrame([(1, "some text."), (2, "!")], "doc_id bigint, text string"), own).select("license").collect() == [("a",), (None,)]
    assert scan_licenses(empty).count() == 0 and scan_licenses(odd_ids).count() == odd_ids.count()
    forms = known_licenses(spark).select(canonical(F.col("text")).alias("f"))
    assert forms.distinct().count() == forms.count() == len(KNOWN)


def test_quality_held_out(spark, sf):
    # sf0.01 has enough labels for a held-out figure
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = score(docs, train(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert len(got) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93
    folds = score(docs, train(docs, labels)).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in folds)


def test_quality_awkward(spark, docs, empty, odd_ids):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in score(docs, train(docs, none)).select("score").collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(0, 300)] + [(None, 1), (4, None)], "doc_id bigint, quality int")
    model = train(docs, some, fit=Fit(dictionary_rows=50, curve_rows=50, dictionary_bytes=4_096))
    got = score(docs, model, keep_row=True)
    assert got.count() == docs.count() and got.select("row.*").schema == docs.schema
    assert score(empty, model).count() == 0 and score(odd_ids, model).count() == odd_ids.count()


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "quality" else dict(start)
        from tickloom.functions.lineage import cut

        docs = cut(stage(spark, docs, sf))
        if name != "packing":
            assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        rows = list(before.items())
        if name == "exact":
            assert set(kept[name]) == {k for k, _, _ in brute.exact(rows).values()}
        elif name == "near":
            assert set(kept[name]) == {i for i, (_, c) in brute.components(rows, 5, 80).items() if i == c}
        elif name == "substrings":
            want = brute.repeats(rows, 50)
            assert {i: brute.words(t) for i, t in kept[name].items()} == {i: [w for w, g in zip(ws, gone) if not g] for i, (ws, gone) in want.items()}
        elif name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, _ in start if labels.get(i) == 1]
    assert sum(i in kept["quality"] for i in good) / len(good) > 0.97


def test_license_titles_marks_and_full_texts(spark):
    from tickloom.llm.license_full import FULL

    bullets = KNOWN["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    made = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + KNOWN["MIT"]), ("ISC", "ISC License\n\n" + KNOWN["ISC"]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + KNOWN["BSD-3-Clause"]),
        ("BSD-3-Clause", bullets), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bullets), (None, "MIT License\n\n" + KNOWN["ISC"]),
        *((name, " ".join(text.upper().split(" "))) for name, text in FULL.items()),
    ]
    got = scan_licenses(spark.createDataFrame(made, "doc_id string, text string")).collect()
    assert len(got) == len(made) and all(r.license == r.doc_id for r in got)
