"""Operator 11: how far the term frequencies of each source lie from those of the others and of its language.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  A language keeps the terms that occur in at
least 30 of its documents.  A (language, source) group and the language itself give each kept term the smoothed share
p = 1 + floor(10^9 (count + 5) / (N + 5 V)); f = |p - q|.

Method: a group's terms are stored as bitsets by count.  Kept terms are numbered within their language and cut into
blocks of 64, so a bitset is a row of words, one for each block in which the count occurs.  For two groups the AND of
two words and its population count give the number of terms of a joint cell (count here, count there), which is
multiplied by f; cells with a zero on one side or on both follow as the complement of what the other words cover.
All is integer arithmetic.

Scale: a task counts the terms of its documents in memory of bounded size, and Spark adds the partial counts up; after
that rows are (language, source, term), not words.  Groups meet block by block; beyond `TILE` groups a language is
compared in tiles of two sets of groups.  Sums of a tile leave a task once for each run of its blocks.  Lists of the 50
largest terms are cut before their shuffle.

Defined cases: null text, language and source count as empty; every group that occurs gives pairs, also without terms
(with no kept terms in its language all values are 0); rows count as documents, also with null or repeated ids; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.lineage import cut, small
from tickloom.functions.prefix import number_rows
from tickloom.llm.arrow import byte_column, in_slices

LEAST_DOCUMENTS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Distinct (group, term) entries that a task holds before it hands them on, bytes of a text that are split at once.
ENTRIES, SLICE = 300_000, 1 << 20
#: Groups on a side of a tile.
TILE = 64

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_in(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    start = 0
    while start < len(text):
        end = start + SLICE
        while end < len(text) and _LETTERS[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_LETTERS).split()
        start = end


def _counted(entries: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences and documents of each term by group; a null term for each group that occurs."""
        count: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}

        def handed() -> pa.RecordBatch:
            rows = [(lang, source, term, n, documents[lang, source][term]) for (lang, source), own in count.items() for term, n in own.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in count]
            columns = list(zip(*rows))
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[2] = arrays[2].cast(pa.string())
            count.clear()
            documents.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "documents"])

        for batch in in_slices(batches, 256):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), byte_column(batch.column("text"))):
                own = count.setdefault((lang, source), Counter())
                seen: set[bytes] = set()
                for terms in terms_in(text):
                    own.update(terms)
                    seen.update(terms)
                documents.setdefault((lang, source), Counter()).update(seen)
            if sum(map(len, count.values())) >= entries:
                yield handed()
        if count:
            yield handed()

    return made


def _share(count: str, total: str, terms: str) -> F.Column:
    """p of a count, exact beyond the range of a long."""
    return F.expr(f"1 + (CAST({count} + {PRIOR} AS DECIMAL(20, 0)) * {SCALE}) div ({total} + {PRIOR} * {terms})")


def _distances(size_of_tile: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of f over the blocks of a tile for each pair of groups; rows come sorted by language, tile, block and group."""
        sums: dict[tuple[int, int], int] = {}
        names = ("left", "right", "block", "group", "width", "p", "bits", "n")
        held: list[dict] = []
        tile = None

        def handed() -> pa.RecordBatch:
            rows = [(tile[0], g, h, v) for (g, h), v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["lang", "g", "h", "value"])

        def add(rows: dict) -> None:
            group, zero = rows["group"], rows["n"] == 0
            ids, first = np.unique(group[zero], return_index=True)
            none = rows["p"][zero][first]  # p of a count of zero, for each group
            width = int(rows["width"][0])
            at = np.searchsorted(ids, group[~zero])
            p, bits = rows["p"][~zero], rows["bits"][~zero].view(np.uint64)
            size = np.bitwise_count(bits).astype(np.int64)
            covered = np.zeros(len(ids), np.uint64)
            np.bitwise_or.at(covered, at, bits)
            has = np.unique(at)
            start = np.searchsorted(at, has)
            # Cells with a count here and none there: what the words of the other side leave over.
            rest = np.abs(p[:, None] - none[None, :]) * (size[:, None] - np.bitwise_count(bits[:, None] & covered[None, :]))
            one = np.zeros((len(ids), len(ids)), np.int64)
            both = np.zeros_like(one)
            if len(has):
                one[has] = np.add.reduceat(rest, start, axis=0)
                for k, g in enumerate(has):
                    own = slice(start[k], start[k + 1] if k + 1 < len(has) else len(at))
                    cells = np.bitwise_count(bits[own, None] & bits[None, :]).astype(np.int64) * np.abs(p[own, None] - p[None, :])
                    both[g, has] = np.add.reduceat(cells.sum(0), start)
            empty = width - np.bitwise_count(covered[:, None] | covered[None, :]).astype(np.int64)
            whole = both + one + one.T + np.abs(none[:, None] - none[None, :]) * empty
            side = ids // size_of_tile
            for i, j in zip(*np.nonzero((ids[:, None] != ids[None, :]) & ((side[:, None] != side[None, :]) | (rows["left"][0] == rows["right"][0])))):
                key = (int(ids[i]), int(ids[j]))
                sums[key] = sums.get(key, 0) + int(whole[i, j])

        def settle(rows: dict, langs: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal tile
            change = (langs[1:] != langs[:-1]) | np.any([rows[c][1:] != rows[c][:-1] for c in ("left", "right", "block")], axis=0)
            cuts = [0, *(np.flatnonzero(change) + 1), len(langs)]
            for i, j in zip(cuts, cuts[1:]):
                here = (langs[i], rows["left"][i], rows["right"][i])
                if tile is not None and here != tile and sums:
                    yield handed()
                tile = here
                add({c: v[i:j] for c, v in rows.items()})

        for batch in batches:
            if batch.num_rows:
                held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", *names)})
                whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                same = np.all([whole[c] == whole[c][-1] for c in ("lang", "left", "right", "block")], axis=0)
                end = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1  # the last block may go on in the next batch
                if end:
                    yield from settle({c: whole[c][:end] for c in names}, whole["lang"][:end])
                held = [{c: v[end:] for c, v in whole.items()}]
        if held and len(held[0]["lang"]):
            yield from settle({c: held[0][c] for c in names}, held[0]["lang"])
        if sums:
            yield handed()

    return made


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Per group: lang, source, part (`pair` or `term`), item, value, rank."""
    spark = docs.sparkSession
    whole = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    partial = whole.mapInArrow(_counted(ENTRIES), "lang string, source string, term string, n long, documents long")
    counts = cut(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))
    seen = counts.filter("term IS NOT NULL")
    kept = seen.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("in_lang")).filter(F.col("documents") >= least)
    bucket = F.pmod(F.xxhash64("term"), F.lit(4_096))
    terms = cut(number_rows(kept, ["lang"], bucket, [bucket, F.col("term")], "id").withColumn("id", F.col("id") - 1))
    cells = cut(seen.join(terms.drop("documents"), ["lang", "term"]).select("lang", "source", "term", "id", "n", "in_lang"))

    named = counts.filter("term IS NULL").select("lang", "source")
    order = F.pmod(F.xxhash64("source"), F.lit(4_096))
    numbered = number_rows(named, ["lang"], order, [order, F.col("source")], "group").withColumn("group", F.col("group") - 1)
    per_lang = named.groupBy("lang").agg(F.count("*").alias("groups")).join(
        terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total")), "lang", "left")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = numbered.join(small(per_lang), "lang").join(totals, ["lang", "source"], "left")
    groups = small(groups.fillna(0, ["terms", "lang_total", "total"]))
    rows = cells.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))

    # The largest excesses over the language.
    excess = (F.col("p") - _share("in_lang", "lang_total", "terms")).alias("value")
    larger = rows.select("lang", "source", F.col("term").alias("item"), excess).filter("value > 0")
    ranking = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = larger.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= top)

    # Bitsets by count, and in each block a row for every group's terms without occurrence.
    block, one = F.shiftright("id", 6).alias("block"), F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    words = rows.groupBy("lang", "group", "groups", "n", "p", block).agg(F.bit_or(one).alias("bits"))
    widths = terms.groupBy("lang", block).agg(F.count("*").alias("width"))
    bare = groups.filter("terms = 0").select("lang").distinct().select("lang", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("width"))
    blocks = cut(widths.unionByName(bare))
    zeros = blocks.join(groups, "lang").select(
        "lang", "group", "groups", F.lit(0).cast("long").alias("n"), F.when(F.col("terms") > 0, _share("0", "total", "greatest(terms, 1)")).otherwise(0).alias("p"), "block", "width", F.lit(0).cast("long").alias("bits"))
    every = zeros.unionByName(words.withColumn("width", F.lit(0).cast("long")))
    own, other = F.floor(F.col("group") / TILE), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("groups") - 1) / TILE)))
    tiled = every.withColumn("own", own).withColumn("other", other).select(
        "lang", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "block", "group", "n", "p", "width", "bits")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiled.repartition(partitions, "lang", "left", "right", "block").sortWithinPartitions("lang", "left", "right", "block", F.desc("width"), "group")
    sums = dealt.mapInArrow(_distances(TILE), "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "group", "source")
    pairs = (
        sums.join(names.withColumnRenamed("group", "g"), ["lang", "g"])
        .join(names.withColumnRenamed("group", "h").withColumnRenamed("source", "item"), ["lang", "h"])
        .select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(ranking)))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(by_term.withColumn("part", F.lit("term")).select(*columns))
