"""The registered queries of the text operators, over whole tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.divergence import source_divergence
from tickloom.llm.exact_dedup import exact_groups
from tickloom.llm.fingerprints import fingerprints
from tickloom.llm.license_texts import KNOWN
from tickloom.llm.licenses import canonical_sql, scan_licenses, variants
from tickloom.llm.near_dedup import near_duplicates
from tickloom.llm.packing import pack_documents
from tickloom.llm.pieces import encode_decode
from tickloom.llm.quality import score, train
from tickloom.llm.sharding import assign_shards
from tickloom.llm.substrings import repeated_passages
from tickloom.llm.token_counts import token_counts
from tickloom.llm.vector_codes import compress_vectors
from tickloom.llm.vector_dedup import near_vectors

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@_query
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(_documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@_query
def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(_documents(spark, sf))


ORACLE["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
g AS (SELECT n, count(*) AS group_size, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM d GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM d JOIN g USING (n)
"""


@_query
def op4_shards(spark: SparkSession, sf: str) -> DataFrame:
    return assign_shards(_documents(spark, sf), shards=8)


@_query
def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(_documents(spark, sf))


@_query
def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf))


#: Every text that the scan knows, as rows of SQL.
_TEXTS = [*KNOWN.items(), *variants()]
_QUOTED = [(name, text.replace("'", "''")) for name, text in _TEXTS]
_LICENSES = f"""
known AS MATERIALIZED (SELECT * FROM (VALUES {', '.join(f"('{name}', '{text}')" for name, text in _QUOTED)}) AS v(license, t)),
k AS (SELECT min(license) AS license, digest FROM (SELECT license, sha256(form) AS digest FROM (SELECT license, {canonical_sql('t')} AS form FROM known) WHERE form <> '') GROUP BY digest)"""
_SCAN = "SELECT doc_id, length(form) AS n_canonical, sha256(form) AS canonical_sha256, license FROM d LEFT JOIN k ON k.digest = sha256(form)"
ORACLE["op5_license_scan"] = f"WITH {_LICENSES}, d AS (SELECT doc_id, {canonical_sql('text')} AS form FROM documents) {_SCAN}"


@_query
def license_scan_of_mixed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The scan over all documents and all known texts, these in capitals, with other breaks and another copyright line."""
    known = [(-1 - i, f"Copyright (c) 2001 Somebody Else\n\n{text.upper()}\n\n") for i, (_, text) in enumerate(_TEXTS)]
    docs = _documents(spark, sf).select("doc_id", "text")
    return scan_licenses(docs.unionByName(spark.createDataFrame(known, "doc_id bigint, text string")))


ORACLE["license_scan_of_mixed_texts"] = f"""WITH {_LICENSES}, m AS (
    SELECT doc_id, text FROM documents
    UNION ALL SELECT -row_number() OVER (), 'Copyright (c) 2001 Somebody Else' || chr(10) || chr(10) || upper(t) || chr(10) || chr(10) FROM known),
d AS (SELECT doc_id, {canonical_sql('text')} AS form FROM m) {_SCAN}"""


@_query
def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@_query
def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return score(docs, train(docs, spark.read.parquet(f"{sf}/labels.parquet")), threshold=0.3)


@_query
def op7_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf), window=50).drop("removed")


@_query
def op10_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf), words=4, percent=80)


@_query
def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return encode_decode(_documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(_documents(spark, sf))


ORACLE["op11_source_divergence"] = r"""
WITH d AS MATERIALIZED (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents),
w AS MATERIALIZED (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(words) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(x.n, 0)::BIGINT AS n
    FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM w GROUP BY ALL) x USING (lang, source, term)),
p AS MATERIALIZED (
    SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::BIGINT + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::BIGINT + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM k),
f AS MATERIALIZED (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@_query
def op12_vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), threshold=0.95)


ORACLE["op12_vector_dedup"] = """
WITH RECURSIVE x AS MATERIALIZED (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM x UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, coalesce(c.low, e.vec_id) AS component_id, coalesce(c.low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = e.vec_id
"""


@_query
def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return compress_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def _codes_sql() -> str:
    """Two rounds, written out; parts of four components, as the table's 64-component vectors have them."""
    gap = " + ".join(f"(p.x[{i}] - c.x[{i}]) * (p.x[{i}] - c.x[{i}])" for i in range(1, 5))
    nearest = "SELECT p.r, p.part, min({{d: {gap}, k: c.k}}) AS best FROM p JOIN c{n} c ON p.part = c.part GROUP BY p.r, p.part"
    means = ", ".join(f"CAST(floor(sum(p.x[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
    rounds = ""
    for n in range(2):
        rounds += f"""
a{n} AS MATERIALIZED ({nearest.format(gap=gap, n=n)}),
m{n} AS (SELECT part, best.k AS k, [{means}] AS x FROM a{n} JOIN p USING (r, part) GROUP BY part, best.k),
c{n + 1} AS MATERIALIZED (SELECT c.part, c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.part = c.part AND m.k = c.k),"""
    return f"""
WITH e AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS MATERIALIZED (SELECT r, part, v[4 * part + 1:4 * part + 4] AS x FROM e, range(16) AS t(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS k, x FROM p WHERE r <= 64),{rounds}
a AS MATERIALIZED ({nearest.format(gap=gap, n=2)}),
v AS MATERIALIZED (SELECT r, string_agg(format('{{:02x}}', best.k), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(x[j] AS VARCHAR), ',' ORDER BY part, k, j)) AS digest FROM c2, range(1, 5) AS t(j))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT digest FROM h) AS codebooks_sha256
FROM v JOIN e USING (r)
"""


ORACLE["op13_vector_codes"] = _codes_sql()
