"""Operator 5: licence scan by canonical digests.  DataFrame functions only.

Method: a whole text is brought to a canonical form (lower case, copyright lines
out, punctuation and white space to single spaces, equivalent spellings to one)
and its digest is looked up by a hash join in the digests of known licences.

Scale: the scan makes the digests; the known table has one row per licence.  It
is joined without a hint, so Spark broadcasts it when its size allows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.license_full import FULL
from tickloom.llm.license_texts import KNOWN, SPELLINGS

#: A line that names a holder or a year; the word alone also stands inside licence sentences.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|[0-9]{4}|by |holder|<|\[)|\(c\)|©)[^\n]*"
RESERVED_LINE = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*"
MARKS = r"[\x00-/:-@\[-`{-\x7f©“”‘’«»–—…•]+"

#: Titles that stand above these texts in files.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"), "Zlib": ("zlib License", "The zlib License"), "Unlicense": ("The Unlicense",),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
}


def canonical(text: Column) -> Column:
    """The canonical form; empty for null, empty and punctuation-only texts."""
    form = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    form = F.regexp_replace(form, RESERVED_LINE, "$1")
    # Two spaces between words: a space on each side belongs to one word alone.
    form = F.concat(F.lit(" "), F.regexp_replace(form, MARKS, "  "), F.lit(" "))
    for found, kept in SPELLINGS.items():
        form = F.replace(form, F.lit(f" {found} ".replace("_", "  ")), F.lit(f" {kept} ".replace("_", "  ")))
    return F.trim(F.regexp_replace(form, " +", " "))


def canonical_sql(text: str) -> str:
    """`canonical` for DuckDB."""
    form = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '\\1', 'g')"
    form = f"regexp_replace({form}, '{RESERVED_LINE}', '\\1', 'g')"
    form = f"' ' || regexp_replace({form}, '{MARKS}', '  ', 'g') || ' '"
    for found, kept in SPELLINGS.items():
        form = f"replace({form}, '{f' {found} '.replace('_', '  ')}', '{f' {kept} '.replace('_', '  ')}')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'), ' ')"


def known_licenses(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, text) of the built-in licences or of `texts`."""
    return spark.createDataFrame(list((KNOWN if texts is None else texts).items()), "license string, text string")


def variants() -> list[tuple[str, str]]:
    """(license, text) of the built-in short texts with titles and other list marks, and of the full texts."""
    rows = list(FULL.items())
    for name, text in KNOWN.items():
        marked = [re.sub(r"(?m)^[0-9][.] ", "", text), re.sub(r"(?m)^([0-9])[.] ", lambda m: f"({chr(96 + int(m[1]))}) ", text)]
        bodies = dict.fromkeys([text, *marked])
        rows += [(name, f"{title}{body}") for title in ("", *(f"{t}\n\n" for t in TITLES.get(name, ()))) for body in bodies if title or body != text]
    return rows


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The licence that each whole text is, if any.

    `known` has the columns license and text (default: the built-in table and its `variants`).  Returns one row per input row: doc_id,
    n_canonical (characters of the canonical form), canonical_sha256, license (null: none).  Of known licences with one
    canonical form the first name in order is given.

    Null text counts as empty and an empty canonical form is no licence, even if a known text has it.  Repeated rows and
    null ids are rows like any other; other columns are not read and so cannot clash.  An empty table gives an empty table.
    """
    if known is None:
        spark = docs.sparkSession
        known = known_licenses(spark).unionByName(spark.createDataFrame(variants(), "license string, text string"))
    digest = F.sha2(F.col("form").cast("binary"), 256).alias("canonical_sha256")
    table = known.select("license", canonical(F.col("text")).alias("form")).filter("form <> ''").select("license", digest)
    table = table.groupBy("canonical_sha256").agg(F.min("license").alias("license"))
    forms = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("form"))
    scanned = forms.select("doc_id", F.char_length("form").cast("long").alias("n_canonical"), digest)
    return scanned.join(table, "canonical_sha256", "left").select("doc_id", "n_canonical", "canonical_sha256", "license")
