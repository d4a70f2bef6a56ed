"""Operator 11 against a plain version, with awkward rows."""

import random
import re
from collections import Counter, defaultdict

from tickloom.llm import divergence
from tickloom.llm.divergence import source_divergence, terms_in

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=50):
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    for lang in documents:
        kept = [t for t, n in documents[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        q = share({t: sum(c[t] for c in own.values()) for t in kept})
        p = {s: share(c) for s, c in own.items()}
        for s in own:
            for part, items in (("pair", [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]), ("term", [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]])):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def made(rows, spark):
    return spark.createDataFrame([(*r, 1, "g", "b") for r in rows], "doc_id bigint, text string, lang string, source string, n bigint, `group` string, block string")


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def rows(seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("", "x", "É", "ß", "Z", "漢", "\xa0", "q")] + ["The", "THE", "the", "ÀB", "àb"]
    text = lambda n, own: "".join(rng.choice(words[own % 7:]) + rng.choice([" ", "\n", "1", "-", "_", ". "]) for _ in range(n))
    out = [(i, text(rng.randint(0, 80), i), rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(9)] + [None])) for i in range(400)]
    out += [(None, None, "en", "no text"), (None, "", "en", "no text"), (7, "rare words only", "xx", "a"), (7, "other", "xx", "b"), (8, "alone", "yy", "c"), (9, "the " * 3_000 + "y" * 70_000, "en", "long")]
    return out + out[:5]


def test_divergence(spark, monkeypatch):
    for tile, entries in ((64, 300_000), (3, 50)):  # several tiles, and tasks that hand on many times
        monkeypatch.setattr(divergence, "TILE", tile)
        monkeypatch.setattr(divergence, "ENTRIES", entries)
        assert found(source_divergence(made(rows(), spark).repartition(4), least=20)) == plain(rows(), 20)


def test_no_kept_terms_and_no_rows(spark):
    assert found(source_divergence(made(rows(), spark), least=10_000)) == plain(rows(), 10_000)
    assert source_divergence(made([], spark)).count() == 0


def test_slices_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "Abc déf  ghi1jk-" * 9 + "x" * 40
    assert [t for part in terms_in(text.encode()) for t in part] == [t.encode() for t in TERM.findall(text.translate(LOWER))]
