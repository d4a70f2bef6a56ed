"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

COLUMNS = "doc_id bigint, text string, row string, kept string, id string, n_chars bigint, `a.b` string"


def awkward_rows(seed=5, copies=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["The", "end.", "é", "Ünd", "x,", "!!", "<|endoftext|>"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(200)
    texts = [None, "", "   \n\t", "a", "one two three", "ONE two three", "x y\x85z \x1c q", "\n\nline\n\n  line  two\n", "<|endoftext|> a <s>b</s>", "漢字 🙂 é"]
    texts += [base] * copies + [base.replace(" ", "  ")] * 3 + [base + " tail"] * 2
    for i in range(40):  # near copies
        parts = base.split(" ")
        for _ in range(rng.randint(1, 12)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts))
    texts += [text(rng.randint(1, 150)) + " " + passage + "\n" + text(rng.randint(1, 90)) for _ in range(30)]
    texts += [text(rng.randint(1, 400)) for _ in range(60)]
    texts += ["spam " * 400, text(9_000), "y" * 5_000]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, "r", "k", "i", None if t is None else len(t), "d") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS).repartition(7).cache()


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1] or "") for r in awkward_rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def odd_ids(spark):
    """Null and repeated ids, repeated rows."""
    long = " ".join(f"v{i}" for i in range(80))
    made = [(None, "a b c d e", 1), (None, None, 2), (7, "a b c d e", 3), (7, "a b c d e", 3), (7, "other words stand here now", 4), (5, long, 5), (9, long, 6), (9, long + " z", 7), (None, long, 8)]
    return spark.createDataFrame([(i, t, "r", "k", "i", n, "d") for i, t, n in made], COLUMNS)
