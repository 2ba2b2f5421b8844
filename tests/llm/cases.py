"""Awkward documents shared by the tests of the operators."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string"
# Names the operators use inside; inputs may have columns called so too.
CLASHING = (
    "key", "part", "code", "size", "node", "component", "members", "position", "positions",
    "units", "rank", "score", "n_tokens", "n_bytes", "taken", "target", "failures", "spans",
    "chunk", "member", "sha", "language", "share", "mixed_at", "digest", "bucket",
)


def words(rng, count):
    vocabulary = ["alpha", "Beta", "gamma,", "delta", "eps.", "straße", "été", "x1", "don't", "日本"]
    return " ".join(rng.choice(vocabulary) + str(rng.randint(0, 60)) for _ in range(count))


def awkward_rows(seed=5):
    rng = random.Random(seed)
    base = words(rng, 400)
    passage = words(rng, 30)
    near = base.split(" ")
    near[200] = "changed"
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \n\t ", None, "a"),
        (4, base, "en", "b"),
        (5, base, "en", "b"),
        (6, " ".join(near), "en", None),
        (7, base.upper(), "de", "c"),
        (8, "one two three", "fr", "c"),
        (9, "One  TWO\nthree", "fr", "c"),
        (10, "word " * 3000, "fr", "a"),
        (11, passage + "\n" + words(rng, 60), "es", "b"),
        (12, words(rng, 60) + "  " + passage, "es", "b"),
        (12, words(rng, 60) + "  " + passage, "es", "b"),
        (13, "12345 !!! $$$", None, None),
        (14, "é" * 5000, "fr", "a"),
        (15, words(rng, 20_000), "en", "d"),
        (None, passage, None, None),
    ]
    return rows + [rows[3]]


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators make."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({name: F.lit(name) for name in CLASHING})


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
