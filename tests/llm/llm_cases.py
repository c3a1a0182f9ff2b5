"""Fixture rows of the subpackage's tests."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key int, begin double, tree string, score string"
WORDS = "the of and river stone water light house garden winter summer over under between road silver window market".split()


def prose(seed: int, n: int, words=tuple(WORDS)) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def unique_words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def as_docs(spark, rows):
    """rows: (doc_id, text); the other columns carry names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, 0.5, "t", None) for i, t in rows], SCHEMA)


EDGE = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "One"),
    (5, "one"),
    (6, prose(1, 40)),
    (6, prose(1, 40)),
    (7, prose(1, 40)),
    (None, prose(1, 40)),
    (None, None),
    (8, prose(2, 60_000)),
    (9, "été 日本語 🙂 \x00 ﬀ ٣ <|endoftext|> ▁x  </s>"),
]
