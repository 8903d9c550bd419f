"""Small documents with every odd case: nulls, empty, long, repeated, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, own_hash string, _row string"
WORDS = "the of and in that is was for on with as his they at be this from have or by one had not but what all were when we there".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", "er", "ly"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    text = prose(1, 60)
    rows = [
        (1, text, "en", "a"),
        (1, text, "en", "a"),
        (2, None, "en", "a"),
        (None, prose(2, 30), None, None),
        (None, None, None, None),
        (3, "", "en", "b"),
        (4, " \t\n\r\x0b\x0c ", "en", "b"),
        (5, "one", "en", "c"),
        (6, "Häuser\u00a0stehen über\u3000日本 \U0001f600 ok<|endoftext|>x", "de", "ü"),
        (7, prose(3, 4000), "en", "b"),
        (8, text + " indeed", "en", "c"),
        (9, "line here\nline here\nline here\n\nother", "en", "c"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, "x", "y") for r in rows]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
