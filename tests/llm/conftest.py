import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n_tokens long, spans string, score double, part int, a long, key string"


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang): nulls, empty and very long texts, copies, near copies, ties, odd characters."""
    rng = random.Random(5)
    words = ["stone", "river", "Über", "été", "niño", "the", "of", "and", "house", "quick", "wolf,", "sings.", "night", "rain"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = prose(300)
    near = base.replace("stone", "stone", 1).split(" ")
    near[150] = "changed"
    texts = [
        None, "", " \n\t", "a", "...", "12 34", base, base, " ".join(near), prose(20_000), "x" * 30_000, prose(40) + "\r\n\tz  y\n\nw", "日本語 テキスト 😀",
        "<|endoftext|> and <|startoftext|>", "mail a.b@c.example, +1 (988) 555-2485, 10.0.0.256 10.0.0.25, 4041894974608795",
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "the MIT license and the mit license",
        *[prose(rng.randint(1, 400)) for _ in range(60)]]
    out = [(i, text, ["en", "de"][i % 2] if text else None) for i, text in enumerate(texts)]
    return [*out, (None, prose(30), "en"), (None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows in a table whose other columns have the names that operators use inside."""
    return spark.createDataFrame([(i, t, l, "s", 1, 7, 7, "x", 0.5, 3, 9, "k") for i, t, l in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
