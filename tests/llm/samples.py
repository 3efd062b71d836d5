import random

import pytest
from pyspark.sql import functions as F

LONG = "langer Satz mit Wörtern, déjà vu 12345 " * 6000


@pytest.fixture(scope="session")
def edge_pages(spark):
    """Pages with missing values in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "http://a.example/1", "one two three four five six seven\nshared line\n", "a"),
        (2, "http://b.example/1", "one two three four five six seven\nshared line\n", "b"),
        (2, "http://b.example/1", "one two three four five six seven\nshared line\n", "b"),
        (3, None, None, "c"), (4, "http://c.example/\r\nX: y", "", "c"), (None, "http://d.example/", "text without id " * 9, None),
        (None, None, None, None), (6, "http://e.example/", LONG, "e"), (7, "http://e.example/2", "x" * 70_000, "e"),
        (8, "http://f.example/", " \n\t \n", "f"), (9, "http://f.example/", "<|endoftext|> it's I'm 'tis\r\ndon't  　 end́ ǅ ß", "f"),
        (10, "u", "short", "g"), (11, "u", "so so so so so so so so so so", "g"), (12, "u", "日本語 テキスト 😀😀 ok", "g"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, site string")
    clashes = ["digest", "payload", "score", "text_a", "ids", "place", "range", "words", "n_words", "set_id", "bucket", "first", "kept"]
    return frame.withColumns({c: F.lit(f"own {c}") for c in clashes})


@pytest.fixture(scope="session")
def no_pages(spark):
    return spark.createDataFrame([], "page_id long, url string, html string, site string")


@pytest.fixture(scope="session")
def random_pages(spark):
    """Random texts with copies and near copies, deterministic."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 120)))))
    for i in range(120, 260):
        base = rows[rng.randrange(0, 120)][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base)))
    return spark.createDataFrame(rows, "page_id long, html string").repartition(7), rows
