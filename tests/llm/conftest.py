import random

import pytest

# Extra columns whose names the operators use inside.
CLASHES = {"score": 0.5, "place": 1, "node": 2, "_text": "x", "_key": 3, "_id": 4, "h": 5, "media": "m", "spans": "s", "_row": 6, "labels": "l", "fp": 7, "ids": "i"}
LONG = " ".join(f"w{i % 997}" for i in range(60_000)) + " all rights reserved " + "x" * 50_000


def edge_rows():
    rows = [
        (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, LONG), (6, "the same text again and again"), (6, "the same text again and again"),
        (7, "the same text again and again"), (8, "ünïcödé ▁ 日本 🙂 \x1c end"), (None, "no id but some words"), (9, "\x00 null byte"), (10, LONG),
    ]
    return [(i, t, "en", "src", None if t is None else len(t), *CLASHES.values()) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{k}` {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in CLASHES.items()
)


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def copies():
    """Texts with near copies, shared passages and short vocabularies."""
    draw = random.Random(11)
    base = [f"b{draw.randrange(400)}" for _ in range(300)]
    rows = []
    for i in range(80):
        words = [f"v{draw.randrange(60)}" for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.5:
            at = draw.randrange(250)
            words[len(words) // 2 : len(words) // 2] = base[at : at + draw.randint(5, 50)]
        if rows and draw.random() < 0.3:
            words = rows[draw.randrange(len(rows))][1].split()
            if words and draw.random() < 0.5:
                words[draw.randrange(len(words))] = "changed"
        rows.append((i * 3, draw.choice([" ", "\n", " \t"]).join(words)))
    return rows
