import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score string, key string, "
          "row string, node string, kept string, label string, cell string, length string")


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(["the", "of", "and"]) if i % 3 == 0 else
                    "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 9))) for i in range(n))


def documents(spark, rows):
    """Documents of (id, text), with columns whose names operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), *["x"] * 8) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def awkward_rows():
    """Null ids and texts, empty, blank and very long texts, repeated rows, ties."""
    long = prose(1, 40_000)
    plain = prose(2, 120)
    return [(0, plain), (1, plain), (1, plain), (2, None), (3, ""), (4, " \n\t "), (None, prose(3, 80)), (None, None),
            (5, long), (6, "one"), (7, "one two"), (8, "a\n\na\n a\na " + plain), (9, "é漢字🙂 " * 30), (10, plain + " end")]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return documents(spark, awkward_rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(i, int(i % 4 != 3), int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (2, None, None), (0, 0, 0)],
        "doc_id bigint, quality int, toxic int")
