import pytest
from pyspark.sql import types as S

SCHEMA = S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType()), S.StructField("lang", S.StringType()), S.StructField("source", S.StringType()), S.StructField("n_chars", S.LongType()), S.StructField("first", S.StringType()), S.StructField("cls", S.StringType()), S.StructField("size", S.StringType())])


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioutnrsl") for _ in range(r.randint(2, 7))) for _ in range(n))


ROWS = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),
    (3, prose(1, 110) + " " + prose(9, 6)),
    (4, "Alpha  beta\tgamma delta"),
    (5, "Alpha beta gamma delta"),
    (6, ""),
    (7, None),
    (8, " \n\t "),
    (9, prose(2, 40) + "\n" + prose(1, 60)),
    (10, "x " * 300),
    (11, "one"),
    (12, prose(3, 4000)),
    (None, prose(4, 50)),
    (None, None),
    (13, prose(5, 50)),
    (13, prose(5, 50)),
    (14, "Déjà vu — naïve text here it's 12345 !!! " + "z" * 300 + "  end "),
    (15, "A\r\nB\x0bC\x0cD\x1cE\x85F　G"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    rows = [(i, t, "en", None if i in (1, 6) else f"s{(i or 0) % 3}", len(t or ""), "x", "y", "z") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
