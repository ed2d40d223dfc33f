import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in ("lang", "source", "key", "fp", "pos", "_key", "_mix", "body", "w")]
)


@pytest.fixture
def documents(spark):
    """Frames of (doc_id, text[, source]) with further columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", *"abcdefg") for r in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture
def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} filler" for i in range(30_000))
    shared = "The same long line of text\nsecond line that is shared\nShort"
    return [
        (1, shared, "a"),
        (2, shared.upper(), None),
        (2, shared.upper(), None),
        (3, None, "b"),
        (4, "", "b"),
        (5, "   \n\t", None),
        (6, long, "a"),
        (7, long + " end", "a"),
        (8, "É é ÀB straße ıİ", "c"),
        (None, shared, "a"),
        (None, None, None),
        (9, "one", "a"),
    ]
