import pytest
from pyspark.sql import types as T


@pytest.fixture
def documents(spark):
    """Makes a documents table, with columns beside the known ones whose names could clash."""

    def make(rows):
        schema = T.StructType(
            [
                T.StructField("doc_id", T.LongType()),
                T.StructField("text", T.StringType()),
                T.StructField("lang", T.StringType()),
                T.StructField("source", T.StringType()),
                T.StructField("n_chars", T.LongType()),
                T.StructField("score", T.StringType()),
                T.StructField("fp", T.StringType()),
                T.StructField("_id", T.StringType()),
                T.StructField("kept", T.StringType()),
            ]
        )
        full = []
        for row in rows:
            doc, text, *rest = row
            lang, source = (rest + [None, None])[:2]
            full.append((doc, text, lang, source, None, "x", "y", "z", "w"))
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def odd(documents):
    """Null, empty and long texts, repeated rows and ids, a null id."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
    return documents(
        [
            (1, None, None, None),
            (2, "", "en", "a"),
            (3, "one", "en", "a"),
            (3, "one", "en", "a"),
            (4, "  \t\n ", "de", "b"),
            (5, long, "de", "b"),
            (6, long + " end", None, "b"),
            (7, "one", "fr", None),
            (None, "no id here", "fr", "c"),
            (9, "éè \U0001f600 café naïve", "fr", "c"),
        ]
    )


@pytest.fixture
def nothing(documents):
    return documents([])
