import random

import pytest

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(120).cache()


def doc_frame(spark, rows, schema=DOC_SCHEMA):
    """rows: (doc_id, text, lang, source); n_chars is filled in."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], schema)


def odd_docs(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows and rare characters."""
    r = random.Random(5)
    long_text = " ".join(r.choice(["alpha", "beta", "Gamma,", "déjà", "x1"]) for _ in range(30_000))
    rows = [
        (None, None, None, None), (None, "a b c", None, None), (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \t\n ", "en", "s2"),
        (4, long_text, "en", "s2"), (5, "same text here", "en", "s2"), (5, "same text here", "en", "s2"), (5, "other text", "de", None),
        (6, "same text here", "en", "s3"), (7, "   Σασ <|endoftext|> it's 12 \U0001f600 İ á \x1c\x00y", "xx", "￿"),
        (8, "one", "en", "\U00010000"), (-9, "x" * 70_000, "en", "s1"),
    ]
    return doc_frame(spark, rows)


def clash(df):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["rid", "size", "sk", "ids", "n", "off", "shard_", "words", "score_", "key", "at", "_b", "_t", "_w"]
    return df.withColumns({n: F.lit("z") for n in names})
