import pytest


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names clash with results."""
    long = "word " * 30_000
    rows = [
        (1, "One two three four five.\nOne two three four five.", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \t\n", "de", "b"),
        (5, "mail me@x.org, me@x.org or 10.0.0.1; +1 (555) 123-4567", "en", "a"), (5, "mail me@x.org, me@x.org or 10.0.0.1; +1 (555) 123-4567", "en", "a"),
        (6, long, "en", "a"), (7, "x" * 5_000, "en", "ü"), (None, "null id here to see", "fr", "c"), (8, "日本語 テキスト \U0001f600 ▁mark", "ja", "c"), (9, "a", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({"n_chars": F.length("text").cast("long"), "score": F.lit(1), "id": F.lit("x"), "node": F.lit("y"), "size": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")
