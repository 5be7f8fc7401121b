import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    base = " ".join(f"word{i}" for i in range(200))
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, base, "en", "a", 1, "x"), (2, base, "en", "b", 1, None), (2, base, "en", "b", 1, None), (3, None, None, None, None, None),
        (4, "", "en", "a", 0, "y"), (5, " \t\n ", "en", "a", 3, "y"), (6, long, "de", "a", 1, "z"), (None, base, "en", "a", 1, "z"),
        (7, base + " more words at the end", "en", "a", 1, "z"), (8, "Single", "fr", "c", 6, "z"), (9, "single", "fr", "c", 6, "z"),
        (10, "one two", None, "c", 7, "z"), (11, long + " tail", "de", None, 1, "z"), (12, "😀 é ñ\x1c中文 \u0085", "es", "b", 1, "z"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    return spark.createDataFrame(rows, schema)
