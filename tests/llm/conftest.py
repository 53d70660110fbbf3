import pytest

WORDS = [f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{k}" for k in range(2000)]


def prose(a: int, n: int) -> str:
    return " ".join(WORDS[(a + k * 7) % 2000] for k in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows, and clashing extra columns."""
    texts = ["", " \n\t ", None, "A.", "one two", prose(1, 60), prose(1, 60), prose(1, 60) + " tail", "x" * 50_000, prose(3, 9000), "é ü 😀 ñ", "1 2 3 " * 50, "same line\nsame line\nother"]
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(5, prose(1, 60), "en", "s1", 5), (None, prose(2, 80), None, None, None), (None, None, None, None, None), (6, "another text under a known id", "de", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("n_words", "fp", "t", "row", "base", "spans", "x", "group", "hits", "items", "digest", "words", "key", "cell", "shard", "part", "kept", "term", "count")
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
