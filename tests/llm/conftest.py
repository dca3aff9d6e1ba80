import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in any column, empty and long texts, repeated rows, ties and clashing column names."""
    rows = [
        (0, "", "en", "s", 0, 1.0), (1, None, "en", None, None, None), (2, "one", None, "s", 3, 0.5), (3, "one two", "de", "s", 7, 0.5),
        (4, "x " * 60, "en", "s", 120, 0.1), (4, "x " * 60, "en", "s", 120, 0.1), (5, "x " * 60, "en", "s", 120, 0.1),
        (None, "x " * 60, "en", "s", 120, 0.1), (6, " ".join(f"w{i}" for i in range(40_000)), "fr", "s", 1, 0.0),
        (7, "\n\t  ", "en", "s", 5, 0.0), (8, "😀 é ñ <|endoftext|>", "es", "s", 9, 0.0), (9, "9" * 3000 + "@" * 3000, "en", "s", 1, 0.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


@pytest.fixture(scope="session")
def awkward_path(spark, awkward, tmp_path_factory):
    """A folder of tables: awkward documents, labels and embeddings."""
    d = tmp_path_factory.mktemp("awkward")
    awkward.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 0, 0), (2, 1, 0), (3, None, None), (None, 1, 1), (4, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0]), (10, [-1.0, 0.0]), (40, [1.0, 0.0]), (40, [1.0, 0.0]), (None, [1.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_path(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)
