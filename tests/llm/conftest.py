import pytest

EDGES = [
    (1, "One line here that is long enough to count as text.\nAnother line, quite different from the first one in its words.", "en", "src0", 1, "extra"),
    (2, None, "en", None, None, None),
    (3, "", None, "src0", 0, ""),
    (4, " \n\t\r\n ", "en", "src0", 6, "x"),
    (5, "One line here that is long enough to count as text.\nAnother line, quite different from the first one in its words.", "en", "src0", 1, "extra"),
    (6, "word " * 30_000, "en", "src1", 1, "long"),
    (7, "é" * 5_000, "fr", "src1", 1, "one word"),
    (None, "A row without an id, mail a.b@example.com now.", "en", "src0", 1, None),
    (1, "One line here that is long enough to count as text.\nAnother line, quite different from the first one in its words.", "en", "src0", 1, "extra"),
]
#: Extra columns bear names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows and a clashing column, as a table."""
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    spark.createDataFrame(EDGES, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """An empty table of the same columns."""
    path = str(tmp_path_factory.mktemp("nothing") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    """doc_id -> text of the smallest table."""
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
