"""Queries over the finds in texts of every language, in Spark and in DuckDB."""

import duckdb
import pytest

from inkmill.plans import catalogue

TEXTS = [(1, "de", "Das ist STRENG verboten, z. B. hier, e.g. dort, in order to gehen."), (2, "en", "This is STRICTLY so, e.g. here, in order to go."), (3, "fr", "Rien.")]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(TEXTS, "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")

    def run(name):
        query = catalogue.queries()[name](spark, folder)
        return sorted(map(tuple, query.collect())), sorted(duck.sql(f"SELECT {', '.join(query.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall())

    return run


@pytest.mark.parametrize("name", ["merge_block_and_full", "carried_status"])
def test_finds_of_every_language(both, name):
    got, want = both(name)
    assert got == want
    rules = {d: {r[2] for r in got if r[0] == d} for d in (1, 2)}
    assert {"accessibility", "abbreviations", "word_usage_i"} <= rules[1] and {"accessibility", "abbreviations", "word_usage_i"} <= rules[2]


def test_scores_of_every_language(both):
    got, want = both("label_scores")
    assert got == want and {q for q, _, _ in got} == {0, 1}
    assert all(score < 100 for _, _, score in got)


def test_other_queries_keep_their_guard(both):
    got, want = both("issue_ids")
    assert got == want and not [r for r in got if r[0] == 1]
