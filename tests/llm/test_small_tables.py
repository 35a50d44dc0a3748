"""The quality classifier on a table with fewer trusted documents than a group's least."""

from inkmill.llm import common, kneser_ney


def test_few_trusted_documents_still_reject_junk(spark, tmp_path):
    words = "the house by the river was old and the people of the town knew it well".split()
    good = [(k, " ".join(words[(k * 7 + j * 5) % len(words)] for j in range(60)), "en") for k in range(20)]
    junk = [(100 + k, "".join(chr(33 + (k * 31 + j * j * 17 + j) % 90) for j in range(300)), "en") for k in range(5)]
    spark.createDataFrame(good + junk, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    labels = spark.createDataFrame([(k, 1, 0) for k, _, _ in good], "doc_id long, quality int, toxic int")
    assert len(good) < kneser_ney.LEAST
    kept = {r.doc_id for r in kneser_ney.classify(docs, labels, common.workspace(spark)).where("kept").select("row.doc_id").collect()}
    assert kept == {k for k, _, _ in good}
