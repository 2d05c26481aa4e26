import pytest

from docsift.plans import api


def test_several_job_descriptions_are_an_error(spark):
    docs = spark.createDataFrame([(1, "Spark and SQL")], "doc_id long, text string")
    jds = spark.createDataFrame([(1, "Spark"), (2, "Kafka")], "jd_id long, text string")
    with pytest.raises(ValueError, match="one job description"):
        api.jd_struct(docs, jds)
    assert api.jd_struct(docs, jds.limit(1)).count() == 1


def test_pairs_of_documents_and_descriptions(spark):
    docs = spark.createDataFrame([(1, "Kafka and Python"), (2, "Rust, SQL. Python")], "doc_id long, text string")
    jds = spark.createDataFrame([(1, "Kafka\nRust"), (2, "Python\nSQL"), (3, "")], "jd_id long, text string")
    pairs = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2), (9, 1), (1, 7)], "jd_id long, doc_id long")
    got = {(r.jd_id, r.doc_id): (r.jd.coverage_required, r.jd.matched, r.jd.missing) for r in api.jd_struct(docs, jds, pairs).collect()}
    assert got[1, 1] == (0.5, ["kafka"], ["rust"])
    assert got[2, 1] == (0.5, ["python"], ["sql"])
    assert got[2, 2] == (1.0, ["python", "sql"], [])
    assert got[3, 2] == got[9, 1] == (0.0, [], [])
    assert len(got) == 5


def test_review_of_pairs(spark):
    files = spark.createDataFrame([(1, "a.txt", bytearray(b"Kafka and Python")), (2, "b.txt", bytearray(b"Rust"))], "doc_id long, filename string, content binary")
    jds = spark.createDataFrame([(1, "Kafka"), (2, "Rust")], "jd_id long, text string")
    pairs = spark.createDataFrame([(1, 1), (2, 1)], "jd_id long, doc_id long")
    got = {(r.jd_id, r.doc_id): r.json for r in api.review(files, jds, pairs).collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 2)}
    assert '"matched":["kafka"],"missing":[]' in got[1, 1] and '"matched":[],"missing":["rust"]' in got[2, 1]
