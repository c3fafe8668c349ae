"""Rows of one id, and texts that meet at the ends of parts, don't come together in one task."""

from pyspark.sql import functions as F

from stridefield.llm import curriculum, fingerprint
from stridefield.operators.lineage import Scratch


def test_rows_of_null_ids_are_spread(spark):
    """Null ids are ordered by their texts, so no bucket of the order holds them all; a second run agrees."""
    docs = spark.range(3000).selectExpr("CAST(NULL AS bigint) AS doc_id", "'s' AS source", "concat('text number ', id) AS text")
    sized = curriculum.narrow(docs)
    largest = sized.groupBy(F.substring("_key", 1, 3)).count().agg(F.max("count")).first()[0]
    assert largest < 30
    runs = [sorted(map(tuple, curriculum.mix(curriculum.narrow(docs.repartition(n))).select("_key", "taken", "positions").collect())) for n in (2, 5)]
    assert runs[0] == runs[1] and sum(r[1] for r in runs[0]) == int(1.5 * 9000)


def test_rows_of_one_id_are_spread_by_their_number(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "'s' AS source", "concat('text number ', id) AS text", "id AS _row")
    sized = curriculum.narrow(docs, "_row")
    assert sized.groupBy(F.substring("_key", 1, 3)).count().agg(F.max("count")).first()[0] < 30
    assert curriculum.mix(sized, whole=True).agg(F.sum("taken")).first()[0] == 13_500


def test_ends_of_parts_are_matched_without_their_texts(spark):
    """The plan of the parts' order reads numbers only; every document meets the next one across parts, the last one the first."""
    docs = spark.range(60).selectExpr("id AS doc_id", "concat(repeat(char(97 + id % 26), 8), id) AS text")
    with Scratch(spark) as scratch:
        for parts in (1, 7, 60):
            got = {r.doc_id: r.edited_sha256 for r in fingerprint.compare_with_next(docs, scratch, parts).collect()}
            texts = {r.doc_id: r.text for r in docs.collect()}
            want = {i: t[: len(t) - len(t) // 4] + texts[(i + 1) % 60][: len(t) // 4] for i, t in texts.items()}
            import hashlib

            assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
        plan = fingerprint.compare_with_next(docs, scratch, 7)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan  # the numbers' order is a table by now
