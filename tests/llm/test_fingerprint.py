"""Fingerprints against a plain version: all columns, over the given documents and over edge rows."""

import hashlib

import pytest

from stridefield.llm import fingerprint

SF = "/root/testdata/sf0.001"
EDGES = [
    (5, "Straße  und\tWeg " * 9), (5, "Straße  und\tWeg " * 9), (5, "STRASSE und weg " * 9), (None, None), (None, "Ｆｕｌｌ ﬁ"), (None, "full fi"), (-3, ""), (9, "x"),
    (7, "long " * 40_000), (8, "lang " * 40_000), (10, None),
]


def plain(rows):
    """Sorted result rows of (doc_id, text) in the order of doc_id, null last; equal ids must have equal neighbours to be told."""
    from collections import defaultdict

    classes = defaultdict(list)
    for i, t in rows:
        classes[fingerprint.canonical(t)].append(i)
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        own, changed, nxt = (fingerprint.canonical(x) for x in (t, edited, after))
        ids = [x for x in classes[own] if x is not None]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.digest(own), fingerprint.digest(changed),
                    float(own == changed), float(own == nxt), min(ids) if ids else None, len(classes[own])))
    return sorted(map(repr, out))


def result(docs, parts=None):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "copies"]
    return sorted(repr(tuple(r)) for r in fingerprint.fingerprints(docs, parts).select(*names).collect())


@pytest.mark.parametrize("parts", [1, 3, None])
def test_all_columns_of_the_given_documents(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda x: x[0])
    assert len({i for i, _ in rows}) == len(rows)
    assert result(docs, parts) == plain(rows)


def test_edge_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({"_th": F.lit(1), "fingerprint": F.lit("own"), "_end": F.lit("tail")})
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = [(r.doc_id, r.text) for r in sorted(keyed, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))]
    for parts in (1, 4):
        assert result(docs, parts) == plain(rows)


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert result(none) == []
    one = spark.createDataFrame([(3, "abcd efgh")], "doc_id long, text string")
    assert result(one) == plain([(3, "abcd efgh")])
