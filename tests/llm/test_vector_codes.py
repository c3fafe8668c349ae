"""Vector codes against plain whole-number arithmetic, and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stridefield.llm import queries, vector_codes


def plainly(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label), all good. Python whole numbers all the way."""
    whole = sorted((i, [math.floor(256 * c) for c in v], label) for i, v, label in rows)
    w = len(whole[0][1]) // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in whole[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b, strict=True))
    near = lambda x, p: min((gap(cut(x, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for _, x, _ in whole:
            for p in range(parts):
                held[p][near(x, p)[1]].append(cut(x, p))
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else e for e, own in zip(book, h, strict=True)] for book, h in zip(books, held, strict=True)]
    coded, sums = {}, {}
    for i, x, label in whole:
        found = [near(x, p) for p in range(parts)]
        coded[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label
        sums[label] = sums.get(label, 0) + coded[i][1]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return {(i, code, error, sums[label]) for i, (code, error, label) in coded.items()}, digest


def found(codes, books):
    rows = {(r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in codes.collect()}
    return rows, vector_codes.books_digest(books)


def made(rows, spark):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_given_table_against_sql_and_plain(spark):
    at = "/root/testdata/sf0.01"
    got = queries.op13_vector_codes(spark, at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.OP13_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 500
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    plain, digest = plainly(rows)
    assert {r[:4] for r in want} == plain and {r[4] for r in want} == {digest}


def test_ties_copies_and_negative_numbers(spark):
    """Whole small components, so equal distances, unused entries and one-entry lists all occur; a third of the rows is one vector."""
    rng = np.random.default_rng(5)
    grid = [(i, [float(c) / 256 for c in rng.integers(-2, 3, 32)] if i % 3 else [0.5] * 32, None if i % 4 == 0 else int(i % 3)) for i in range(900)]
    far = [(900 + i, [float(c) for c in 100 * np.sign(rng.normal(size=32))], 7) for i in range(300)]
    vectors = made(grid + far, spark).repartition(5)
    assert found(*vector_codes.compress(vectors)) == plainly(grid + far)
    few = grid[:10]
    assert found(*vector_codes.compress(made(few, spark))) == plainly(few)


def test_rows_that_are_dropped(spark):
    good = [(i, [float((i * 7 + k) % 11) - 5 for k in range(16)], i % 2) for i in range(80)]
    bad = [
        (-1, None, 1), (-2, [], 1), (-3, [None] + [1.0] * 15, 1), (-4, [math.nan] + [1.0] * 15, 1), (-5, [math.inf] * 16, 1), (-6, [-math.inf] + [0.0] * 15, None), (-7, [1.0] * 15, 1),
        (500, [1.0] * 32, 1), (501, [3e38] * 16, 1),
    ]
    vectors = made(good + bad, spark).withColumn("code", F.lit(1)).withColumn("x", F.lit("mine"))
    assert found(*vector_codes.compress(vectors)) == plainly(good)
    codes, books = vector_codes.compress(vectors.limit(0))
    assert codes.count() == 0 and books.size == 0 and codes.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_null_and_repeated_ids(spark):
    rows = [(None, [9.0] * 16, 1), (3, [2.0] * 16, 1), (3, [1.0] * 16, None), (None, [9.0] * 16, None)]
    codes, books = vector_codes.compress(made(rows, spark))
    assert books[0, :, 0].tolist() == [256, 512, 2304, 2304]  # equal ids by vector, null ids last
    assert sorted((r.vec_id or 0, bytes(r.code)[0], r.error) for r in codes.collect()) == [(0, 2, 0), (0, 2, 0), (3, 0, 0), (3, 1, 0)]


def test_the_curve_goes_through_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = vector_codes.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        way = cells[np.argsort(place)]
        assert (np.abs(np.diff(way, axis=0)).sum(1) == 1).all()


def test_short_lists_hold_every_nearest_entry():
    rng = np.random.default_rng(1)
    for _ in range(200):
        books = rng.integers(-8, 9, (1, 20, 3))
        x = rng.integers(-8, 9, (int(rng.integers(1, 9)), 3))
        short = vector_codes.shortlists(x.min(0)[None], x.max(0)[None], books)[0]
        gaps = ((x[:, None] - books[0][None]) ** 2).sum(2)
        assert short[np.unique(np.nonzero(gaps == gaps.min(1, keepdims=True))[1])].all()


def test_lists_are_shorter_than_the_codebooks(spark):
    rows = vector_codes.whole_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    codes, books = vector_codes.compress(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    x = np.array([r.x for r in rows.collect()], np.int64)
    restored = {r.vec_id: np.array(r.x) for r in vector_codes.restore(codes, books).collect()}
    ids = [r.vec_id for r in rows.select("vec_id").collect()]
    error = {r.vec_id: r.error for r in codes.collect()}
    for i, row in zip(ids[:50], x[:50], strict=True):
        assert round(float(((restored[i] * 256 - row) ** 2).sum())) == error[i]


@pytest.mark.parametrize("top", [vector_codes.MOST])
def test_largest_numbers_are_exact(spark, top):
    edge = top / 256
    rows = [(i, [edge - 1 if (i >> (k % 4)) & 1 else -edge + 1 for k in range(64)], 0) for i in range(70)]
    got, _ = found(*vector_codes.compress(made(rows, spark)))
    assert got == plainly(rows)[0]
