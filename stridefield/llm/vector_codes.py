"""Vector code compression: product codes of whole-number vectors, fitted exactly over all rows.

Vectors are range-sorted once along a Hilbert curve through eight fixed random sums of their components, and packed into flat blocks
of neighbours. A block stores its matrix, and for each part position the box (least and greatest components) and the sum of its vectors. In
each round, the distances from a block's boxes to the codebook entries leave a short list of entries for each part: those that
can be as near as the entry whose farthest point of the box is nearest. A list of one entry takes the whole block by its stored
sum; other lists are evaluated for the block's vectors with 64-bit integers, so ties are exact.

One shuffle of the vectors; rounds read the blocks and shuffle one row a codebook entry and task. Codebooks (entries times
components numbers) are all that comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefield.llm.storage import Scratch, cut, merged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers from -MOST on and under MOST are taken: their squared distances, summed over up to 2,048 components, fit a long.
MOST = 1 << 25
BLOCK = 256
CURVE_SUMS, CURVE_BITS = 8, 8


def whole_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, x (array<int>): floor(256 * component) of the rows that are kept.

    Dropped are rows whose vector is null or empty, holds null, NaN, an infinity or a number outside MOST, or can't be cut into
    ``parts`` equal parts.
    """
    v = F.col("embedding")
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < MOST / SCALE)
    good = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, ok)
    return vectors.filter(good).select("vec_id", "label", F.transform(x, lambda c: c.cast("int")).alias("x"))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve (unsigned 64-bit) of rows of whole numbers under 2^bits; columns times bits are at most 64."""
    x = points.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << one | (x[i] >> np.uint64(b) & one)
    return place


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(width).choice(np.array([-1, 1], np.int64), (width, CURVE_SUMS))


def _extent(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = None, None
        for batch in batches:
            if batch.num_rows:
                s = _matrix(batch.column(0), width) @ _signs(width)
                lo = s.min(0) if lo is None else np.minimum(lo, s.min(0))
                hi = s.max(0) if hi is None else np.maximum(hi, s.max(0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CURVE_SUMS), pa.int32()), pa.array(lo), pa.array(hi)], ["i", "lo", "hi"])

    return run


def _placed(width: int, lo: np.ndarray, hi: np.ndarray):
    wide = np.maximum(1, hi - lo + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), width)
                place = hilbert((x @ _signs(width) - lo) * (1 << CURVE_BITS) // wide, CURVE_BITS)
                packed = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
                # the sign bit is turned, so that signed longs sort as the curve does
                key = pa.array((place ^ np.uint64(1 << 63)).view(np.int64))
                yield pa.RecordBatch.from_arrays([key, batch.column("vec_id"), batch.column("label"), batch.column("_row"), packed], ["_key", "vec_id", "label", "_row", "x"])

    return run


def _blocks(width: int):
    def block(rows: list[tuple]) -> tuple:
        x = np.frombuffer(b"".join(r[2] for r in rows), "<i4").reshape(-1, width)
        return [r[0] for r in rows], [r[1] for r in rows], x.tobytes(), x.min(0), x.max(0), x.sum(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*[batch.column(c).to_pylist() for c in ("vec_id", "label", "x")], strict=True)
            full = len(held) // BLOCK * BLOCK
            if full:
                yield made([block(held[i : i + BLOCK]) for i in range(0, full, BLOCK)], batch.schema)
                held = held[full:]
            schema = batch.schema
        if held:
            yield made([block(held)], schema)

    def made(blocks: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = [pa.list_(schema.field("vec_id").type), pa.list_(schema.field("label").type), pa.binary(), ints, ints, longs]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), kinds, strict=True)], ["vec_ids", "labels", "matrix", "lo", "hi", "sums"])

    return run


def flat_blocks(rows: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """vec_ids, labels, matrix, lo, hi, sums: ``rows`` (vec_id, label, x of ``width`` components) in blocks along the curve.

    The curve is laid through the extent of the sums over all rows (one small job). Equal vectors are told apart by row, so many copies spread.
    """
    ends = rows.select("x").mapInArrow(_extent(width), "i int, lo long, hi long").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()
    lo, hi = (np.array([r[c] for r in ends], np.int64) for c in ("lo", "hi"))
    ids, label = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    read = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = read.mapInArrow(_placed(width, lo, hi), f"_key long, vec_id {ids}, label {label}, _row long, x binary")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(n, "_key", "_row").sortWithinPartitions("_key", "_row")
    return scratch.keep(ordered.mapInArrow(_blocks(width), f"vec_ids array<{ids}>, labels array<{label}>, matrix binary, lo array<int>, hi array<int>, sums array<long>"))


def shortlists(lo: np.ndarray, hi: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Which entries of ``books`` (parts, entries, w) may be nearest to some point of the boxes ``lo`` to ``hi`` (parts, w)."""
    gap = np.maximum(np.maximum(lo[:, None] - books, books - hi[:, None]), 0)
    far = np.maximum(np.abs(books - lo[:, None]), np.abs(books - hi[:, None]))
    near, far = (gap * gap).sum(2), (far * far).sum(2)
    return near <= far.min(1, keepdims=True)


def _read_block(batch: pa.RecordBatch, i: int, books: np.ndarray):
    """matrix (rows, parts, w), sums (parts, w), short lists (parts, entries) of a block."""
    parts, _, w = books.shape
    x = np.frombuffer(batch.column("matrix")[i].as_py(), "<i4").reshape(-1, parts, w).astype(np.int64)
    lo, hi, sums = (batch.column(c)[i].values.to_numpy().astype(np.int64).reshape(parts, w) for c in ("lo", "hi", "sums"))
    return x, sums, shortlists(lo, hi, books)


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of ``entries`` (the first on ties) and its squared distance, for rows ``x``."""
    apart = x[:, None] - entries[None]
    squared = np.einsum("nkw,nkw->nk", apart, apart)
    at = squared.argmin(1)
    return at, squared[np.arange(len(x)), at]


def _totals(books: np.ndarray):
    parts, n_entries, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, n_entries), np.int64), np.zeros((parts, n_entries, w), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                x, sums, short = _read_block(batch, i, books)
                for p in range(parts):
                    listed = np.flatnonzero(short[p])
                    if len(listed) == 1:
                        count[p, listed[0]] += len(x)
                        total[p, listed[0]] += sums[p]
                        continue
                    at, _ = _nearest(x[:, p], books[p, listed])
                    hits = (at[None] == np.arange(len(listed))[:, None]).astype(np.int64)
                    count[p, listed] += hits.sum(1)
                    total[p, listed] += hits @ x[:, p]
        part, entry = np.nonzero(count)
        if len(part):
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    return run


def _coded(books: np.ndarray):
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, _, short = _read_block(batch, i, books)
                code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p in range(parts):
                    listed = np.flatnonzero(short[p])
                    at, squared = _nearest(x[:, p], books[p, listed])
                    code[:, p] = listed[at]
                    error += squared
                columns = [batch.column("vec_ids")[i].values, batch.column("labels")[i].values, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floors of the means of the parts next to each entry; entries that none is next to stay."""
    w = books.shape[2]
    found = blocks.select("matrix", "lo", "hi", "sums").mapInArrow(_totals(books), "part int, entry int, n long, total array<long>")
    sums = [F.sum(F.col("total")[i]) for i in range(w)]
    out = books.copy()
    # at most one row an entry of the codebooks
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*sums).alias("total")).collect():
        out[r.part, r.entry] = np.array(r.total, np.int64) // r.n
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (binary, a byte a part), error, label_error of every kept row; and the codebooks (parts, entries, w).

    vectors: vec_id, embedding, label; see :func:`whole_vectors` for the rows that are dropped. Of the others, rows of another length than the one
    of the least vec_id are dropped too. Codebooks begin with the ``entries`` (at most 256) least vec_ids (null last, equal ids by their vectors), or all
    if there are fewer. label_error is the error summed over rows of the same label, null being one. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, parts)
    order = [F.col("vec_id").asc_nulls_last(), F.col("x").asc()]
    first = rows.orderBy(*order).limit(1).collect()
    width = len(first[0].x) if first else parts
    rows = rows.filter(F.size("x") == width)
    first = rows.orderBy(*order).limit(entries).collect()
    books = np.array([r.x for r in first], np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2).copy()
    ids, label = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    if not first:
        none = rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.limit(0), books
    with Scratch(spark) as scratch:
        blocks = flat_blocks(rows, width, scratch)
        for _ in range(rounds):
            books = next_books(blocks, books)
        made = blocks.mapInArrow(_coded(books), f"vec_id {ids}, label {label}, code binary, error long")
        coded = scratch.keep(made.withColumns({"_l": F.coalesce(F.col("label"), F.lit(0).cast(label)), "_none": F.col("label").isNull()}))
        # a table of its own, so a label that holds much of the rows can be dealt anew
        summed = scratch.keep(coded.groupBy("_l", "_none").agg(F.sum("error").alias("label_error")))
        return cut(merged(coded, summed, ["_l", "_none"]).select("vec_id", "label", "code", "error", "label_error")), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all whole numbers of the codebooks by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def restore(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and x (array<double>): the vectors that the codes stand for, at the scale of the embeddings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(books))
            x = books[np.arange(len(books))[None], code].reshape(len(code), -1) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "x"])

    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {codes.schema['vec_id'].dataType.simpleString()}, x array<double>")
