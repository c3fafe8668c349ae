"""Removal of repeated byte strings: a depth-limited radix sort of suffixes by digit passes.

Suffixes are told apart only through their first 200 bytes. The first digit of a suffix is the 64-byte
gram of least hash inside those bytes: equal suffixes have it at the same offset, and neighbouring
suffixes share it, so one row stands for a run of them (about one for 70 bytes). The next digits are the offsets and
the string of the whole run, then of aligned parts of 16 suffixes (first the bytes that all of them share), then of single ones. Each pass deals rows by the digits so far and
drops what is decided: a string that stands twice is repeated with all its suffixes; of what stands alone
only parts that others share the digits with go on to the next pass. What stands alone in the last pass, or alone under its digits
before, is no repeated window; all other windows of grams that occur twice are.

Digits are compared by 128-bit hashes (gram and string), not bytes. What moves: grams of all runs once, runs of
repeated grams twice, compressed texts once, and those of documents with undecided runs twice more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefield.llm.storage import Scratch, bit_filter, cut, merged, pack, unpack

DEPTH, GRAM = 200, 64
#: Widths, in window starts, of the strings that the passes after the first compare.
WIDTHS = (16, 1)
#: Bits of the filter of repeated grams (8 MB).
FILTER_BITS = 1 << 26
_rng = np.random.default_rng(4099)
_TABLES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = tuple(int(x) * 8 + 5 for x in _rng.integers(1 << 40, 1 << 60, 2))
_MASK = (1 << 64) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & _MASK))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prefix(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) + 1
    if which not in _cache or len(_cache[which][0]) < n:
        size = max(n, 1 << 17)
        inverse = pow(_BASES[which], -1, 1 << 64)
        _cache[which] = (_powers(_BASES[which], size), _powers(inverse, size))
    up, down = _cache[which]
    sums = np.zeros(n, np.uint64)
    np.cumsum(_TABLES[which][data] * up[: n - 1], out=sums[1:])
    return sums, down


def _strings(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = (prefix[0][end] - prefix[0][start]) * prefix[1][start]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15)


def runs_of(data: np.ndarray, prefix: tuple) -> tuple[np.ndarray, ...]:
    """Of each run: gram hash, hash of the run's string, place (see :func:`places`) without the check bits."""
    n = len(data) - DEPTH + 1
    at = np.arange(len(data) - GRAM + 1)
    grams = _strings(prefix[0], at, at + GRAM)
    value, place = grams, at
    width, want = 1, DEPTH - GRAM + 1
    while width < want:
        step = min(width, want - width)
        a, b = value[:-step], value[step:]
        less = b < a
        place = np.where(less, place[step:], place[:-step])
        value = np.where(less, b, a)
        width += step
    place = place[:n]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    anchor = place[first]
    return grams[anchor].view(np.int64), _strings(prefix[1], first, first + count - 1 + DEPTH).view(np.int64), places(first, count, anchor - first)


def places(start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """start, count - 1 and the offset of the gram in the first window, in one number. Its low 16 bits tell strings of a gram apart."""
    return (start.astype(np.int64) << 16) | ((count.astype(np.int64) - 1) << 8) | offset


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _check(raw: bytes) -> int:
    """16 more bits by which texts of one key differ, above the place."""
    return (xxhash.xxh3_64_intdigest(raw) & 0xFFFF) << 47


_PLACE = (1 << 47) - 1


def _find_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for text in batch.column(0).to_pylist():
            data = np.frombuffer(_bytes(text), np.uint8)
            if len(data) >= DEPTH:
                parts.append(runs_of(data, (_prefix(data, 0), _prefix(data, 1)))[0])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts))], ["gram"])


def _find_runs(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            parts: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = _bytes(text)
                if len(raw) >= DEPTH:
                    data = np.frombuffer(raw, np.uint8)
                    gram, x, place = runs_of(data, (_prefix(data, 0), _prefix(data, 1)))
                    bit = gram & (FILTER_BITS - 1)
                    some = bits[bit >> 3] >> (bit & 7) & 1 > 0
                    if some.any():
                        parts.append((gram[some], x[some], np.full(some.sum(), key), place[some] | _check(raw)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], ["gram", "x", "key", "place"])

    return run


def split(raw: bytes, strings: list[dict], width: int) -> list[dict]:
    """Strings (gram, place, many) of a text cut into aligned parts of ``width`` offsets, with the hash of each part.

    All windows that a part can have share its core, so two parts have a window in common only if their cores are equal:
    the core becomes a digit, mixed into ``gram``.
    """
    data = np.frombuffer(raw, np.uint8)
    cores, prefix = _prefix(data, 0), _prefix(data, 1)
    gram, place, many = (np.array([s[c] for s in strings]) for c in ("gram", "place", "many"))
    place = place.astype(np.int64) & _PLACE
    start, count, offset = place >> 16, (place >> 8 & 255) + 1, place & 255
    least = offset - count + 1
    first, last = least // width, offset // width
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    block = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    top = np.minimum(offset[of], block * width + width - 1)
    low = np.maximum(least[of], block * width)
    begin = start[of] + offset[of] - top
    x = _strings(prefix, begin, begin + top - low + DEPTH).view(np.int64)
    first = start[of] + offset[of] - block * width
    core = _strings(cores, first, first - width + 1 + DEPTH)
    digit = ((gram[of].view(np.uint64) ^ (core >> np.uint64(29))) * _MIX + core).view(np.int64)
    check = _check(raw)
    return [
        {"gram": g, "x": h, "place": p | check, "many": m}
        for g, h, p, m in zip(digit.tolist(), x.tolist(), places(begin, top - low + 1, top).tolist(), many[of].tolist(), strict=True)
    ]


def kept_bytes(raw: bytes, runs: list[int], lone: list[int]) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256 where every window of ``runs`` but those of ``lone`` is repeated (both places)."""
    gone = np.zeros(max(len(raw) - DEPTH + 1, 0) + 1, np.int32)
    windows = np.zeros(len(gone), bool)
    for values, say in ((runs, True), (lone, False)):
        for p in values:
            at, n = (p & _PLACE) >> 16, (p >> 8 & 255) + 1
            windows[at : at + n] = say
    cover = np.zeros(len(raw) + DEPTH + 1, np.int32)
    at = np.flatnonzero(windows)
    cover[at] += 1
    np.add.at(cover, at + DEPTH, -1)
    gone = np.cumsum(cover)[: len(raw)] > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(raw) else 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()


_RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
_RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_STRING = pa.struct([("gram", pa.int64()), ("x", pa.int64()), ("place", pa.int64()), ("many", pa.bool_())])
_STRING_SQL = "array<struct<gram:bigint,x:bigint,place:bigint,many:boolean>>"
_STATE = {**_RESULT, "key": pa.int64(), "check": pa.int64(), "text": pa.binary(), "runs": pa.list_(pa.int64()), "parts": pa.list_(_STRING)}
_STATE_SQL = f"{_RESULT_SQL}, key long, check long, text binary, runs array<long>, parts {_STRING_SQL}"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        columns = [pa.array([_check(_bytes(t)) for t in texts], pa.int64()), pa.array([pack(t or "") for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "key", "check", "text"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents without undecided runs; of the others the text and the runs; and the parts of undecided strings."""
    for batch in batches:
        out = []
        for doc_id, key, check, packed, runs, strings in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            raw = _bytes(unpack(packed))
            open_ = any(not s["many"] for s in strings or [])
            result = (None,) * 4 if open_ else kept_bytes(raw, runs or [], [])
            parts = split(raw, strings, WIDTHS[0]) if strings else None
            out.append((doc_id, *result, key, check, packed if strings else None, runs if open_ else None, parts))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _STATE.values(), strict=True)], list(_STATE))


def _split_more(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            parts = [split(_bytes(unpack(p)), s, width) for p, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.list_(_STRING))], ["key", "parts"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(i, *kept_bytes(_bytes(unpack(p)), r, lone or [])) for i, p, r, lone in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RESULT.values(), strict=True)], list(_RESULT))


_CHECK_OF = "place & (65535L << 47)"


def _told_apart(rows: DataFrame, many, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One pass over strings (gram, x, key, place): those that go on (with many), and those found alone (key, place).

    ``many`` is the aggregate that says whether a string stands twice. A string that does goes on only as a partner
    of ones that don't.
    """
    shape = F.col("place").bitwiseAND(F.lit(65535)).alias("shape")
    strings = rows.groupBy("gram", shape, "x").agg(many.alias("many"), F.first("key").alias("key"), F.first("place").alias("place"))
    block = F.expr(f"cast(shape & 255 AS int) div {width}").alias("block")
    strings = scratch.keep(strings.withColumn("block", block).select("gram", "block", "key", "place", "many"))
    # a table of its own, so a gram that holds much of the rows can be dealt anew
    open_ = scratch.keep(strings.groupBy("gram", "block").agg(F.count("*").alias("n"), F.max(~F.col("many")).alias("open")).filter("open"))
    known = merged(strings, open_, ["gram", "block"])
    onward = known.filter("n > 1").select("key", "gram", "place", "many")
    return onward, known.filter("n = 1 AND NOT many").select("key", "place")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text; other columns are ignored).

    Every byte under a 200-byte string that starts anywhere else too is removed, judged on the input. Null text is
    empty; shorter texts have no window and stay whole; repeated rows remove each other. No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    keyed = docs.select("doc_id", text).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    with Scratch(spark) as scratch:
        grams = keyed.select("text").mapInArrow(_find_grams, "gram long")
        again = scratch.keep(grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
        marks = spark.sparkContext.broadcast(bit_filter(again, F.col("gram"), FILTER_BITS))
        runs = keyed.select("key", "text").mapInArrow(_find_runs(marks), "gram long, x long, key long, place long")
        alive = scratch.keep(merged(runs, again, ["gram"], "left_semi"))
        # a whole run's offsets are one block
        onward, _ = _told_apart(alive, F.count("*") > 1, 256, scratch)
        check = F.expr(_CHECK_OF).alias("check")
        spans = alive.groupBy("key", check).agg(F.collect_set("place").alias("runs"))
        string = F.struct("gram", "place", "many")
        asked = onward.groupBy("key", check).agg(F.collect_list(string).alias("strings"))
        packed = keyed.mapInArrow(_packed, "doc_id long, key long, check long, text binary")
        joined = merged(merged(packed, spans, ["key", "check"], "left"), asked, ["key", "check"], "left")
        state = scratch.keep(joined.select("doc_id", "key", "check", "text", "runs", "strings").mapInArrow(_settle, _STATE_SQL))
        alone, rows = [], state.filter("parts IS NOT NULL").select("key", F.explode("parts").alias("p")).select("key", "p.*")
        texts = state.filter("text IS NOT NULL").select("key", "check", "text")
        # a part stands twice if its run did or if its places differ; rows of one document that is given twice don't
        many = F.max("many") | (F.min("key") != F.max("key")) | (F.min("place") != F.max("place"))
        for width, next_width in zip(WIDTHS, [*WIDTHS[1:], None], strict=True):
            onward, lone = _told_apart(rows, many, width, scratch)
            if next_width is None:
                # single windows that share offset and gram with others are told apart by now
                alone.append(onward.filter("NOT many").select("key", "place"))
            else:
                asked = onward.groupBy("key", check).agg(F.collect_list(string).alias("strings"))
                parts = merged(texts, asked, ["key", "check"]).select("key", "text", "strings").mapInArrow(_split_more(next_width), f"key long, parts {_STRING_SQL}")
                rows = parts.select("key", F.explode("parts").alias("p")).select("key", "p.*")
            alone.append(lone)
        found = alone[0]
        for more in alone[1:]:
            found = found.unionByName(more)
        found = found.groupBy("key", check).agg(F.collect_set("place").alias("lone"))
        left = merged(state.filter("runs IS NOT NULL").select("doc_id", "key", "check", "text", "runs"), found, ["key", "check"], "left")
        done = left.select("doc_id", "text", "runs", "lone").mapInArrow(_finish, _RESULT_SQL)
        return cut(state.filter("runs IS NULL").select(*_RESULT).unionByName(done))
