"""Removal of repeated strings against a plain count of all windows, on all five columns."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stridefield.llm import suffix_dedup

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def plain(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def result(docs):
    return sorted(repr(tuple(r)) for r in suffix_dedup.remove_repeats(docs).select(*NAMES).collect())


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert result(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_passages_edits_and_periods(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randrange(40, 140))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(shared)
            if rng.random() < 0.5:  # a piece of a passage, or one with a letter changed
                a = rng.randrange(len(p) // 2)
                p = p[a : a + rng.randrange(100, 400)]
            if rng.random() < 0.5:
                a = rng.randrange(len(p))
                p = p[:a] + "X" + p[a + 1 :]
            parts += [p, " ".join(word() for _ in range(rng.randrange(30)))]
        rows.append((k, "".join(parts)))
    rows += [(100, "ab" * 300), (101, "ab" * 130), (102, "a" * 199), (103, "a" * 200), (104, "a" * 201), (105, rows[3][1] + rows[3][1])]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_edge_rows(spark):
    words = " ".join(f"w{k * k}" for k in range(300))
    rows = [(1, None), (2, ""), (None, words), (None, words), (3, words[100:900]), (4, words), (4, words), (4, words + "!"), (5, "y" * 3_000), (6, " ".join(f"v{k}" for k in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "gram", "place", "check", "runs")})
    assert result(docs) == plain(rows)
    assert result(docs.limit(0)) == []
    # a row given twice, alone: both copies go; a text that is a part of its own copy too
    rows = [(1, words), (1, words)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
