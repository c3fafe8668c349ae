"""Byte-level BPE against the tokenizer library, document by document."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stridefield.llm import byte_bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("library", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def told(library, text):
    ids = library.encode_ordinary(text)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return ids, len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_documents_as_the_library_does(spark, library, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_byte_bpe(spark, f"/root/testdata/{sf}").collect()}
    assert got == {r.doc_id: told(library, r.text or "")[1:] for r in rows}


def odd_texts():
    # letters and numbers that only newer Unicode tables know, next to all kinds of neighbours
    new = "".join(chr(c) for c in (0x88F, 0x1C89, 0x105C0, 0x10D40, 0x11BC0, 0x16D40, 0x1CCF0, 0x323B0, 0x33479, 0x2EBF0, 0x31350))
    mixed = [f"{c}a{c}1{c} {c}!{c}\n{c}{c}" for c in new]
    return [
        None, "", " ", "\n\n  \n x", "it's we'll  DON'T 'S", "<|endoftext|> stays text", "\x00\x1c\x85  　x", "áé😀👩‍👩‍👧 ١٢٣ ⅷ ½",
        "word " * 300_000, "a" * 700_000, "x" * 3000 + " " * 200_000 + "y", *mixed, "".join(mixed),
    ]


def test_edge_texts_and_other_columns(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 50)
    texts = odd_texts()
    rows = [(i if i % 3 else None, t, "mine", [i], "w") for i, t in enumerate(texts)] + [(7, texts[4], "again", None, "w")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _chunk array<int>, word string")
    got = byte_bpe.encode_documents(docs, PATH, PATTERN)
    assert got.columns == ["doc_id", "_chunk", "word", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(r[0], r[3], r[4], *told(library, r[1] or "")) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert byte_bpe.encode_documents(docs.limit(0), PATH, PATTERN).count() == 0


def test_runs_that_the_library_cannot_split(spark, library):
    """Beyond a million blanks the library's own split fails; the pieces are merged all the same, and decoding gives the text back."""
    text = "x" + " " * 3_000_000 + "y"
    got = byte_bpe.encode_documents(spark.createDataFrame([(text,)], "text string"), PATH, PATTERN).first()
    ranks = {v: k for k, v in byte_bpe.read_ranks(PATH).items()}
    assert b"".join(ranks[i] for i in got.token_ids).decode() == text
    assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.token_ids[:3] == library.encode_ordinary("x" + " " * 3000 + "y")[:3]


def test_decoding_joins_the_table(spark, library):
    ranks = byte_bpe.read_ranks(PATH)
    texts = ["some text, and more", "é😀", "", "word " * 300_000]
    coded = spark.createDataFrame([(i, library.encode_ordinary(t)) for i, t in enumerate(texts)] + [(9, None)], "k int, ids array<int>")
    got = {r.k: bytes(r.decoded) for r in byte_bpe.decode(coded, ranks).collect()}
    assert got == {9: b""} | {i: t.encode() for i, t in enumerate(texts)}
    with pytest.raises(PySparkException, match="no token has the id 999999"):
        byte_bpe.decode(spark.createDataFrame([(1, [5, 999_999])], "k int, ids array<int>"), ranks).collect()


def test_words_of_all_chunks_meet(spark):
    """Rows of one hash come to one task, whatever chunk they are from, and each keeps its chunk and places."""
    words = [b"the", b" same", " wörds".encode()]
    lengths, packed = byte_bpe._pack_words(words)
    assert byte_bpe._unpack_words(lengths, packed) == words
    rows = [(c, h, byte_bpe._pack(np.array([c, 1, 1])), lengths, packed) for c in range(40) for h in range(3)]
    lists = spark.createDataFrame(rows, "_of long, hash int, steps binary, lengths binary, words binary").repartition(7)
    coded = byte_bpe.encode_words(lists, byte_bpe.read_ranks(PATH), 5)
    tasks = coded.select(F.spark_partition_id().alias("task"), "_of").collect()
    assert len(tasks) == 120 and len({r.task for r in tasks}) <= 3
    library = tiktoken.Encoding("library", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    want = [i for w in words for i in library.encode_ordinary(w.decode())]
    for r in coded.collect():
        assert np.cumsum(byte_bpe._unpack(bytes(r.steps))).tolist() == [r._of, r._of + 1, r._of + 2] and byte_bpe._unpack(bytes(r.ids)).tolist() == want


def test_places_stay_where_they_are(spark, monkeypatch):
    """The plan moves words and their ids, and has no exchange above the stored places."""
    plans = []
    real = byte_bpe.cut
    monkeypatch.setattr(byte_bpe, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    byte_bpe.encode_documents(spark.createDataFrame([("a b c",), ("c d",)], "text string"), PATH, PATTERN)
    assert "FlatMapCoGroupsInArrow" in plans[0] and plans[0].count("Exchange hashpartitioning") == 2


def test_packing():
    for places in ([0], [1, 70_000, 3], list(range(1000)), []):
        assert byte_bpe._unpack(byte_bpe._pack(np.array(places, np.uint32))).tolist() == places
