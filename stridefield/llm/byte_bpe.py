"""Byte-level BPE encoding and decoding: every distinct pre-token is encoded once, in one shuffle of words for all documents.

Documents are split by the tokenizer's pattern. Some eight million characters of whole documents make a chunk; in it a pre-token is a
place in the chunk's list of distinct words, and the chunk keeps the row of its places, packed. So a word that stands in every
document moves once a chunk, not once a position, and no word is a hot key. The lists are exploded by the hash of their words
and dealt by it; each distinct word of the whole table is encoded once, its ids go back to the chunks it came from, and documents
are put together by position. Decoding joins ids with the table of token bytes.

The library that the result has to agree with knows an older Unicode than the pattern module here may know. Where both disagree with
Python's own tables, that library is asked for the class of the code point (see :func:`splitter`).

Shuffles: the distinct words of each chunk, and their ids, both packed by chunk and hash. Places are stored in buckets of their chunk and
stay where they are. The vocabulary (one row a token) is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefield.llm.storage import Scratch, cut

#: Characters of whole documents in a chunk; a longer document is a chunk of its own.
CHUNK_CHARS = 1 << 23
#: Pre-tokens of a document that are held at a time.
HELD_PIECES = 1 << 20
#: Takes a pre-token whole, so the library merges it as one piece.
WHOLE = r"[\s\S]+"
_MADE = ("text", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids, from a file of base64 and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def splitter(pattern: str) -> tuple[str, str, str]:
    """The pattern, the same with the letters and numbers of the tokenizer library, and a class of the characters that make a difference.

    Code points whose class differs between Python's Unicode tables and the pattern module's are put to the library: with ranks
    that merge the character with a letter (or a digit), both are one token exactly if the library takes it for one class.
    """
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    careful, differ = pattern, []
    for kind, mate in (("L", "a"), ("N", "1")):
        known = set(regex.findall(rf"\p{{{kind}}}", every))
        doubtful = sorted(known ^ {c for c in every if unicodedata.category(c)[0] == kind})
        ranks = {bytes([i]): i for i in range(256)}
        for c in doubtful:
            for end in range(2, len(c.encode()) + 1):
                ranks.setdefault(c.encode()[:end], len(ranks))
        for c in doubtful:
            ranks.setdefault((c + mate).encode(), len(ranks))
        asked = tiktoken.Encoding("classes", pat_str=rf"\p{{{kind}}}+|[\s\S]", mergeable_ranks=ranks, special_tokens={})
        wrong = [c for c in doubtful if (len(asked.encode_ordinary(c + mate)) == 1) != (c in known)]
        less, more = (_ranges([c for c in wrong if (c in known) is held]) for held in (True, False))
        own = rf"[\p{{{kind}}}{more}]"
        # a class in place of a class also holds inside the pattern's sets
        careful = careful.replace(rf"\p{{{kind}}}", f"[{own}--[{less}]]" if less else own)
        differ += wrong
    return pattern, f"(?V1){careful}", f"[{_ranges(sorted(differ))}]" if differ else r"(?!)"


def _ranges(chars: list[str]) -> str:
    """Sorted characters as ranges of a set."""
    runs: list[list[int]] = []
    for c in map(ord, chars):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte plane, compressed: the planes of high bytes are next to nothing."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")


def _pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths and bytes of the words, packed."""
    return _pack(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def _unpack_words(lengths: bytes, words: bytes) -> list[bytes]:
    whole, ends = zstandard.ZstdDecompressor().decompress(words), np.cumsum(_unpack(lengths), dtype=np.int64).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_WORDS = pa.list_(pa.struct([("hash", pa.int32()), ("steps", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())]))


def _chunked(patterns: tuple[str, str, str], parts: int):
    def listed(index: dict[str, int]) -> list[dict]:
        """The words by hash, in order, with the steps from one place to the next."""
        own: dict[int, tuple[list[int], list[bytes]]] = {}
        for at, word in enumerate(index):
            raw = word.encode()
            places, words = own.setdefault(zlib.crc32(raw) % parts, ([], []))
            places.append(at)
            words.append(raw)
        return [{"hash": h, "steps": _pack(np.diff(places, prepend=0)), **dict(zip(("lengths", "words"), _pack_words(words), strict=True))} for h, (places, words) in own.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, careful, differ = map(regex.compile, patterns)
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(0)
            rest = pa.StructArray.from_arrays([*batch.columns[1:], pa.array(range(batch.num_rows), pa.int32())], [*batch.schema.names[1:], "_nth"])
            begin, chars, index, held, sizes = 0, 0, {}, [], []
            for at in range(batch.num_rows):
                text = texts[at].as_py() or ""
                find = plain if text.isascii() or not differ.search(text) else careful
                pieces = (m.group() for m in find.finditer(text)) if len(text) > HELD_PIECES else iter(find.findall(text))
                size = 0
                while some := list(islice(pieces, HELD_PIECES)):
                    held.append(np.fromiter((index.setdefault(w, len(index)) for w in some), np.uint32, len(some)))
                    size += len(some)
                sizes.append(size)
                chars += len(text)
                if chars >= CHUNK_CHARS or at + 1 == batch.num_rows:
                    n = len(sizes)
                    packed = _pack(np.concatenate(held)) if held else None
                    rows = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rest.slice(begin, n))
                    one = [pa.array([made], pa.int64()), rows, pa.array([sizes], pa.list_(pa.int32())), pa.array([packed], pa.binary()), pa.array([listed(index)], _WORDS)]
                    yield pa.RecordBatch.from_arrays(one, ["_chunk", "_rows", "_sizes", "_places", "_words"])
                    begin, chars, index, held, sizes, made = at + 1, 0, {}, [], [], made + 1

    return run


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    return flat[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]


def encode_words(lists: DataFrame, ranks: dict[bytes, int], parts: int) -> DataFrame:
    """_of, steps, counts, ids of each row of ``lists`` (_of, hash, steps, lengths, words): how many ids its words have, and the ids.

    Rows are dealt by the hash of their words, so a word's rows meet in one task, in which it is encoded once as one piece. A task
    holds the distinct words of one hash at a time.
    """
    shared = lists.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tiktoken.Encoding("pieces", pat_str=WHOLE, mergeable_ranks=shared.value, special_tokens={})
        last, known = None, {}
        for batch in batches:
            out = []
            for of, own, steps, lengths, packed in zip(*[batch.column(c).to_pylist() for c in ("_of", "hash", "steps", "lengths", "words")], strict=True):
                if own != last:
                    last, known = own, {}
                coded = []
                for word in _unpack_words(lengths, packed):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = code.encode_ordinary(word.decode())
                    coded.append(ids)
                out.append((of, steps, _pack(np.fromiter(map(len, coded), np.uint32, len(coded))), _pack(np.fromiter(chain.from_iterable(coded), np.uint32))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], ["_of", "steps", "counts", "ids"])

    return lists.repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(run, "_of long, steps binary, counts binary, ids binary")


class TokenBytes:
    """The table of token ids and bytes, for joins inside a batch."""

    def __init__(self, ranks: dict[bytes, int]):
        order = sorted(ranks, key=ranks.__getitem__)
        self.ids, self.tokens = np.array([ranks[t] for t in order], np.int64), pa.array(order, pa.binary())

    def of(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Bytes of each run of ``ids``, from ``offsets[k]`` to ``offsets[k + 1]``."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        lost = self.ids[at] != ids if len(self.ids) else np.ones(len(ids), bool)
        if lost.any():
            raise ValueError(f"no token has the id {ids[lost][0]}")
        runs = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.tokens.take(pa.array(at)).cast(pa.large_binary()))
        return pc.binary_join(runs, pa.scalar(b"", pa.large_binary()))


def decode(coded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded`` (binary): the bytes of the array ``ids`` of each row, joined with the vocabulary in place. No shuffle.

    Null or empty ids give no bytes; an id that the vocabulary lacks is an error.
    """
    shared = coded.sparkSession.sparkContext.broadcast(ranks)
    rest = [f for f in coded.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes(shared.value)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            offsets = np.cumsum([0, *[len(x or ()) for x in lists]])
            flat = np.fromiter((i for x in lists for i in x or ()), np.int64, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens.of(flat, offsets).cast(pa.binary())], [*batch.schema.names, "decoded"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return coded.select(*[F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, f"{shape}, decoded binary")


def _assembled(names: list[str], shared, ids: bool):
    def run(chunk: pa.Table, words: pa.Table) -> pa.Table:
        unpacked = lambda c: [*map(_unpack, words.column(c).to_pylist()), np.zeros(0, np.uint32)]
        order = np.argsort(np.concatenate([np.cumsum(s) for s in unpacked("steps")]))
        counts, flat = np.concatenate(unpacked("counts")).astype(np.int64), np.concatenate(unpacked("ids"))
        starts = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        flat, starts = _gather(flat, starts, counts), np.cumsum(counts) - counts
        bytes_of = TokenBytes(shared.value).of(flat.astype(np.int64), np.concatenate((starts, [len(flat)]))).to_pylist()
        told = list(map(str, flat.tolist()))
        said = [" ".join(told[s : s + n]).encode() for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
        rows = chunk.column("_rows").combine_chunks().flatten()
        packed, at = chunk.column("_places")[0].as_py(), 0
        places = _unpack(packed) if packed else np.zeros(0, np.uint32)
        n_tokens, shas, decoded, lists = [], [], [], []
        for size in chunk.column("_sizes")[0].as_py():
            own, at = places[at : at + size], at + size
            n_tokens.append(int(counts[own].sum()))
            sha, back = hashlib.sha256(), hashlib.sha256()
            for low in range(0, size, HELD_PIECES):
                some = own[low : low + HELD_PIECES].tolist()
                sha.update(b" " * (low > 0) + b" ".join(map(said.__getitem__, some)))
                back.update(b"".join(map(bytes_of.__getitem__, some)))
            shas.append(sha.hexdigest())
            decoded.append(back.hexdigest())
            if ids:
                lists.append(_gather(flat, starts[own], counts[own]).astype(np.int32))
        out = [rows.field(c) for c in names]
        if ids:
            out.append(pa.array(lists, pa.list_(pa.int32())))
        out += [pa.array(n_tokens, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
        return pa.table(out, [*names, *(_MADE[1:] if ids else _MADE[2:])])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """``docs`` with text replaced by token_ids (array<int>, only with ``ids``), n_tokens, ids_sha256 and decoded_sha256.

    ``path`` names a file of ranks, ``pattern`` splits a text before the merges. ids_sha256 is over the decimal ids joined by one space,
    decoded_sha256 over the bytes that the ids decode to. Null and empty texts have no tokens. Other columns stay, but for those
    names; rows need no key, so repeated and null ids are rows of their own. No rows give no rows.
    """
    spark, ranks = docs.sparkSession, read_ranks(path)
    rest = [f for f in docs.schema.fields if f.name not in _MADE]
    own = {f.name: f"_own{i}" for i, f in enumerate(rest)}  # names of callers can't meet ours
    fields = [f"{own[f.name]}: {f.dataType.simpleString()}" for f in rest]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch:
        read = docs.select("text", *[F.col(f"`{n}`").alias(o) for n, o in own.items()])
        shape = f"_chunk long, _rows array<struct<{', '.join([*fields, '_nth: int'])}>>, _sizes array<int>, _places binary, _words array<struct<hash: int, steps: binary, lengths: binary, words: binary>>"
        chunks = scratch.keep_bucketed(read.mapInArrow(_chunked(splitter(pattern), parts), shape), "_chunk", parts)
        coded = encode_words(chunks.select(F.col("_chunk").alias("_of"), F.inline("_words")), ranks, parts)
        made = ("token_ids array<int>, " if ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"
        pairs = chunks.drop("_words").groupBy("_chunk").cogroup(coded.groupBy("_of"))
        done = pairs.applyInArrow(_assembled(list(own.values()), spark.sparkContext.broadcast(ranks), ids), ", ".join([*fields, made]))
        return cut(done).withColumnsRenamed({o: n for n, o in own.items()})
