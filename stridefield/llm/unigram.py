"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces come from a public tokenizer file, whose path is a parameter; nothing is trained. Its pieces
are ranked, not weighted, so the log scores are synthetic: minus the log of the rank, by Zipf's law. Bytes that no piece
covers use byte pieces, at a score under every other piece, so any text can be encoded.

A blank stands for the white-space marker: a text is given one blank in front, and decoding takes it
away again. A marker character that is in a text itself goes through byte pieces, so decoding gives back
exactly the text that was encoded.

Pieces have blanks only in front, so the best path splits at blanks and equal segments have equal
paths: new segments of one length are solved together with numpy, and a bounded cache keeps them.
No shuffle. The trie is broadcast; its size is the vocabulary's.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: How far the score of a byte piece is under the least piece score.
BYTE_PENALTY = 10.0
CACHE_SEGMENTS = 400_000
BLOCK_BYTES = 100_000
SEGMENT = re.compile(r" *[^ ]+| +")


class Vocabulary:
    """Double-array trie with piece ids and log scores; byte_ids[b] is the piece of byte b."""

    def __init__(self, pieces: dict[bytes, tuple[int, float]], byte_ids: list[int], texts: list[bytes]):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.texts = texts
        self.longest = max((len(p) for p in pieces), default=1)
        self.base, self.check, self.value = _double_array(sorted(pieces), pieces)
        self.scores = np.full(len(texts), 0.0)
        for piece_id, score in pieces.values():
            self.scores[piece_id] = score
        self.byte_score = min((s for _, s in pieces.values()), default=0.0) - BYTE_PENALTY
        self.splits = all(b" " not in p.lstrip(b" ") for p in pieces)


def _double_array(keys: list[bytes], pieces: dict[bytes, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: the child of state s by byte c is base[s] + c if check[base[s] + c] == s."""
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    free_from = fresh = 1
    todo = [(0, 0, len(keys), 0)]  # state, range of keys, depth
    while todo:
        state, lo, hi, depth = todo.pop()
        groups: list[tuple[int, int, int]] = []
        while lo < hi:
            if len(keys[lo]) == depth:
                value[state] = pieces[keys[lo]][0]
                lo += 1
                continue
            c, start = keys[lo][depth], lo
            while lo < hi and keys[lo][depth] == c:
                lo += 1
            groups.append((c, start, lo))
        if not groups:
            continue
        codes = np.array([c for c, _, _ in groups])
        while check[free_from] >= 0:
            free_from += 1
        # a node of one child fills a gap; one of several takes fresh room at the end, so nothing is searched for
        at = free_from - int(codes[0]) if len(codes) == 1 and free_from > int(codes[0]) else fresh
        while at + 512 >= size:
            base, check, value = (np.concatenate((x, np.full(size, f, np.int32))) for x, f in ((base, 0), (check, -1), (value, -1)))
            size *= 2
        base[state] = at
        check[at + codes] = state
        fresh = max(fresh, at + int(codes[-1]) + 1)
        todo += [(at + c, a, b, depth + 1) for c, a, b in groups]
    end = fresh + 512
    return base[:end], check[:end], value[:end]


@lru_cache(maxsize=2)
def load(path: str = PIECES) -> Vocabulary:
    """The pieces of a model file. Its order is kept, but the file has no log scores: these are made up from the rank by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts, byte_ids, ranked = [b""] * n, [0] * 256, []
    for i in range(n):
        if model.is_byte(i):
            byte = int(model.id_to_piece(i)[3:-1], 16)
            byte_ids[byte], texts[i] = i, bytes([byte])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            texts[i] = model.id_to_piece(i).replace(MARKER, " ").encode()
            ranked.append((-model.get_score(i), i))
    ranked.sort()
    total = math.log(sum(1 / (r + 3) for r in range(len(ranked))))
    pieces = {texts[i]: (i, -math.log(r + 3) - total) for r, (_, i) in enumerate(ranked) if texts[i]}
    return Vocabulary(pieces, byte_ids, texts)


def viterbi(segments: list[bytes], v: Vocabulary) -> list[bytes]:
    """The best piece ids of each segment (32-bit little-endian); all segments are of one length.

    Of equal scores the path with the longest last piece wins. The pieces that end at a byte stand in one row, longest
    first, so each byte position is settled for all segments by one maximum.
    """
    k, n = len(segments), len(segments[0])
    text = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64)
    # all pieces that start at each byte
    start, state = np.arange(k * n), np.zeros(k * n, np.int64)
    room = n - start % n
    edges = [(start, v.byte_ids[text].astype(np.int32), np.full(k * n, v.byte_score))]
    found_at = [0]
    for depth in range(min(v.longest, n)):
        inside = room[start] > depth
        start, state = start[inside], state[inside]
        nxt = v.base[state].astype(np.int64) + text[start + depth]
        ok = v.check[nxt] == state
        start, state = start[ok], nxt[ok]
        if not len(start):
            break
        ids = v.value[state]
        found = ids >= 0
        edges.append((start[found] + depth, ids[found], v.scores[ids[found]]))
        found_at.append(depth)
    deepest = max(found_at) + 1
    score = np.full(k * n * deepest, -np.inf)
    piece = np.zeros(k * n * deepest, np.int32)
    for (end, ids, value), depth in zip(edges, found_at, strict=True):
        place = end * deepest + (deepest - 1 - depth)
        score[place], piece[place] = value, ids
    score, piece = score.reshape(k, n, deepest), piece.reshape(k, n, deepest)
    rows = np.arange(k)
    best = np.full((k, deepest + n), -np.inf)
    best[:, deepest - 1] = 0.0
    last = np.zeros((k, n), np.int32)
    for t in range(n):
        reached = best[:, t : t + deepest] + score[:, t]
        top = reached.argmax(axis=1)
        best[:, deepest + t] = reached[rows, top]
        last[:, t] = top
    path = np.zeros((k, n), np.int32)
    at, used = np.full(k, n - 1), np.zeros(k, np.int64)
    live = rows
    while len(live):
        here = at[live]
        top = last[live, here]
        path[live, n - 1 - used[live]] = piece[live, here, top]
        used[live] += 1
        at[live] = here - (deepest - top)
        live = live[at[live] >= 0]
    whole = path.astype("<i4").tobytes()
    return [whole[4 * (i * n - u) : 4 * i * n] for i, u in enumerate(used.tolist(), 1)]


def viterbi_long(text: bytes, v: Vocabulary, window: int = BLOCK_BYTES) -> bytes:
    """The same path as :func:`viterbi` for one segment of any length, in windows of end positions.

    Best scores are carried from window to window; for the whole segment only the length and id of the best last piece of each byte
    are kept, some six bytes each.
    """
    n, longest = len(text), min(v.longest, len(text))
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    length, chosen = np.zeros(n, np.uint16), np.zeros(n, np.int32)
    best = np.full(longest + window, -np.inf)
    best[longest - 1] = 0.0
    for low in range(0, n, window):
        high = min(n, low + window)
        since = max(0, low - longest + 1)  # the first byte at which a piece that ends here can start
        score, piece = np.full((high - low, longest), -np.inf), np.zeros((high - low, longest), np.int32)
        score[:, longest - 1], piece[:, longest - 1] = v.byte_score, v.byte_ids[data[low:high]]
        start, state = np.arange(since, high), np.zeros(high - since, np.int64)
        for depth in range(longest):
            inside = start + depth < high
            start, state = start[inside], state[inside]
            nxt = v.base[state].astype(np.int64) + data[start + depth]
            ok = v.check[nxt] == state
            start, state = start[ok], nxt[ok]
            if not len(start):
                break
            ids = v.value[state]
            found = (ids >= 0) & (start + depth >= low)
            row = start[found] + depth - low
            score[row, longest - 1 - depth], piece[row, longest - 1 - depth] = v.scores[ids[found]], ids[found]
        for t in range(high - low):
            reached = best[t : t + longest] + score[t]
            top = int(reached.argmax())
            best[longest + t] = reached[top]
            length[low + t], chosen[low + t] = longest - top, piece[t, top]
        best[:longest] = best[high - low : high - low + longest].copy()
    path, at = [], n - 1
    while at >= 0:
        path.append(chosen[at])
        at -= int(length[at])
    return np.array(path[::-1], "<i4").tobytes()


class Encoder:
    """Encodes batches of texts; keeps the ids of segments seen before, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Piece ids of each text as little-endian 32-bit integers."""
        if self.v.splits:
            split = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        else:
            split = [[" " + t] if t else [] for t in texts]
        known = self.known
        new = {s for segments in split for s in segments if s not in known}
        if len(known) + len(new) > CACHE_SEGMENTS:
            known.clear()
            new = {s for segments in split for s in segments}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for segment in new:
            raw = segment.encode("utf-8", "surrogatepass")
            by_length.setdefault(len(raw), []).append((segment, raw))
        for length, group in by_length.items():
            if length > BLOCK_BYTES:
                known.update((segment, viterbi_long(raw, self.v)) for segment, raw in group)
                continue
            step = max(1, BLOCK_BYTES // length)  # a bounded number of bytes at a time
            for at in range(0, len(group), step):
                part = group[at : at + step]
                known.update(zip([s for s, _ in part], viterbi([raw for _, raw in part], self.v), strict=True))
        done = [b"".join(map(known.__getitem__, segments)) for segments in split]
        if len(known) > CACHE_SEGMENTS:
            known.clear()
        return done

    def decode(self, ids: bytes) -> str:
        pieces = self.v.texts
        whole = b"".join([pieces[i] for i in np.frombuffer(ids, "<i4").tolist()])
        return whole[1:].decode("utf-8", "surrogatepass")


def encode_documents(docs: DataFrame, path: str = PIECES, ids: bool = True) -> DataFrame:
    """``docs`` with text replaced by: token_ids (array<int>, only with ``ids``), n_tokens, ids_sha256, decoded_sha256, round_trip.

    ids_sha256 is over the ids as little-endian 32-bit integers, decoded_sha256 over the UTF-8 of the text that decoding
    gives, round_trip says whether that is the text. Null and empty texts have no tokens and decode to an
    empty text. Other columns stay, but for those names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path))
    made = ("text", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
    rest = [f for f in docs.schema.fields if f.name not in made]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            coded = []
            start, size = 0, 0
            for i, t in enumerate(texts):  # a bounded number of characters at a time
                size += len(t)
                if size >= 4_000_000 or i + 1 == len(texts):
                    coded += encoder.encode(texts[start : i + 1])
                    start, size = i + 1, 0
            back = [encoder.decode(c) if c else "" for c in coded]
            columns = [*batch.columns[1:]]
            if ids:
                flat = np.frombuffer(b"".join(coded), "<i4")
                offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
            columns += [
                pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                pa.array([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back], pa.string()),
                pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(["token_ids"] if ids else []), *made[2:]])

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
        + ["token_ids array<int>"] * ids
        + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", "round_trip boolean"]
    )
    return docs.select("text", *names).mapInArrow(run, schema)


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder a worker process, so the cache outlives a task."""
    if shared._path not in _encoders:
        _encoders.clear()
        _encoders[shared._path] = Encoder(shared.value)
    return _encoders[shared._path]
