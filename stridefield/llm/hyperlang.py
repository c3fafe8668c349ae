"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of the letter and a seed. A
trigram abc is bound as roll(A, 2) * roll(B, 1) * C; a text is the bundle (sum) of its trigrams, a
language prototype the bundle of its training texts, centred on the mean of the languages. A text is
given the language of the greatest cosine.

Texts are whole. Words are lower-cased letter runs with a blank on either side. Inside a batch, equal trigrams of
a text are counted first, so bundling is one product of a count matrix with the trigrams' vectors.
No shuffle in prediction; training sends one vector per language and task to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 20240611
#: At most about so many training texts are read, chosen by a hash of their id.
MAX_TRAINING_TEXTS = 40_000
_BLANK = 32
_letters: dict[tuple[int, int, int], np.ndarray] = {}


def letter_vector(code: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A random vector of -1 and 1 for a code point, the same in every process."""
    key = (code, dimensions, seed)
    if key not in _letters:
        _letters[key] = (np.random.default_rng([seed, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
    return _letters[key]


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts' letters, lower-cased, words set off by single blanks; the text number of each."""
    parts = [(t or "").lower() for t in texts]
    joined = " ".join(parts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) + 1 for p in parts])[: len(points)]
    ascii_letter = (points >= 97) & (points <= 122)
    letter = ascii_letter.copy()
    other = np.flatnonzero(points >= 128)
    if len(other):
        kinds, at = np.unique(points[other], return_inverse=True)
        letter[other] = np.array([chr(k).isalpha() for k in kinds.tolist()])[at]
    points = np.where(letter, points, _BLANK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    return points[keep], owner[keep]


def bundle(texts: list[str | None], dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Text vectors (float32, one row a text) and the number of trigrams of each."""
    points, owner = _codes(texts)
    n = len(texts)
    if len(points) < 2:
        return np.zeros((n, dimensions), np.float32), np.zeros(n, np.int64)
    alphabet, x = np.unique(points, return_inverse=True)
    k = len(alphabet)
    blank = int(np.searchsorted(alphabet, _BLANK))
    # a word of one text never reaches into the next: the blank after the last word ends it
    before = np.empty_like(x)
    before[0] = blank
    before[1:] = x[:-1]
    after = np.full_like(x, blank)
    after[:-1] = x[1:]
    middle = points != _BLANK
    before[1:][owner[1:] != owner[:-1]] = blank
    after[:-1][owner[1:] != owner[:-1]] = blank
    tri = ((before.astype(np.int64) * k + x) * k + after)[middle]
    who = owner[middle].astype(np.int64)
    size = k**3
    if n * size < 1 << 62:
        keys, counts = np.unique(who * size + tri, return_counts=True)
        doc, gram = keys // size, keys % size
    else:
        order = np.lexsort((tri, who))
        pairs = np.stack((who[order], tri[order]), axis=1)
        pairs, counts = np.unique(pairs, axis=0, return_counts=True)
        doc, gram = pairs[:, 0], pairs[:, 1]
    grams, column = np.unique(gram, return_inverse=True)
    vectors = np.stack([letter_vector(int(c), dimensions, seed) for c in alphabet])
    rolled = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    out = np.zeros((n, dimensions), np.float32)
    step = 4096  # distinct trigrams at a time, so memory doesn't follow the alphabet
    for at in range(0, len(grams), step):
        g = grams[at : at + step]
        bound = (rolled[0][g // (k * k)] * rolled[1][g // k % k] * vectors[g % k]).astype(np.float32)
        mine = (column >= at) & (column < at + step)
        matrix = np.zeros((n, len(g)), np.float32)
        matrix[doc[mine], column[mine] - at] = counts[mine]
        out += matrix @ bound
    return out, np.bincount(who, minlength=n)


def _chunks(texts: list[str | None], rows: int = 256, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if i + 1 - start >= rows or total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, most: int = MAX_TRAINING_TEXTS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their centred prototypes. ``docs`` has doc_id, text, lang; null lang is left out.

    Fitted on a bounded sample: where there are more than ``most`` labelled texts, those whose hash of
    (doc_id, text) falls under most/rows. Each text counts as a unit vector.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = docs.filter(F.col("lang").isNotNull()).count()
    if rows > most:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < int(1e6 * most / rows))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), np.array(batch.column(0).to_pylist(), dtype=object)
            for a, b in _chunks(texts):
                vectors, _ = bundle(texts[a:b], dimensions, seed)
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(norm > 0, norm, 1)
                for lang in set(langs[a:b]):
                    total = vectors[langs[a:b] == lang].sum(axis=0, dtype=np.float64)
                    found[lang] = found[lang] + total if lang in found else total
        names = sorted(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([found[x].tolist() for x in names], pa.list_(pa.float64()))], ["lang", "v"]
        )

    per_task = labelled.select("lang", "text").mapInArrow(sums, "lang string, v array<double>")
    # element-wise sum of a vector per language and task
    summed = per_task.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = {r["lang"]: [x for _, x in sorted(r["v"])] for r in summed.groupBy("lang").agg(F.collect_list(F.struct("i", "x")).alias("v")).collect()}
    names = sorted(vectors)
    if not names:
        return [], np.zeros((0, dimensions), np.float32)
    found = np.array([vectors[x] for x in names])
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    if len(names) > 1:
        found = found - found.mean(axis=0)
    return names, (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``docs`` (any columns with text) plus lang_pred and score in place of text.

    score is the cosine moved to 0..1, (1 + cos) / 2. A text that is null or has no letter, or a model
    without languages, gives ``und`` and 0. Ties go to the first language by name.
    """
    rest = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    names_out = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            said: list[str] = []
            scores: list[float] = []
            for a, b in _chunks(texts):
                vectors, n = bundle(texts[a:b], dimensions, seed)
                if not len(names):
                    n[:] = 0
                norm = np.linalg.norm(vectors, axis=1)
                cos = (vectors @ prototypes.T) / np.where(norm > 0, norm, 1)[:, None] if len(names) else np.zeros((b - a, 1))
                best = cos.argmax(axis=1)
                top = np.clip((1 + cos[np.arange(b - a), best].astype(np.float64)) / 2, 0, 1)
                said += [names[i] if k else "und" for i, k in zip(best.tolist(), n.tolist(), strict=True)]
                scores += [round(s, 6) if k else 0.0 for s, k in zip(top.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(said, pa.string()), pa.array(scores, pa.float64())], [*names_out, "lang_pred", "score"]
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["lang_pred string", "score double"])
    return docs.select("text", *names_out).mapInArrow(run, schema)
