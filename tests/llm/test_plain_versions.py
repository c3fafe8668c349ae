"""Personal data, languages and pieces against versions written down plainly here."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stridefield.llm import hyperlang, pii, queries, unigram

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --- personal data
def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def base(text):
    """The contract's rules as expressions."""
    only = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(only(s)) <= 19 and luhn(only(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(only(s)) <= 15),
    }
    found = [(m.start(), m.end(), kind) for kind, (rule, ok) in rules.items() for m in re.finditer(rule, text) if ok(m[0])]
    return sorted(found, key=lambda x: (x[0], list(rules).index(x[2])))


def test_base_spans_by_expressions(spark):
    r = random.Random(4)
    pieces = ["a@b.c", "@", ".", "..", "a.b", "-", " ", "+", "+1", "(", ")", "4111111111111111", "4111 1111-1111 1111", "12", "255", "256", "1.2.3.4", "0001.002.3.4", "x", "é", "%", "a-b@c-d.ef", "12345678901", "\n", "٣"]
    for _ in range(30_000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert pii.base_spans(text) == base(text), text
    for row in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("text").collect():
        assert pii.base_spans(row.text or "") == base(row.text or "")


def bootstrap(texts, least=0.9, support=3):
    """All spans of each text: the graph of patterns and values in dictionaries, scored until nothing rises."""
    word = lambda s: s.strip("\"'.,;:!?()[]{}<>#*$%&|=+-_/").lower()
    edges, seen, seeds = defaultdict(set), [], set()
    for n, text in enumerate(texts):
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        spans = [(s, e, k) for s, e, k in base(text)]
        for s, e in tokens:
            piece = text[s:e]
            inner = piece.strip("\"'.,;:!?()[]{}<>#*$%&|=+-_/")
            if len(re.findall("[0-9]", piece)) >= 4 and inner and not any(a < e and s < b for a, b, _ in spans[: len(base(text))]):
                at = s + piece.index(inner)
                spans.append((at, at + len(inner), None))
        for s, e, kind in spans:
            before = [i for i, (a, _) in enumerate(tokens) if a <= s][-1]
            after = [i for i, (a, _) in enumerate(tokens) if a >= e][:1]
            left = word(text[slice(*tokens[before - 1])]) if before > 0 else ""
            right = word(text[slice(*tokens[after[0]])]) if after else ""
            value = text[s:e]
            if kind:
                seeds.add(value)
            for pattern in [("L", left)] * bool(left) + [("R", right)] * bool(right) + [("B", left, right)] * bool(left and right):
                edges[pattern].add((value, kind is not None))
            seen.append((n, s, e, kind, value))
    by_pattern = {p: {v: max(k for w, k in found if w == v) for v, _ in found} for p, found in edges.items()}
    by_pattern = {p: found for p, found in by_pattern.items() if len(found) >= support}
    score = {(p, v): float(k) for p, found in by_pattern.items() for v, k in found.items()}
    while True:
        good = {}
        for p, found in by_pattern.items():
            own = [score[p, v] for v in found]
            if sum(own) / len(own) >= least and sum(x >= least for x in own) >= support:
                good[p] = sum(own) / len(own)
        likely = defaultdict(lambda: 1.0)
        for p, g in good.items():
            for v, k in by_pattern[p].items():
                if not k:
                    likely[v] *= max(1e-9, 1 - g)
        rose = False
        for (p, v), x in score.items():
            new = x if by_pattern[p][v] else max(x, 1 - likely[v] if v in likely else 0.0)
            rose |= new > x + 1e-6
            score[p, v] = new
        if not rose:
            break
    learned = {v for (p, v), x in score.items() if x >= least and not by_pattern[p][v]} - seeds
    out = defaultdict(set)
    for n, s, e, kind, value in seen:
        if kind or value in learned:
            out[n].add((s, e, kind or "id"))
    return out


def test_learned_spans_equal_a_plain_bootstrap(spark):
    r = random.Random(7)
    texts = []
    for i in range(200):
        texts.append(f"please write to user{i}@mail{i % 7}.example today and call ref AB-{1000 + i} now")
        texts.append(f"in year {1900 + i} there were {r.randrange(10**5)} of them, ticket {r.randrange(10**6):06} closed")
    for i in range(20):
        texts.append(f"please write to member-{3000 + i} today")  # learned beside the seeds
        texts.append(f"the code member-{3000 + i} ends")
    texts += ["the code guest-7001 ends", "the code guest-7002 ends", "a guest-7001 elsewhere"]  # learned beside those in the next round
    texts += ["", "please write to " + "7" * 300 + " today", "please write to user3@mail3.example today and", *texts[:9]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = bootstrap(texts)
    got = {row.doc_id: {tuple(s) for s in row.spans} for row in pii.find(docs).collect()}
    assert len(got) == len(texts) and got == {n: want[n] for n in range(len(texts))}
    assert sum(k == "id" for spans in got.values() for *_, k in spans) >= 43


def test_learned_spans_of_the_given_documents(spark):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()
    want = bootstrap([row.text or "" for row in rows])
    got = queries.op2_pii_bootstrap(spark, MIDDLE).collect()
    spans = {row.doc_id: row.spans for row in got}
    order = ["email", "ip", "card", "phone", "id"]
    for n, row in enumerate(rows):
        assert spans[row.doc_id] == ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(want[n], key=lambda x: (x[0], order.index(x[2]), x[1])))


def test_very_long_and_repeated_texts(spark):
    long = "call user@host.example or +1 (555) 010-9999 " * 40_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, "x 1.2.3.4"), (None, "x 1.2.3.4")], "doc_id long, text string")
    got = pii.find(docs).collect()
    assert sorted(len(row.base) for row in got) == [1, 1, 80_000, 80_000] and len({repr(row.spans) for row in got if row.doc_id}) == 1


# --- languages
def plain_vector(text):
    """Trigrams of letter runs with a blank on either side, bound letter by letter."""
    counts = Counter()
    runs, run = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            runs.append(run)
            run = ""
    for w in runs:
        padded = f" {w} "
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    out = np.zeros(hyperlang.DIMENSIONS)
    for gram, n in counts.items():
        a, b, c = (hyperlang.letter_vector(ord(x)).astype(float) for x in gram)
        out += n * np.roll(a, 2) * np.roll(b, 1) * c
    return out, sum(counts.values())


def test_languages_by_plain_vectors(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    vectors = {d.doc_id: plain_vector(d.text or "") for d in docs}
    sums = defaultdict(lambda: np.zeros(hyperlang.DIMENSIONS))
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 4 != 2 and d.lang is not None and d.text is not None:
            v = vectors[d.doc_id][0]
            sums[d.lang] += v / (np.linalg.norm(v) or 1)
    names = sorted(sums)
    found = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    found -= found.mean(axis=0)
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    got = {r.doc_id: r for r in queries.op7_language_id(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        v, n = vectors[d.doc_id]
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = found @ v / np.linalg.norm(v)
        best = np.sort(cos)
        assert r.score == pytest.approx((1 + best[-1]) / 2, abs=2e-5)
        if best[-1] - best[-2] > 1e-5:
            assert r.lang_pred == names[int(cos.argmax())]


# --- pieces
def test_every_document_has_a_best_path(spark):
    v = unigram.load()
    score = {v.texts[i]: v.scores[i] for i in range(len(v.texts)) if v.texts[i] and v.scores[i] < 0}
    single = set(v.byte_ids.tolist())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    coded = {r.doc_id: r.token_ids for r in unigram.encode_documents(docs).collect()}
    for d in docs.collect():
        data = (" " + d.text).encode() if d.text else b""
        best = [0.0]
        for j in range(1, len(data) + 1):
            top = best[j - 1] + v.byte_score
            for i in range(max(0, j - v.longest), j):
                s = score.get(data[i:j])
                if s is not None and best[i] + s > top:
                    top = best[i] + s
            best.append(top)
        ids = coded[d.doc_id]
        total = math.fsum(v.byte_score if i in single else v.scores[i] for i in ids)
        assert total == pytest.approx(best[-1], abs=1e-6 * (1 + len(data))) and b"".join(v.texts[i] for i in ids) == data
