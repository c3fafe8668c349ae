"""Corpus operators: brute force, round trips and edge rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridefield.operators.lineage import Scratch
from stridefield.llm import chat, curriculum, host_rules, html_text, hyperlang, lsh_forest, pii, suffix_dedup, unigram

LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(200))
NEAR = LONG.replace("word0 ", "other ", 1)
ROWS = [(1, LONG), (2, NEAR), (3, LONG), (4, None), (5, ""), (6, "short text"), (6, "short text"), (None, "lone text here"), (7, "a" * 450)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", r"\### <|end|> \\<|"), (1, 1, "user", None), (1, 2, "assistant", "<|part|>x<"), (1, 2, "assistant", "|y"), (None, None, None, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in done.select("conv_id", chat.parse_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()}
    assert [tuple(t) for t in got[1]["t"]] == [(r, t or "") for _, _, r, t in rows[:4]]
    assert got[1]["m"] == "<|part|>x<|y" and got[None]["t"][0]["text"] == "z"
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_base_spans():
    text = "a.b@c.de, x@y 1.2.3.4 999.1.1.1 x 4111 1111 1111 1111 x +1 (743) 555-3824 a@b.c@d.e"
    assert [(text[s:e], k) for s, e, k in pii.base_spans(text)] == [
        ("a.b@c.de", "email"), ("1.2.3.4", "ip"), ("4111 1111 1111 1111", "card"), ("+1 (743) 555-3824", "phone"), ("a@b.c", "email"),
    ]


def test_pii_rows_and_redaction(spark, docs):
    assert pii.find(docs).count() == len(ROWS)
    one = spark.createDataFrame([(1, "mail a@b.cd now", "en")], "doc_id long, text string, lang string")
    with Scratch(spark) as scratch:
        assert pii.redact(one, scratch).first()["text"] == "mail <email> now"
        named = docs.withColumns({c: F.lit(c) for c in ("_row", "_doc", "spans", "seen", "_th")})
        assert sorted(map(repr, pii.redact(named, scratch).collect())) == sorted(map(repr, named.collect()))
        assert pii.redact(named.limit(0), scratch).columns == named.columns
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_rounds_and_long_words(spark):
    mails = lambda name, n, right="": [f"{name} {name}{k}@x.yz{right}" for k in range(n)]
    # z9001 is found only once the y are, and those only once the x are
    texts = mails("alpha", 30) + [f"alpha x100{k}" for k in range(3)]
    texts += mails("beta", 24) + [f"beta x100{k}" for k in range(3)] + [f"beta y200{k}" for k in range(2)]
    texts += mails("gamma", 24) + [f"gamma y200{k}" for k in range(2)] + ["gamma z9001"]
    token = "t0k3n" + "abcd12" * 30
    texts += mails("delta", 30) + [f"delta {token}"]
    # a context word is told from another that only begins alike
    texts += [f"e{k}@x.yz {'k' * 90}a" for k in range(30)] + [f"n4321 {'k' * 90}b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {texts[r.doc_id][s.start : s.end] for r in pii.find(docs).select("doc_id", "spans").collect() for s in r.spans if s.kind == "id"}
    assert found == {"x1000", "x1001", "x1002", "y2000", "y2001", "z9001", token}


def test_near_classes(docs):
    got = {r["doc_id"]: r for r in lsh_forest.near_classes(docs).collect()}
    assert got[1]["class_id"] == got[2]["class_id"] == got[3]["class_id"] == 1
    assert got[6]["n_links"] == 1 and got[7]["class_id"] == 7


def test_rule_counts(spark):
    text = "a b c a b c\n#x\n#x\n\n"
    row = host_rules.rule_counts(spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string")).first()
    assert (row["n_words"], row["n_dup_lines"], row["n_symbols"], row["n_repeat_words"], row["base_failed"]) == (8, 1, 2, 6, True)


def test_language(spark):
    rows = [(i, t, lang) for i in range(20) for t, lang in ((f"the quick brown fox and the dog {i}", "en"), (f"der schnelle braune fuchs und der hund {i}", "de"))]
    names, vectors = hyperlang.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = spark.createDataFrame([(1, "the fox and the dog"), (2, "der fuchs und der hund"), (3, None), (4, "123")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in hyperlang.predict(tests, names, vectors).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und"}


def test_unigram_round_trip_and_best_path():
    v = unigram.load()
    encoder = unigram.Encoder(v)
    pieces = {v.texts[i]: v.scores[i] for i in range(len(v.texts)) if v.texts[i] and v.scores[i] < 0}
    single = set(v.byte_ids.tolist())
    for text in ("hello  world\n", "▁ é😀", " ", "x" * 3000):
        ids = encoder.encode([text])[0]
        assert encoder.decode(ids) == text
        data = (" " + text).encode()
        best = [0.0] + [-1e18] * len(data)
        for j in range(1, len(data) + 1):
            best[j] = max([best[j - 1] + v.byte_score] + [best[i] + pieces[data[i:j]] for i in range(max(0, j - v.longest), j) if data[i:j] in pieces])
        total = sum(v.byte_score if i in single else v.scores[i] for i in np.frombuffer(ids, "<i4").tolist())
        assert abs(total - best[-1]) < 1e-6


def test_html():
    page = "<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One, two &amp; <b>three</b><br><p>Four</article><div class=comments><p>No</p></div></body>"
    assert html_text.extract(page) == "T One, two & three Four"
    assert html_text.extract(None) == html_text.extract("") == ""


def test_mixing(spark, docs):
    got = curriculum.mix(curriculum.narrow(docs)).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(r["size"] for r in got)) <= 2
