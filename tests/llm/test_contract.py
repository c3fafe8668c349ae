"""Operators on the given tables against plain versions, and on edge rows: long texts, ties, empty tables, clashing names."""

import html
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridefield.llm import chat, curriculum, host_rules, html_text, hyperlang, queries, unigram
from stridefield.operators.lineage import Scratch

SF = "/root/testdata/sf0.1"


# --- pages
def test_articles_of_all_pages(spark):
    """The text between the article's tags, read by a plain expression, for every page that has exactly one article."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    got = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    held = 0
    for r in rows:
        parts = re.split(r"</?article>", r.html or "")
        if len(parts) == 3 and not re.search(r"<(?:aside|form|div|section|ul|table|script|nav|!--)", parts[1]):
            inside = re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", parts[1])
            want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inside)).split())
            assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
            held += 1
    assert held > 0.5 * len(rows)


def test_page_structures():
    wrap = lambda body: f"<html><body><nav><a href=x>Home</a></nav>{body}<footer>(c)</footer></body></html>"
    long = "This is a sentence with some words, and a comma, that is long enough to count. " * 3
    p = f"<p>{long}</p>"
    flat = long.strip()
    split = f"<div class=part>{p}{p}{p}</div><div class=part><p>Short end, of the split article, which goes on here for a while and then it stops for good.</p></div>"
    assert html_text.extract(wrap(f"<div>{split}</div>")).endswith("stops for good.")
    assert html_text.extract(wrap(f"<article>{p}<ul><li>one<li>two</ul><dl><dt>t<dd>d</dl><table><tr><td>a<td>b<tr><td>c</table>{p}</article>")) == f"{flat} one two t d a b c {flat}"
    assert html_text.extract(wrap(f"<article>{p}<div class='comments'><p>{long}</p></div><aside>{long}</aside><form>{long}</form></article>")) == flat
    # of two containers of equal score the first one is the best, and the other is kept as its sibling
    assert html_text.extract(wrap(f"<div>{p}</div><div>{p}</div>")) == f"{flat} {flat}"
    assert html_text.extract("<p>" + "a &lt;b&gt; &#233;\n\t c") == "a <b> é c"


def test_deep_pages_take_time_in_proportion():
    began = time.time()
    assert len(html_text.extract("<div>x, y " * 60_000)) == len("x, y " * 60_000) - 1
    html_text.extract("<b>" * 60_000 + "</i>" * 60_000 + "<p>x" + "</q>" * 60_000)
    assert time.time() - began < 20


def test_pages_keep_rows_and_names(spark):
    pages = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "<p>one, two</p>", 6)], "page_id long, html string, text int").withColumn("url", F.lit("u"))
    got = html_text.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("", 0), ("one, two", 8)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# --- languages
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op7_language_id(spark, SF).filter("held_out").collect()
    known = [r for r in got if truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(known) > 2000 and np.mean([r.lang_pred == truth[r.doc_id] for r in known]) >= 0.99


def test_language_ties_long_texts_and_empty_tables(spark):
    rows = [(1, "same words in both", "b"), (2, "same words in both", "a"), (3, None, "a"), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, vectors = hyperlang.train(docs)
    asked = spark.createDataFrame([(1, "same words"), (2, "long text " * 300_000), (2, "")], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = hyperlang.predict(asked, names, vectors).collect()
    assert names == ["a", "b"] and [r.lang_pred for r in got] == ["a", "a", "und"] and all(0 <= r.score <= 1 for r in got)
    names, vectors = hyperlang.train(docs.limit(0))
    assert names == [] and {r.lang_pred for r in hyperlang.predict(asked, names, vectors).collect()} == {"und"}
    assert hyperlang.predict(asked.limit(0), names, vectors).count() == 0


# --- pieces
def test_long_segment_in_windows():
    v = unigram.load()
    rng = np.random.default_rng(5)
    text = (" " + "".join(rng.choice(list("abcdefghijklmnoprstuvwyé"), 9_000))).encode()
    whole = unigram.viterbi([text], v)[0]
    for window in (1, 7, 1000, 20_000):
        assert unigram.viterbi_long(text, v, window) == whole
    word = "".join(rng.choice(list("abcdefgh"), unigram.BLOCK_BYTES + 5))
    encoder = unigram.Encoder(v)
    assert encoder.decode(encoder.encode([word])[0]) == word


def test_pieces_rows_and_names(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a  b\n▁")], "doc_id long, text string").withColumn("n_tokens", F.lit("mine"))
    got = unigram.encode_documents(docs).collect()
    assert [r.n_tokens for r in got][:2] == [0, 0] and all(r.round_trip for r in got) and got[2].n_tokens == len(got[2].token_ids)
    assert unigram.encode_documents(docs.limit(0)).count() == 0


# --- hosts
def test_a_host_falls_by_its_rules(spark):
    good, short = " ".join(f"w{k}" for k in range(80)), "too short"
    lines = "\n".join(["same line here"] * 2 + [f"w{k} x{k}" for k in range(40)] * 2)
    rows = [(f"h{k}", good) for k in range(12) for _ in range(20)]
    rows += [("bad", good)] * 4 + [("bad", short)] * 16 + [("lines", lines)] * 15 + [("lines", good)] * 5 + [("tiny", short)] + [(None, good)] * 20
    docs = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    judged = host_rules.judge(host_rules.rule_counts(docs))
    kept = Counter((r.source, r.kept) for r in judged.collect() if not r.base_failed)
    assert kept["bad", False] == 4 and kept["lines", False] == 5 and not kept["bad", True] and not kept["lines", True]
    assert kept[None, True] == 20 and kept["h3", True] == 20
    # one failed document isn't enough against the prior
    assert {r._host: r.host_kept for r in host_rules.host_verdicts(host_rules.rule_counts(docs)).collect()}["tiny"]


def test_rules_keep_columns_and_rows(spark):
    made = ("_words", "_lines", "_grams", "_at", "_host", "_doc", "_text", "kept", "n_words", "host_kept", "short")
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "s", "a " * 200_000)], "doc_id long, source string, text string").withColumns({c: F.lit("mine") for c in made})
    got = host_rules.judge(host_rules.rule_counts(docs))
    rows = got.collect()
    assert len(rows) == 3 and all(r._words == r._host == r._doc == r.host_kept == "mine" for r in rows)
    assert sorted(r.n_words for r in rows) == [0, 0, 200_000] and max(r.n_repeat_words for r in rows) == 200_000
    assert host_rules.judge(host_rules.rule_counts(docs.limit(0))).count() == 0


# --- mixing
def test_mixing_edges(spark):
    made = ("before", "target", "positions", "w0", "_bucket")
    rows = [(None, None, None), (1, "a", "x y z"), (1, "a", "x y z"), (2, "b", ""), (3, None, "one " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = curriculum.narrow(docs).withColumns({c: F.lit("mine") for c in made})
    got = curriculum.mix(sized).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) == 759
    assert got and sorted(map(repr, curriculum.mix(sized).collect())) == sorted(map(repr, got))
    assert curriculum.mix(sized.limit(0)).count() == 0


# --- conversations
def test_long_conversation(spark):
    turns = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<|"), F.col("id").cast("string")).alias("text"))
    turns = turns.withColumns({"formatted": F.lit(1), "_turns": F.lit(2), "_runs": F.lit(3)})
    done = chat.format_conversations(turns)
    row = done.select(chat.parse_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).first()
    assert [tuple(t) for t in row.t] == [("user" if k % 2 == 0 else "assistant", f"t<|{k}") for k in range(4000)]
    assert row.m == "".join(f"t<|{k}" for k in range(1, 4000, 2))


# --- personal data
def test_learned_spans_on_the_given_documents(spark):
    """Base spans stay, learned ones are of kind id, inside the text and not over a base span."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    from stridefield.llm import pii

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find(docs).collect():
        plain = [(s, e, k) for s, e, k in pii.base_spans(texts[r.doc_id])]
        assert [tuple(s) for s in r.base] == plain
        assert [tuple(s) for s in r.spans if s.kind != "id"] == plain
        for s in r.spans:
            if s.kind == "id":
                assert 0 <= s.start < s.end <= len(texts[r.doc_id]) and not any(a < s.end and s.start < e for a, e, _ in plain)


def test_scratch_is_removed(spark):
    with Scratch(spark) as scratch:
        assert scratch.keep(spark.range(3)).count() == 3
        folder = scratch.folder
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{folder}/1").count()
