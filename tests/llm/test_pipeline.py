"""The pipeline's stages, each against a plain version over the rows it was given."""

import random
from collections import defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from stridefield.llm import lsh_forest, pii, unigram
from stridefield.llm.queries import OP6_SQL

SF = "/root/testdata/sf0.001"


def brute_heads(rows):
    """Least id of every class of rows (id, text), by all pairs of shingle sets."""
    sets = {i: set(lsh_forest.shingles(t).tolist()) for i, t in rows}
    texts = {i: t or "" for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            alike = both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
            if texts[i] == texts[j] or alike:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_later_turns_find_links_that_miss_the_leader(spark):
    rng = random.Random(5)
    rows = []
    for group in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k in range(25):
            words = list(base)
            for _ in range(rng.randrange(1, 7)):
                words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            rows.append((group * 100 + k, " ".join(words)))
    got = lsh_forest.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_heads(rows)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given.append(docs)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    start, ruled, single, clean, mixed = given

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    passed = [i for (i,) in con.execute(f"SELECT doc_id FROM ({OP6_SQL}) WHERE kept").fetchall()]
    assert sorted(r.doc_id for r in ruled.collect()) == sorted(passed)

    heads = set(brute_heads([(r.doc_id, r.text) for r in ruled.collect()]).values())
    assert sorted(r.doc_id for r in single.collect()) == sorted(heads)

    assert sorted(r.doc_id for r in clean.collect()) == sorted(heads)
    left = pii.find(clean.select("doc_id", "text"))
    assert sum(len(r.base) for r in left.select("base").collect()) == 0
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    words, taken = defaultdict(int), defaultdict(int)
    by_id = {r.doc_id: r for r in clean.collect()}
    for r in by_id.values():
        words[r.source] += len(r.text.split())
    times = defaultdict(int)
    for r in mixed.collect():
        assert r.text == by_id[r.doc_id].text
        taken[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    assert max(times.values()) <= 2
    longest = max(len(r.text.split()) for r in by_id.values())
    total, rank, targets, left_over = 1.5 * sum(words.values()), sorted(words), {}, set(words)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(rank)}
    while left_over:
        room = total - sum(targets.values())
        share = {s: room * weight[s] / sum(weight[x] for x in left_over) for s in left_over}
        above = {s for s in left_over if share[s] > 2 * words[s]}
        targets |= {s: 2.0 * words[s] for s in above} if above else share
        left_over -= above or left_over
    for s in words:
        assert abs(taken[s] - targets[s]) <= longest

    vocabulary = unigram.load()
    encoder = unigram.Encoder(vocabulary)
    decoded = [encoder.decode(np.array(r.token_ids, "<i4").tobytes()) if r.token_ids else "" for r in docs.collect()]
    assert sorted(decoded) == sorted(r.text for r in mixed.collect())


def template_texts(pairs, seed=9):
    """Two texts a pair: Jaccard about 0.83 inside a pair, 0.78 across pairs, all made from one template."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(600)]
    rows = []
    for pair in range(pairs):
        own = list(base)
        for k in range(5):
            own[20 + 12 * k] = f"p{pair}x{k}"
        for side in range(2):
            words = list(own)
            for k in rng.sample(range(10), 9):
                words[120 + 45 * k] = f"q{pair}y{side}z{k}"
            rows.append((2 * pair + side, " ".join(words)))
    return rows


def brute_degrees(rows):
    sets = {i: set(lsh_forest.shingles(t).tolist()) for i, t in rows}
    ids = sorted(sets)
    links = {i: 0 for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
    return links


def test_every_two_texts_of_a_hot_bucket_are_compared(spark):
    rows = template_texts(350)
    got = lsh_forest.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    heads = brute_heads(rows)
    assert len(set(heads.values())) > 300
    assert {r.doc_id: r.class_id for r in got} == heads


def test_links_are_counted_exactly(spark):
    """A class of many texts all alike, over several blocks, and looser groups in small buckets; exact copies count too."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(700):
        words = list(base)
        words[rng.randrange(400)] = f"x{k}"
        rows.append((k, " ".join(words)))
    for group in range(12):
        own = [f"g{group}w{k}" for k in range(200)]
        for k in range(6):
            words = list(own)
            for at in rng.sample(range(200), rng.randrange(1, 5)):
                words[at] = f"g{group}x{k}y{at}"
            rows.append((1000 + 10 * group + k, " ".join(words)))
    got = {r.doc_id: r.n_links for r in lsh_forest.near_classes(spark.createDataFrame([*rows, (5000, rows[0][1])], "doc_id long, text string")).collect()}
    want = brute_degrees(rows)
    # both rows of the copied text have each other and the links to the other texts
    want[0] += 1
    want[5000] = want[0]
    assert got == want


def test_mixing_keeps_null_and_repeated_ids(spark):
    rows = [(None, f"lone{k} " + "word " * 9) for k in range(8)] + [(7, f"same{k} " + "word " * 9) for k in range(6)] + [(100 + k, f"own{k} " + "word " * 9) for k in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    times = defaultdict(int)
    for r in corpus_pipeline.mixing(spark, docs, SF).collect():
        times[r.doc_id, r.text] += 1
    assert set(times) == set(rows) and max(times.values()) <= 2
    assert abs(sum(times.values()) - 1.5 * len(rows)) <= 1


def test_one_row_of_each_class_whatever_its_id(spark):
    words = lambda k, n=60: " ".join(f"t{k}w{j}" for j in range(n))
    rows = [(1, words(1)), (2, words(1)), (2, words(2)), (3, words(3)), (3, words(4)), (None, words(5)), (None, words(5)), (None, words(5) + " end"), (None, words(3)), (None, words(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text.split()[0]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == [(0, "t5w0"), (0, "t6w0"), (1, "t1w0"), (2, "t2w0"), (3, "t3w0"), (3, "t4w0")]


def test_stages_take_edge_rows_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, more columns with names used inside: no stage fails or loses a row it should keep."""
    long = " ".join(f"w{k * 7919 % 90001}" for k in range(30_000))
    good = " ".join(f"g{k}" for k in range(90))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, good, "en", "s", 1), (2, good, "en", "s", 1), (None, good + " end", None, None, None), (3, long, "en", "t", 2), (4, good + " mail a@b.cd now", "de", "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("*", *[f"'mine' AS `{c}`" for c in ("_row", "_doc", "_text", "spans", "_words", "kept", "_key", "target", "n_tokens", "class_id")])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for part, given in (("none", docs.limit(0)), ("edge", docs), ("wide", wide)):
            path = f"{tmp_path}/{k}-{part}"
            stage(spark, given, SF).write.parquet(path)
            got = spark.read.parquet(path)
            assert name == "sentencepiece" or got.columns == list(corpus_pipeline.COLUMNS)
            found = sorted((r.doc_id or 0) for r in got.select("doc_id").collect())
            if part == "none":
                assert found == []
            else:
                want = {"quality_rules": [0, 2, 2, 3, 4], "near_duplicates": [1, 2, 3], "personal_data": [0, 0, 1, 2, 2, 3, 4], "sentencepiece": [0, 0, 1, 2, 2, 3, 4]}
                assert name == "mixing" or sorted(set(found)) == sorted(set(want[name])), (name, part, found)
                assert name not in ("personal_data", "sentencepiece") or found == want[name]
