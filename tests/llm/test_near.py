"""Near-duplicate classes against all pairs: recall on the given documents, edge rows, shortened prefixes."""

import numpy as np
from pyspark.sql import functions as F

from stridefield.llm import lsh_forest
from stridefield.operators.lineage import Scratch

WORDS = " ".join(f"word{i * 7919 % 5003}" for i in range(200))


def test_recall_against_all_pairs(spark):
    """Queries are the rows whose id is divisible by 50, against all rows of sf0.1: of their links 0.9 or more share a class, and the
    numbers of links agree."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    sets = [lsh_forest.shingles(t) for _, t in rows]
    where: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        for h in s.tolist():
            where.setdefault(h, []).append(k)
    got = {r.doc_id: r for r in lsh_forest.near_classes(docs).collect()}
    assert len(got) == len(rows)
    met = links = counted = wanted = 0
    for k, (doc, text) in enumerate(rows):
        if doc % 50 == 0:
            shared = np.bincount(np.concatenate([np.array(where[h]) for h in sets[k].tolist()] or [np.zeros(0, np.int64)]), minlength=len(rows))
            near = [j for j in np.flatnonzero(shared).tolist() if j != k and shared[j] >= 0.8 * (len(sets[k]) + len(sets[j]) - shared[j])]
            near += [j for j, (_, t) in enumerate(rows) if not len(sets[k]) and t == text and j != k]
            links += len(near)
            met += sum(got[rows[j][0]].class_id == got[doc].class_id for j in near)
            # rows of the same text count each, another text once
            texts = sum(rows[j][1] == text for j in near) + len({rows[j][1] for j in near} - {text})
            wanted += texts
            counted += got[doc].n_links
            assert got[doc].n_links <= texts
    assert links > 20 and met >= 0.95 * links and counted >= 0.95 * wanted


def test_prefixes_are_shortened_for_texts_that_are_short_of_recall(spark):
    """Made signatures: who is matched at which depth, and who is left alone."""
    depth, low = lsh_forest.DEEPEST, lsh_forest.shallowest()
    assert lsh_forest.met_at(low, 0.8) >= lsh_forest.TARGET > lsh_forest.met_at(low + 1, 0.8) and lsh_forest.met_at(depth, 0.8) > 0.94
    assert lsh_forest.most_apart(low) == lsh_forest.LINK_MOST > lsh_forest.most_apart(depth) > 0
    rng = np.random.default_rng(3)

    def like(row, shared):
        """A signature that shares a prefix of ``shared`` values in the first tree, none in any other, and most values."""
        out = row.copy().reshape(lsh_forest.TREES, depth)
        out[1:, 0] += 1
        out[0, shared:] += 1
        return out.reshape(-1)

    base = rng.integers(0, 1 << 30, (6, 128))
    close = lambda row: np.concatenate((row[:-1], row[-1:] + 1))
    rows = {
        1: base[0], 2: like(base[0], low), 3: base[1], 4: like(base[1], low - 1), 5: base[2], 6: close(base[2]), 7: like(base[2], low),
        10: base[3], 11: close(base[3]), 12: like(base[3], low), 13: close(like(base[3], low)), 14: base[4],
    }
    made = [(k, v.astype(np.int32).tolist(), lsh_forest.sketch(v.astype(np.uint32))) for k, v in rows.items()]
    texts = spark.createDataFrame(made, "id long, _sig array<int>, _sketch array<long>")
    with Scratch(spark) as scratch:
        ties = {tuple(sorted(t)) for t in lsh_forest.candidate_ties(texts, scratch).collect()}
    # 7 has no link at full depth and finds 5 and 6, which are done; 10, 11, 12 and 13 have one each and look no further
    assert ties == {(1, 2), (5, 6), (5, 7), (6, 7), (10, 11), (12, 13)}


def test_edge_rows(spark):
    rows = [(1, WORDS), (2, WORDS.replace("word0 ", "other ", 1)), (None, WORDS), (4, None), (5, ""), (6, "  \n"), (7, "a b"), (7, "a b"), (8, "a  b"), (None, "alone"), (9, WORDS + "".join(f" u{k}" for k in range(100_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_row", "_print", "id", "class_id", "n_links")})
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in lsh_forest.near_classes(docs).collect())
    assert got == [(0, 0, 0), (0, 1, 2), (1, 1, 2), (2, 1, 1), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 2), (7, 7, 2), (8, 7, 1), (9, 9, 0)]
    assert lsh_forest.near_classes(docs.limit(0)).collect() == []
