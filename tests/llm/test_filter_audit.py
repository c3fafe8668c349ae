"""The audit of filters against counting every order from the documents themselves."""

import itertools
import re
from collections import Counter

import duckdb
import pytest

from stridefield.llm import filter_audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(text):
    words = WORD.findall(text)
    said = ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text)))
    return {name for name, failed in said if failed}


def plainly(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). Rows by part, order and step."""
    docs = [(i, t or "", part or "") for i, t, part in docs]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    known = [(part, failures(t) | ({"E"} if i is not None and least[t] < i else set()), i in good, i in toxic) for i, t, part in docs]
    out, removals = {}, Counter()
    for part in {k[0] for k in known}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [k for k in known if k[0] == part]
            for step, name in enumerate(order, 1):
                failing = sum(k[0] == part and name in k[1] for k in known)
                gone, left = [k for k in left if name in k[1]], [k for k in left if name not in k[1]]
                only = sum(k[0] == part and k[1] == {name} for k in known)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), only, sum(k[2] for k in gone), sum(k[3] for k in gone)]
                removals[part, name] += len(gone)
    return {(p, o, s): (*v, removals[p, o[s - 1]]) for (p, o, s), v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_plain_changes_visit_all_orders():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filter_audit._swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_swaps_keep_the_diagram():
    counts = {m: (m % 7 + 1, m % 3, m % 2) for m in range(32) if m % 5}
    diagram = filter_audit.Diagram("ABCDE", counts)
    for k in (0, 3, 1, 2, 2, 0, 1, 3):
        diagram.swap(k)
        direct = {sum(1 << i for i, name in enumerate(diagram.order) if m >> "ABCDE".index(name) & 1): w for m, w in counts.items()}
        fresh = filter_audit.Diagram("".join(diagram.order), direct)
        assert diagram.steps() == fresh.steps()
        assert [len(level) for level in diagram.levels] == [len(level) for level in fresh.levels]
    same = filter_audit.Diagram("ABCDE", {m: (1, 0, 0) for m in range(32)})
    assert [len(level) for level in same.levels] == [1] * 5  # equal nodes are one


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_plain_counts_and_sql(spark, sf):
    at = f"/root/testdata/{sf}"
    got = found(queries.op12_filter_audit(spark, at))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    names = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    assert got == {r[:3]: r[3:] for r in con.execute(f"SELECT {names} FROM ({queries.OP12_SQL})").fetchall()}
    if sf == "sf0.001":
        docs = con.execute("SELECT doc_id, text, lang FROM documents").fetchall()
        assert got == plainly(docs, con.execute("SELECT doc_id, quality, toxic FROM labels").fetchall())


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, long, "en"), (2, long, "de"), (2, long, "en"), (None, long, "en"), (None, None, None), (3, None, ""), (4, "", None), (5, "ABC $ " * 70_000, "fr"),
        (6, long + "\x1cx\x85y", "fr"), (7, "É" * 30 + "A" * 4, "fr"), (7, "É" * 30 + "A" * 4, "fr"), (0, "É" * 30 + "A" * 4, "fr"),
    ]
    labels = [(1, 1, 0), (2, None, 1), (2, 1, None), (None, 1, 1), (7, 0, 1), (99, 1, 1)]
    left = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, mask int, n int")
    right = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert found(filter_audit.interactions(left, right)) == plainly(docs, labels)
    assert filter_audit.interactions(left.limit(0), right).count() == 0
    assert found(filter_audit.interactions(left, right.limit(0))) == plainly(docs, [])


def test_many_copies_of_one_text(spark):
    docs = [(i, "one two" if i % 3 else f"own {i}", "en") for i in range(3000)]
    got = found(filter_audit.interactions(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(9), spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")))
    assert got["en", "EABCD", 1] == (1001, 1999, 0, 0, 1, 1, got["en", "EABCD", 1][6])
