"""Filter interaction audit by decision diagrams: what each filter removes, in every order of the filters.

Each document has a mask of the filters that it fails. Per part of the corpus, documents are counted by mask; these few counts make
a decision diagram with a variable a level, in which every node holds the documents below it. Taking the filters in another
order means to reorder the variables, which is done by swaps of two adjacent levels: a swap rewrites those two levels only. The
all-pass path from the root then has, at each step, the documents that are left and those that the step's filter removes.

Documents of equal texts are grouped before anything is joined, so the exact-copy filter needs no join of the texts: of all rows
of one digest those pass it whose doc_id is the least. Shuffles: digests, ids and labels of all rows (no texts); then
counts, combined map-side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefield.llm.storage import Scratch, cut, merged

FILTERS = "ABCDE"
_SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
#: Weights of a node: documents, good ones, toxic ones.
Weight = tuple[int, int, int]


def own_failures(text: str | None) -> int:
    """The mask (bit i for filter i) of the filters that look at one text only: A to D. A null text is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at \x20 and \x09-\x0D
    n, chars = len(words), len(raw.translate(None, _CONTINUED))
    short = n < 100
    same = 100 * len(set(words)) < 80 * n
    upper = 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 10 * chars
    symbol = len(raw.translate(None, _SYMBOLS)) < len(raw)
    return short | same << 1 | upper << 2 | symbol << 3


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        masks, digests = [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            masks.append(own_failures(text))
            digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def mask_counts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by the set of filters that they fail (bit i for letter i of FILTERS).

    docs: doc_id, text, lang; labels: doc_id, quality, toxic. A part is a value of lang, null and empty together. A document fails E
    if a smaller doc_id has the same text (SHA-256) anywhere in ``docs``; a null doc_id is neither smaller nor larger than
    any, so it fails E never and fails no other. Of several labels of a doc_id each column's greatest counts; null is 0.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    rows = read.mapInArrow(_measure, "doc_id long, part string, mask int, digest binary")
    # equal rows collapse where they are read; both sides are tables, so a hot id of either can be dealt anew
    rows = scratch.keep(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    said = scratch.keep(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic")))
    known = merged(rows, said, ["doc_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    # of each digest and kind of document: its least id, the rows with that id, rows without an id, all rows
    kind = ["digest", "mask", "part", "quality", "toxic"]
    copies = known.groupBy(*kind).agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.sum("n").alias("n"),
    )
    kept = scratch.keep(copies.select(*kind, "least.doc_id", F.col("least.n").alias("firsts"), "nameless", "n"))
    first = scratch.keep(kept.groupBy("digest").agg(F.min("doc_id").alias("first")))
    judged = merged(kept, first, ["digest"])
    passes = F.col("nameless") + F.when(F.col("doc_id") == F.col("first"), F.col("firsts")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), passes.alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - passes).alias("n"))))
    each = judged.select("part", "quality", "toxic", split.alias("s")).filter("s.n > 0")
    return each.groupBy("part", "s.mask").agg(
        F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("quality")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic")
    )


class Diagram:
    """A count-weighted decision diagram: levels[k] has the nodes of variable order[k], by id, with their pass and fail child.

    Every path has all variables; nodes of a level with the same children are one node. Leaves are weights, and a node's weight
    is the sum of its children's.
    """

    def __init__(self, variables: str, counts: dict[int, Weight]):
        """counts: weight by mask; bit i of a mask is set if variable i fails."""
        self.order = list(variables)
        self.weight: list[Weight] = []
        self._leaves: dict[Weight, int] = {}
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in variables]
        self._unique: list[dict[tuple[int, int], int]] = [{} for _ in variables]
        self.root = self._build(0, counts)

    def _build(self, k: int, counts: dict[int, Weight]) -> int:
        if k == len(self.order):
            return self._leaf(tuple(map(sum, zip((0, 0, 0), *counts.values()))))
        passed, failed = ({m: w for m, w in counts.items() if (m >> k & 1) == bit} for bit in (0, 1))
        return self._node(k, self._build(k + 1, passed), self._build(k + 1, failed))

    def _leaf(self, weight: Weight) -> int:
        if weight not in self._leaves:
            self._leaves[weight] = len(self.weight)
            self.weight.append(weight)
        return self._leaves[weight]

    def _node(self, k: int, passed: int, failed: int) -> int:
        at = self._unique[k].get((passed, failed))
        if at is None:
            at = self._unique[k][passed, failed] = len(self.weight)
            self.weight.append(tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed], strict=True)))
            self.levels[k][at] = passed, failed
        return at

    def swap(self, k: int) -> None:
        """Exchange the variables of levels k and k + 1. Nodes of level k keep their ids and meanings, so no other level changes."""
        upper, lower = self.levels[k], self.levels[k + 1]
        self.levels[k], self.levels[k + 1], self._unique[k], self._unique[k + 1] = {}, {}, {}, {}
        for at, (passed, failed) in upper.items():
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            children = self._node(k + 1, pp, fp), self._node(k + 1, pf, ff)
            self.levels[k][at] = children
            self._unique[k][children] = at
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> list[tuple[str, Weight, Weight]]:
        """The all-pass path: each level's variable, what is left after it and what it removes."""
        at, out = self.root, []
        for k, name in enumerate(self.order):
            at, gone = self.levels[k][at]
            out.append((name, self.weight[at], self.weight[gone]))
        return out


def _swaps(n: int) -> Iterator[int]:
    """Places k whose swaps with k + 1, one after another, visit all orders of n things once (plain changes)."""
    if n < 2:
        return
    down, inner = True, _swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        move = next(inner, None)
        if move is None:
            return
        # the largest thing rests at one end while the others make a move
        yield move + 1 if down else move
        down = not down


def audit(counts: dict[int, Weight], filters: str = FILTERS) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of all orders."""
    diagram = Diagram(filters, counts)
    orders = {"".join(diagram.order): diagram.steps()}
    for k in _swaps(len(filters)):
        diagram.swap(k)
        orders["".join(diagram.order)] = diagram.steps()
    fails, alone, shapley = {}, {}, dict.fromkeys(filters, 0)
    for steps in orders.values():
        fails[steps[0][0]] = steps[0][2][0]
        alone[steps[-1][0]] = steps[-1][2][0]
        for name, _, gone in steps:
            shapley[name] += gone[0]
    return [
        (order, step, left[0], gone[0], fails[name] - gone[0], alone[name], gone[1], gone[2], shapley[name])
        for order, steps in sorted(orders.items()) for step, (name, left, gone) in enumerate(steps, 1)
    ]


_NAMES = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audit_part(counts: pa.Table) -> pa.Table:
    """All orders of one part, whose counts are at most 32 rows."""
    part = counts.column("part")[0].as_py()
    found = audit({m: (n, g, t) for m, n, g, t in zip(*[counts.column(c).to_pylist() for c in ("mask", "n", "good", "toxic")], strict=True)})
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
    columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
    return pa.table([pa.array([part] * len(found), pa.string()), *columns], ["part", *_NAMES])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part of ``docs``, each of the 120 orders of the five filters, and each step, zeros included. Counts are of rows of
    ``docs``: ids may be null or repeated. No rows give no rows. Further columns of both tables are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.keep(mask_counts(docs, labels, scratch))
        return cut(
            counts.groupBy("part").applyInArrow(
                _audit_part,
                "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long",
            )
        )
