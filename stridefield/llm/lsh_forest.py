"""Near-duplicate classes: a MinHash LSH forest, then exact Jaccard of word 5-shingles.

Every text gets TREES labels of DEEPEST MinHash values each; a tree is the trie of its labels. Texts that share a label's
prefix share a node, which is named by the hash of its path. Texts are first matched on whole labels. Then prefixes are shortened, one value at a
time, for those texts only whose recall is still short: the least similar link that a text has been matched with says how likely it was to be met at
this depth (:func:`met_at`), and a text without a link counts as if it had one at the threshold. Such a text is matched with all others
of its shorter prefixes. At the shallowest depth links at the threshold itself are met with the target recall, so no text goes beyond.

Pairs of a node whose sketches are far apart are dropped (see SKETCH_MOST); what is left ties texts to candidate groups.
Each text of a candidate group is sent once to its group, or to the block pairs of a large one, and there every two
texts are compared on all their shingles. So the links of a class are counted whole, whichever node brought the texts together, and no
row is made for a pair of a large node or group.

What moves: signatures once, (nodes, text) rows twice, those of leaves with a partner again for each depth, compressed texts once. Exact copies are one text throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridefield.llm.storage import Scratch, cut, merged, pack, unpack
from stridefield.operators.graph import connected_components

TREES, DEEPEST, WORDS, THRESHOLD, TARGET = 16, 8, 5, 0.8, 0.99
#: Nodes of more texts than SMALL are compared in blocks of about BLOCK sketches.
SMALL, BLOCK = 16, 1024
#: Texts and shingles in one side of a block of a candidate group.
CELL_TEXTS, CELL_SHINGLES = 256, 150_000
#: A sketch has 2 bits of each of the 128 values. At Jaccard 0.8, 19.2 differ in the mean with a deviation of 4.0; more than 38 do in
#: one of a million pairs.
SKETCH_MOST = 38
_VALUES = TREES * DEEPEST
#: Sketches of links at the threshold differ in so many values in the mean.
LINK_MOST = int(_VALUES * 0.75 * (1 - THRESHOLD))
_rng = np.random.default_rng(77)
MULTIPLIERS = _rng.integers(1, 1 << 63, _VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD_BITS = 0x5555555555555555


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word 5-shingles; a shorter text is one shingle, no words give none."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(h))):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """One 32-bit MinHash value for each value of each tree; ``found`` has at least one shingle."""
    out = np.full(_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        block = found[at : at + 2048, None] * MULTIPLIERS
        block ^= block >> np.uint64(32)
        out = np.minimum(out, (block * _MIX).min(axis=0))
    return ((out * _MIX) >> np.uint64(32)).astype(np.uint32)


def sketch(values: np.ndarray) -> list[int]:
    """The two low bits of every value, in four 64-bit integers."""
    bits = (values.astype(np.uint64) & np.uint64(3)).reshape(_VALUES // 32, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64).tolist()


def met_at(depth: int, similarity: float) -> float:
    """The probability that two texts of such similarity share a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def shallowest(target: float = TARGET) -> int:
    """The longest prefix at which links at the threshold are met with the target recall, 1 if none is."""
    return next((d for d in range(DEEPEST, 1, -1) if met_at(d, THRESHOLD) >= target), 1)


def most_apart(depth: int, target: float = TARGET) -> int:
    """How many values of two sketches may differ so that, by their estimate of the similarity, the pair is met at ``depth`` with the target recall.

    Different values still agree in a quarter of their 2-bit sketches. -1 if not even equal sketches suffice.
    """
    good = [far for far in range(int(_VALUES * 0.75 * (1 - THRESHOLD)) + 1) if met_at(depth, 1 - far / (_VALUES * 0.75)) >= target]
    return max(good, default=-1)


_SIGNED = "`_print` binary, `_n` long, `_sig` array<int>, `_sketch` array<long>, `_text` binary"


#: Texts that a worker holds as Python objects at a time.
SLICE = 256


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        prints, sizes, signs, sketches, texts = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            found = shingles(text)
            prints.append(xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass")))
            sizes.append(len(found))
            values = signature(found) if len(found) else None
            signs.append(None if values is None else values.view(np.int32))
            sketches.append(None if values is None else sketch(values))
            texts.append(pack(text))
        made = [pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64())), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["_row", "_doc", "_print", "_n", "_sig", "_sketch", "_text"])


def signed_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A table of ``docs`` (doc_id, text): _row, the other columns as one struct _doc, and what :func:`_sign` makes of the text."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*rest).alias("_doc"), "text")
    return scratch.keep(rows.mapInArrow(_sign, f"`_row` long, `_doc` {rows.schema['_doc'].dataType.simpleString()}, {_SIGNED}"))


def _far(a: str, b: str) -> Column:
    """How many values of two sketches differ."""
    differing = [f"bit_count(({a}[{k}] ^ {b}[{k}] | shiftrightunsigned({a}[{k}] ^ {b}[{k}], 1)) & {_ODD_BITS}L)" for k in range(_VALUES // 32)]
    return F.expr(" + ".join(differing))


def _block_ties(block: pa.Table) -> pa.Table:
    """Ties of one block pair of a large node: a forest over the texts whose sketches are near, one row a text with a near one.

    far is how many values differ from the least similar of those that may be links.
    """
    ids = np.array(block.column("id").to_pylist(), np.int64)
    sketches = np.array(block.column("sketch").to_pylist(), np.int64).view(np.uint64).reshape(len(ids), -1)
    near, far = np.zeros((len(ids), len(ids)), bool), np.full(len(ids), -1)
    for at in range(0, len(ids), 64):  # rows at a time, so that memory is the matrix of bits only
        x = sketches[at : at + 64, None] ^ sketches[None]
        x |= x >> np.uint64(1)
        x &= np.uint64(_ODD_BITS)
        apart = np.bitwise_count(x).sum(axis=2, dtype=np.int16)
        near[at : at + 64] = apart <= SKETCH_MOST
        apart[np.arange(len(apart)), at + np.arange(len(apart))] = -1  # not with itself
        far[at : at + 64] = np.where(apart <= LINK_MOST, apart, -1).max(axis=1)
    tied = roots(near, ids)
    some = np.flatnonzero(near.sum(axis=1) > 1)
    return pa.table({"a": pa.array(ids[some]), "b": pa.array(tied[some]), "far": pa.array(far[some], pa.int32())})


def roots(alike: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each row's component under the symmetric matrix ``alike``."""
    out, open_ = ids.copy(), np.ones(len(ids), bool)
    for k in np.argsort(ids, kind="stable").tolist():
        if open_[k]:
            edge = np.array([k])
            open_[k] = False
            while len(edge):
                out[edge] = ids[k]
                edge = np.flatnonzero(alike[edge].any(axis=0) & open_)
                open_[edge] = False
    return out


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share; sums of up to 2**24 are exact in float32."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(times > 1) - 1
    kept = times[column] > 1
    row, column = row[kept], often[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [start, start + 4096])
        used, at = np.unique(row[i:j], return_inverse=True)
        has = np.zeros((len(used), 4096), np.float32)
        has[at, column[i:j] - start] = 1
        out[np.ix_(used, used)] += (has @ has.T).astype(np.int64)
    return out


def _cell_links(cell: pa.Table) -> pa.Table:
    """Exact links in one block pair of a candidate group: of each text its links there and the least text it is linked to."""
    same = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
    ids = np.array(cell.column("id").to_pylist(), np.int64)
    sets = [shingles(unpack(t)) for t in cell.column("_text").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    alike = both >= THRESHOLD * (sizes[:, None] + sizes[None, :] - both)
    if same:
        np.fill_diagonal(alike, False)
    else:
        side = np.array(cell.column("side").to_pylist())
        alike &= side[:, None] != side[None, :]
    degree = alike.sum(axis=1)
    some = np.flatnonzero(degree)
    return pa.table({"id": pa.array(ids[some]), "root": pa.array(roots(alike, ids)[some]), "degree": pa.array(degree[some], pa.int64())})


def _dealt(members: DataFrame, group: str, blocks: Column, *carried: str) -> DataFrame:
    """``members`` (group, id) once for each block pair (i, j) of its group that it takes part in; side is its own block."""
    return (
        members.withColumn("_blocks", blocks.cast("int"))
        .withColumn("side", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(group, "id", "side", F.least("side", "_other").alias("i"), F.greatest("side", "_other").alias("j"), *carried)
    )


def _node_ties(met: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b, far of texts of ``met`` (node, id, n) that share a node and whose sketches (id, _sketch) are near."""
    few = met.filter(F.col("n") <= SMALL)
    pairs = merged(few.select("node", F.col("id").alias("a")), few.select("node", F.col("id").alias("b")), ["node"]).filter("a < b").select("a", "b").distinct()
    end = lambda c: sketches.select(F.col("id").alias(c), F.col("_sketch").alias(f"s{c}"))
    known = merged(merged(pairs, end("a"), ["a"]), end("b"), ["b"]).select("a", "b", _far("sa", "sb").cast("int").alias("far"))
    many = merged(met.filter(F.col("n") > SMALL), sketches.withColumnRenamed("_sketch", "sketch"), ["id"])
    blocks = _dealt(many, "node", F.ceil(F.col("n") / BLOCK), "sketch").groupBy("node", "i", "j")
    return known.filter(F.col("far") <= SKETCH_MOST).unionByName(blocks.applyInArrow(_block_ties, "a long, b long, far int"))


def candidate_ties(texts: DataFrame, scratch: Scratch, target: float = TARGET) -> DataFrame:
    """a, b: ties between texts (id, _sig, _sketch) that share a node and whose sketches are near.

    A round a depth, from whole labels up to :func:`shallowest`; each after the first looks at the nodes only that hold a text whose recall is short.
    """
    depths = range(DEEPEST, shallowest(target) - 1, -1)
    path = lambda t: F.struct(*[F.xxhash64(t, F.slice("_sig", t * DEEPEST + 1, F.lit(d))).alias(f"n{d}") for d in depths])
    leaves = texts.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), path)).alias("leaf"), "id").select("id", "leaf.*")
    # a leaf that is alone under its shortest prefix is alone under all
    top = f"n{depths[-1]}"
    common = scratch.keep(leaves.groupBy(top).agg(F.count("*").alias("n")).filter("n > 1").select(top))
    shared = scratch.keep(merged(leaves, common, [top], "left_semi"))
    sketches = texts.select("id", "_sketch")
    ties, done = None, None
    for d in depths:
        members = shared.select(F.col(f"n{d}").alias("node"), "id")
        if done is not None:
            short = merged(members, done, ["id"], "left_anti")
            members = merged(members, scratch.keep(short.select("node").distinct()), ["node"], "left_semi")
        sizes = scratch.keep(members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
        found = scratch.keep(_node_ties(scratch.keep(merged(members, sizes, ["node"])), sketches))
        ties = found if ties is None else ties.unionByName(found)
        linked = ties.filter(F.col("far").between(0, LINK_MOST)).select(F.explode(F.array("a", "b")).alias("id"), "far")
        # a text is done whose least similar link was met with the target recall
        done = scratch.keep(linked.groupBy("id").agg(F.max("far").alias("far")).filter(F.col("far") <= most_apart(d, target)).select("id"))
    return ties.filter("a != b").select("a", "b").distinct()


def class_of_rows(rows: DataFrame, scratch: Scratch, target: float = TARGET) -> DataFrame:
    """_row, class_node (the least _row of a text of the class), n_links for every row of :func:`signed_rows`."""
    narrow = rows.select("_row", "_print")
    prints = scratch.keep(narrow.groupBy("_print").agg(F.min("_row").alias("id"), F.count("*").alias("copies")))
    texts = scratch.keep(merged(rows.select(F.col("_row").alias("id"), "_n", "_sig", "_sketch").filter("_n > 0"), prints.select("id"), ["id"], "left_semi"))
    ties = candidate_ties(texts, scratch, target)
    grouped = connected_components(ties.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": "id", "component": "group"})
    sized = scratch.keep(merged(grouped, texts.select("id", "_n"), ["id"]))
    # one row a group, written before the join: a join of two plain tables can be dealt anew where a group is large
    totals = scratch.keep(sized.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / CELL_TEXTS), F.ceil(F.sum("_n") / CELL_SHINGLES)).alias("_cells")))
    members = scratch.keep(merged(sized, totals, ["group"]).select("group", "id", "_cells"))
    whole = merged(rows.select(F.col("_row").alias("id"), "_text"), members, ["id"])
    cells = _dealt(whole, "group", F.col("_cells"), "_text").groupBy("group", "i", "j")
    links = scratch.keep(cells.applyInArrow(_cell_links, "id long, root long, degree long"))
    classes = connected_components(links.select(F.col("id").alias("src"), F.col("root").alias("dst"))).withColumnsRenamed({"node": "id", "component": "class_node"})
    degrees = links.groupBy("id").agg(F.sum("degree").alias("degree")).join(classes, "id")
    per_text = merged(prints, degrees, ["id"], "left").select(
        "_print", F.coalesce("class_node", "id").alias("class_node"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).cast("long").alias("n_links")
    )
    return merged(narrow, per_text, ["_print"]).select("_row", "class_node", "n_links")


def near_classes(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs`` (doc_id, text; other columns are ignored).

    Two rows are linked if their texts are equal or their sets of word 5-shingles have a Jaccard similarity of 0.8 or more; classes
    are the components of the links, class_id is the least doc_id of a class, n_links counts the other rows of the same text
    plus the other texts linked to it. Null, empty and blank texts have no shingles: they are linked to their exact copies
    only (null and empty text are one). Rows of equal doc_id stay separate; a null doc_id is a class_id only where a class has no other.
    Pairs of two texts are found with the target recall over all links, and at least 0.94 at a similarity of 0.8 itself.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = signed_rows(docs.select("doc_id", "text"), scratch)
        found = scratch.keep(merged(rows.select("_row", "_doc.doc_id"), class_of_rows(rows, scratch, target), ["_row"]))
        least = scratch.keep(found.groupBy("class_node").agg(F.min("doc_id").alias("class_id")))
        return cut(merged(found, least, ["class_node"]).select("doc_id", "class_id", "n_links"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        doc = batch.column(0)
        names = [f.name for f in doc.type]
        yield pa.RecordBatch.from_arrays([*doc.flatten(), pa.array(map(unpack, batch.column(1).to_pylist()), pa.string())], [*names, "text"])


def keep_one(docs: DataFrame, scratch: Scratch, target: float = TARGET) -> DataFrame:
    """``docs`` with one row of each class of :func:`near_classes`: of the least doc_id (null last), then the first such row.

    Every column stays. The result reads a table in ``scratch``; write it before that is removed.
    """
    rows = signed_rows(docs, scratch)
    found = merged(rows.select("_row", "_doc.doc_id"), class_of_rows(rows, scratch, target), ["_row"])
    first = found.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("_first"))
    heads = scratch.keep(first.select("_first._row"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    kept = merged(rows.select("_row", "_doc", "_text"), heads, ["_row"], "left_semi").select("_doc", "_text")
    return kept.mapInArrow(_unpacked, f"{schema}, text string").select(*docs.columns)
