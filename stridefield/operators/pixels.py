"""Images as pixel tables (image_id, row, col, value); every join has image_id, row and col as key, so a big image spreads."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridefield.operators.lineage import Scratch, cut

KEY = ["image_id", "row", "col"]
_FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
_EIGHT = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0))


def walkable(pixels: DataFrame, value: int = 255) -> DataFrame:
    """Pixels of one of the two values; any other value is an error."""
    known = F.when(F.col("value").isin(0, 255), F.col("value")).otherwise(F.raise_error(F.lit("a pixel is neither 0 nor 255")).cast("int"))
    return pixels.filter(known == value)


def binarize(pixels: DataFrame, threshold: int, invert: bool = False) -> DataFrame:
    """255 above the threshold and 0 elsewhere, or the other way round. No shuffle."""
    high, low = (0, 255) if invert else (255, 0)
    return pixels.withColumn("value", F.when(F.col("value") > threshold, high).otherwise(low))


def crop_to_content(pixels: DataFrame, margin: int = 10, dark: int = 240) -> DataFrame:
    """The box of dark pixels and a margin, counted from 0; an image without dark pixels has none. The boxes combine map-side."""
    content = pixels.filter(F.col("value") <= dark)
    box = content.groupBy("image_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))])
    box = box.select("image_id", *[F.greatest(F.col(f"lo_{c}") - margin, F.lit(0)).alias(f"lo_{c}") for c in ("row", "col")], *[(F.col(f"hi_{c}") + margin).alias(f"hi_{c}") for c in ("row", "col")])
    kept = pixels.join(box, "image_id").filter("row BETWEEN lo_row AND hi_row AND col BETWEEN lo_col AND hi_col")
    return kept.select("image_id", (F.col("row") - F.col("lo_row")).alias("row"), (F.col("col") - F.col("lo_col")).alias("col"), "value")


def downsample_max(pixels: DataFrame, f: int) -> DataFrame:
    """The greatest value of each f x f block; blocks that aren't whole are left out."""
    if f <= 1:
        return pixels
    block = pixels.groupBy("image_id", F.floor(F.col("row") / f).alias("row"), F.floor(F.col("col") / f).alias("col"))
    return block.agg(F.max("value").alias("value"), F.count("*").alias("_n")).filter(F.col("_n") == f * f).drop("_n")


def _around(offsets) -> Column:
    return F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in offsets]))


def dilate(pixels: DataFrame) -> DataFrame:
    """Greatest value of the 3 x 3 pixels around each; the semi-join clips to the image."""
    dealt = pixels.select("image_id", "value", _around([*_EIGHT, (0, 0)]).alias("p")).select("image_id", "p.row", "p.col", "value")
    return dealt.groupBy(*KEY).agg(F.max("value").alias("value")).join(pixels.select(*KEY), KEY, "left_semi")


def grid_graph(pixels: DataFrame, connectivity: int = 4, value: int = 255) -> DataFrame:
    """image_id, row, col, to_row, to_col, cost of neighbouring walkable pixels; corners may be cut. Costs 1, or the root of 2 across."""
    white = walkable(pixels, value).select(*KEY)
    dealt = white.select("image_id", "row", "col", _around(_FOUR if connectivity == 4 else _EIGHT).alias("p"))
    dealt = dealt.select("image_id", F.col("row").alias("from_row"), F.col("col").alias("from_col"), "p.row", "p.col")
    cost = F.when((F.col("row") != F.col("from_row")) & (F.col("col") != F.col("from_col")), F.sqrt(F.lit(2.0))).otherwise(1.0)
    return dealt.join(white, KEY).select("image_id", F.col("from_row").alias("row"), F.col("from_col").alias("col"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), cost.alias("cost"))


def relative_places(pixels: DataFrame) -> DataFrame:
    """pixels with rel_x = col / columns and rel_y = row / rows of their image, as a graph's nodes carry them."""
    size = pixels.groupBy("image_id").agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
    known = pixels.join(size, "image_id")
    return known.select(*pixels.columns, (F.col("col") / F.col("_cols")).alias("rel_x"), (F.col("row") / F.col("_rows")).alias("rel_y"))


def remove_small_components(pixels: DataFrame, k: int = 3, value: int = 255) -> DataFrame:
    """White 8-connected groups of at most k pixels turn to the other value.

    Every pixel with fewer than k neighbours grows a set by its members' neighbours and is dropped when the set has more than k: a group of
    at most k pixels is whole after k - 1 steps, and of a larger one the set has more after k. So k joins on the pixel decide it, over ever
    fewer pixels, whatever the size of the white regions.
    """
    if k < 1:
        return pixels.select(*KEY, "value")
    end = lambda r, c: F.struct("image_id", F.col(r).alias("row"), F.col(c).alias("col"))
    with Scratch(pixels.sparkSession) as scratch:
        near = grid_graph(pixels, 8, value).groupBy(end("row", "col").alias("p")).agg(F.collect_set(end("to_row", "to_col")).alias("near"))
        white = walkable(pixels, value).select(end("row", "col").alias("p")).join(near, "p", "left")
        few = scratch.keep(white.withColumn("near", F.coalesce("near", F.array().cast(near.schema["near"].dataType))).filter(F.size("near") < k))
        grown = few.select("p", F.array("p").alias("set"))
        for _ in range(k):
            # a member that has left the table has k neighbours or more, and so has too many for its set
            each = grown.select("p", F.explode("set").alias("m")).join(few.select(F.col("p").alias("m"), "near", F.lit(True).alias("_few")), "m", "left")
            wider = each.groupBy("p").agg(F.array_union(F.collect_set("m"), F.flatten(F.collect_list("near"))).alias("set"), F.count("*").alias("_all"), F.count("_few").alias("_known"))
            grown = scratch.keep(wider.filter((F.col("_all") == F.col("_known")) & (F.size("set") <= k)).select("p", F.array_distinct("set").alias("set")))
        small = grown.select("p.*", F.lit(True).alias("_small"))
        return cut(pixels.join(small, KEY, "left").select(*KEY, F.when(F.col("_small"), 255 - F.col("value")).otherwise(F.col("value")).alias("value")))


def erase_boxes(pixels: DataFrame, detections: DataFrame, fill: int = 255) -> DataFrame:
    """Pixels under a box (x, y, w, h; x is the first column) take ``fill``. Boxes become cells, so the join has an exact key."""
    until = lambda a, n: F.explode(F.sequence(F.col(a), F.col(a) + F.col(n) - 1))
    cells = detections.filter("w > 0 AND h > 0").withColumn("row", until("y", "h")).withColumn("col", until("x", "w")).select(*KEY).distinct()
    return pixels.join(cells.withColumn("_hit", F.lit(True)), KEY, "left").select(*KEY, F.when(F.col("_hit"), fill).otherwise(F.col("value")).alias("value"))


def remove_detections(pixels: DataFrame, detections: DataFrame) -> DataFrame:
    """Pixels under the kept detections set to 0, then every pixel inverted (255 - value).

    detections: image_id, x, y (upper left corner), w, h, scale; a box is the whole part of w * scale by that of h * scale, cut to the image.
    """
    scaled = detections.select("image_id", "x", "y", *[(F.col(c) * F.col("scale")).cast("int").alias(c) for c in "wh"])
    return erase_boxes(pixels, scaled, 0).withColumn("value", 255 - F.col("value"))


def best_scale(detections: DataFrame) -> DataFrame:
    """image_id, scale, mean_score of the scale of the greatest mean, the smallest on ties; images with none above 0 are left out."""
    means = detections.groupBy("image_id", "scale").agg(F.avg("score").alias("mean_score")).filter("mean_score > 0")
    best = means.groupBy("image_id").agg(F.max(F.struct("mean_score", (-F.col("scale")).alias("n"))).alias("b"))
    return best.select("image_id", (-F.col("b.n")).alias("scale"), "b.mean_score")


#: Sides of a tile of suppression, in distances.
TILE_DISTANCES = 16


def _decided(distance: float):
    """Rows by tile and falling score: each tile's own undecided rows that stay (kept) or that wait for a row of a neighbouring tile (open).

    What is remembered of a tile is its kept places, which are farther apart than the distance, and the places of open rows.
    """
    reach = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]

    def near(places: dict, x: float, y: float, a: int, b: int) -> bool:
        return any(math.hypot(x - u, y - v) <= distance for i, j in reach for u, v in places.get((a + i, b + j), ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, kept, waiting = None, {}, {}
        for batch in batches:
            said: list[tuple[int, bool]] = []
            columns = [batch.column(c).to_pylist() for c in ("image_id", "_tx", "_ty", "_x", "_y", "_own", "_kept")]
            for k, (image, tx, ty, x, y, own, known) in enumerate(zip(*columns, strict=True)):
                if (image, tx, ty) != tile:
                    tile, kept, waiting = (image, tx, ty), {}, {}
                a, b = math.floor(x / distance), math.floor(y / distance)
                if known:
                    kept.setdefault((a, b), set()).add((x, y))
                elif near(kept, x, y, a, b):
                    continue  # a stronger one stays, so this one goes, in whichever tile it is
                elif not own or near(waiting, x, y, a, b):
                    waiting.setdefault((a, b), set()).add((x, y))
                    if own:
                        said.append((k, False))
                else:
                    kept.setdefault((a, b), set()).add((x, y))
                    said.append((k, True))
            if said:
                rows = batch.select(["image_id", "det_id", "_x", "_y", "score"]).take(pa.array([k for k, _ in said]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([stays for _, stays in said])], [*rows.schema.names, "_kept"])

    return run


#: Detections of an image that is decided as a whole, rows that are decided together, and pairs of near cells' rows that are held at once.
WHOLE_IMAGE, TOGETHER_ROWS, TOGETHER_PAIRS = 100_000, 20_000, 4_000_000


def _pairs(image: np.ndarray, x: np.ndarray, y: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows (i, j), i < j, of one image within ``distance``, found by cells of that side; None if more than ``TOGETHER_PAIRS`` would be looked at."""
    a, b = np.floor(x / distance), np.floor(y / distance)
    a, b = (a - a.min() + 1).astype(np.int64), (b - b.min() + 1).astype(np.int64)
    wide, high = int(a.max()) + 2, int(b.max()) + 2
    if (int(image[-1]) + 1) * wide * high >= 1 << 62:
        return None
    cell = (image * wide + a) * high + b
    order = np.argsort(cell, kind="stable")
    ordered, spans, total = cell[order], [], 0
    for i in (-1, 0, 1):
        # the cells above, at and below a row lie together
        low, past = np.searchsorted(ordered, cell + i * high - 1), np.searchsorted(ordered, cell + i * high + 1, "right")
        spans.append((low, past - low))
        total += int((past - low).sum())
    if total > TOGETHER_PAIRS:
        return None
    first, second = [], []
    for low, n in spans:
        j = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        i = np.repeat(np.arange(len(x)), n)
        i, j = i[i < j], j[i < j]
        away = np.hypot(x[i] - x[j], y[i] - y[j])
        near = away <= distance
        for k in np.flatnonzero(np.abs(away - distance) <= 1e-9 * distance).tolist():
            near[k] = math.hypot(x[i[k]] - x[j[k]], y[i[k]] - y[j[k]]) <= distance
        first.append(i[near])
        second.append(j[near])
    return np.concatenate(first), np.concatenate(second)


def _stays(image: np.ndarray, x: np.ndarray, y: np.ndarray, distance: float) -> np.ndarray | None:
    """Which rows of whole images, each by falling strength, no kept stronger one is near; None where there are too many pairs."""
    if not (np.isfinite(x).all() and np.isfinite(y).all()) or (pairs := _pairs(image, x, y, distance)) is None:
        return None
    (i, j), gone, stays = pairs, np.zeros(len(x), bool), np.zeros(len(x), bool)
    while len(i):
        # a row without a stronger one that may yet stay is kept, and its weaker ones go
        waits = np.zeros(len(x), bool)
        waits[j] = True
        stays |= ~waits & ~gone
        gone[j[stays[i]]] = True
        left = ~gone[i] & ~gone[j]
        i, j = i[left], j[left]
    return ~gone


def _decided_whole(distance: float):
    """Rows by image and falling score: those that stay. Images are taken together up to ``TOGETHER_ROWS`` rows; one with too many pairs is streamed by :func:`_decided`."""
    names = ["image_id", "det_id", "_x", "_y", "score"]
    stream = _decided(distance)

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        image = rows.column("image_id").combine_chunks()
        change = np.flatnonzero(np.asarray(pc.not_equal(image[1:], image[:-1]))) + 1
        number = np.zeros(len(image), np.int64)
        number[change] = 1
        number = np.cumsum(number)
        stays = _stays(number, rows.column("_x").to_numpy(), rows.column("_y").to_numpy(), distance)
        if stays is None and len(change):
            for low, high in zip([0, *change.tolist()], [*change.tolist(), len(image)], strict=True):
                yield from made(rows.slice(low, high - low))
        elif stays is None:
            for name, value in (("_tx", 0), ("_ty", 0), ("_own", True)):
                rows = rows.append_column(name, pa.array([value] * len(rows)))
            yield from stream(iter(rows.combine_chunks().to_batches()))
        else:
            out = rows.select(names).filter(pa.array(stays)).append_column("_kept", pa.array([True] * int(stays.sum())))
            yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER_ROWS:
                rows = pa.Table.from_batches(held)
                image = rows.column("image_id").combine_chunks()
                change = np.flatnonzero(np.asarray(pc.not_equal(image[1:], image[:-1])))
                whole = int(change[-1]) + 1 if len(change) else 0
                if whole:
                    yield from made(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield from made(pa.Table.from_batches(held))

    return run


def nms(detections: DataFrame, distance: float = 10) -> DataFrame:
    """Greedy suppression by falling score (det_id on ties): a detection stays if no stronger kept one lies within ``distance``.

    An image of up to ``WHOLE_IMAGE`` detections stands in one task and is decided there at once. Detections of larger ones are dealt to tiles of ``TILE_DISTANCES`` distances a side, those near a side to the neighbours too, and are
    read by falling score, so a tile decides in one pass all but those that wait for a neighbour's; a round goes on with these and
    the kept ones of their tiles. The strongest undecided one waits for none, so rounds end; they follow chains across tiles only. A tile's rows
    are sorted and streamed, never held. One shuffle by tile a round, and one count to the driver.
    """
    with Scratch(detections.sparkSession) as scratch:
        middle = lambda c, n: (F.col(c) + F.floor(F.col(n) / 2)).cast("double")
        key, side = ["image_id", "_tx", "_ty"], F.lit(float(distance * TILE_DISTANCES))
        known = detections.filter("image_id IS NOT NULL AND det_id IS NOT NULL AND score IS NOT NULL")
        rows = known.select("image_id", "det_id", middle("x", "w").alias("_x"), middle("y", "h").alias("_y"), "score", F.lit(False).alias("_kept"))
        rows = scratch.keep(rows.filter("_x IS NOT NULL AND _y IS NOT NULL"))
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - distance) / side), F.floor((F.col(c) + distance) / side)))
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        large = scratch.keep(rows.groupBy("image_id").count().filter(F.col("count") > WHOLE_IMAGE).select("image_id"))
        # few: each has more than WHOLE_IMAGE rows
        small = rows.join(F.broadcast(large), "image_id", "left_anti").repartition("image_id").sortWithinPartitions("image_id", F.desc("score"), "det_id")
        kept = scratch.keep(small.mapInArrow(_decided_whole(distance), shape))
        if large.isEmpty():
            return cut(detections.join(kept.select("image_id", "det_id").distinct(), ["image_id", "det_id"], "left_semi"))
        whole, kept = kept, None
        todo = rows.join(F.broadcast(large), "image_id", "left_semi").select(*rows.columns)
        while True:
            dealt = todo.withColumn("_tx", span("_x")).withColumn("_ty", span("_y"))
            own = (F.col("_tx") == F.floor(F.col("_x") / side)) & (F.col("_ty") == F.floor(F.col("_y") / side))
            ordered = dealt.withColumn("_own", own).repartition(*key).sortWithinPartitions(*key, F.desc("score"), "det_id")
            made = scratch.keep(ordered.mapInArrow(_decided(distance), shape))
            stays = made.filter("_kept")
            kept = stays if kept is None else scratch.keep(kept.unionByName(stays))
            left = made.filter("NOT _kept")
            if left.isEmpty():
                kept = kept.unionByName(whole)
                return cut(detections.join(kept.select("image_id", "det_id").distinct(), ["image_id", "det_id"], "left_semi"))
            tiles = left.withColumn("_tx", span("_x")).withColumn("_ty", span("_y")).select(*key).distinct()
            around = kept.withColumn("_tx", span("_x")).withColumn("_ty", span("_y")).join(tiles, key, "left_semi").select(*rows.columns).distinct()
            todo = scratch.keep(left.unionByName(around))


