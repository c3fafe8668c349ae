"""Tables, cuts in the lineage, and texts that travel compressed."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefield.operators.lineage import Scratch, checkpoint_dir, cut

__all__ = ["Scratch", "bit_filter", "checkpoint_dir", "cut", "merged", "pack", "table", "unpack"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name in the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_pack = zstandard.ZstdCompressor(level=3).compress
_unpack = zstandard.ZstdDecompressor().decompress


def pack(text: str | None) -> bytes | None:
    """The UTF-8 of a text, compressed: about four tenths of it, where a shuffle's own codec leaves two thirds. Null stays null."""
    return None if text is None else _pack(text.encode("utf-8", "surrogatepass"))


def unpack(packed: bytes | None) -> str | None:
    """The inverse of :func:`pack`."""
    return None if packed is None else _unpack(packed).decode("utf-8", "surrogatepass")


def bit_filter(df: DataFrame, key: Column, bits: int) -> np.ndarray:
    """Bytes in which the bit ``key`` modulo ``bits`` (a power of two) is set for every row.

    Spark sets the bits; bits / 64 numbers at most come to the driver. A filter of rows that are shuffled later: where it
    fills up, more rows pass, and an exact join after the shuffle still decides.
    """
    bit = F.pmod(key, F.lit(bits))
    words = df.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 64 AS int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle and sort at every size, for sides that grow with the data: the plan doesn't change where one outgrows a broadcast."""
    return left.join(right.hint("merge"), on, how)
