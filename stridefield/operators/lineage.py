"""Where lineage is cut: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named, a local session (tests) gets a temporary one; any other is refused."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stridefield-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and go on from there. For loops take :class:`Scratch`."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables of one job in a folder of their own below the checkpoint folder; on leaving the block they are removed.

    A checkpoint keeps the size estimate of the plan it came from, and joins multiply estimates, so after some twenty rounds
    of joining a checkpoint with itself the driver multiplies numbers of thousands of digits. A table has its true size.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.names: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back."""
        self.n += 1
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def keep_bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """``df`` written in buckets of ``column`` and read back: joins and groups by the column find its rows in place, without a shuffle.

        Tasks write their rows to the files of their buckets, so nothing is shuffled here either. The files are in this folder; the
        table's name in the session's catalog goes with them.
        """
        self.n += 1
        name = f"stridefield_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", f"{self.folder}/{self.n}").bucketBy(buckets, column).format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def remove(self, n: int | None = None) -> None:
        """Remove the n-th table, or all."""
        if n is None:
            while self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop()}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder if n is None else f"{self.folder}/{n}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
