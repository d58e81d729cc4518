"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` behind a reliable checkpoint, so that later jobs neither redo it nor depend on one executor.

    The folder is the cluster's `spark.checkpoint.dir`. Where none is set, a temporary one will do for a single machine;
    a cluster's executors would not see it, so there it is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


class Written:
    """A table that rounds of a loop replace: Parquet in the shared folder.

    What checkpoint() returns keeps the size that Spark estimated for it, a product of the sizes of all tables joined.
    In a loop that estimate can be a power of itself each round. A table that is read again has its true size.
    """

    def __init__(self):
        self.folder = None

    def replace(self, df: DataFrame) -> DataFrame:
        """`df`, written and read again; what was written before is deleted."""
        spark, last = df.sparkSession, self.folder
        self.folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        df.write.parquet(self.folder)
        if last:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return spark.read.schema(df.schema).parquet(self.folder)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", most: int = 50_000, most_bytes: int = 16 << 20) -> DataFrame:
    """Join that broadcasts `small` only if it was found to have at most `most` rows and `most_bytes`; else a shuffled join.

    `small` should be cheap to count (a checkpoint or an aggregate of one). Bytes are counted from the values of columns
    of variable size, and 8 for each other one.
    """
    fixed = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")
    sizes = [F.octet_length(c) if kind in ("string", "binary") else F.length(F.to_json(F.struct(c))) for c, kind in small.dtypes if kind not in fixed]
    size = F.lit(8 * len(small.columns)) + sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0))
    rows, total = small.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    few = rows <= most and (total or 0) <= most_bytes
    return big.join(F.broadcast(small) if few else small, on, how)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files and checkpoints of rounds whose frames are gone; it works on garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
