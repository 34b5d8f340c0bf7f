"""Tables that cut the lineage of a plan, written where driver and executors both see them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership filter: 8 MB however many keys there are. A fuller filter lets more rows pass, never fewer.
FILTER_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and the session is local, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='loomframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


class Shared:
    """Written tables of one query; drop() removes those that its result no longer reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame, *by: str) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write
        if by:
            writer = writer.partitionBy(*by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def cut(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        _delete(self.spark, path)


def membership(keys: DataFrame, column: str):
    """A broadcast bit set that has each key's bit, ORed together on executors: a bounded filter before a join on the keys."""
    spark = keys.sparkSession
    # the 26 lowest bits of a hash: 20 of the word, 6 of the bit in it
    at = keys.filter(F.col(column).isNotNull()).select(F.col(column).bitwiseAND(FILTER_BITS - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[np.asarray(words["word"])] = np.asarray(words["bits"])
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64) & (FILTER_BITS - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
