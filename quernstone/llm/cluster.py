"""What the operators need from the cluster: a shared folder and cut lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.workers import importable


CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) is a
    folder of this machine made and used; a cluster without a shared folder is
    refused.  Checkpoints nobody refers to are deleted unless the session says
    otherwise.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.conf().contains(CLEAN):
        jsc.conf().set(CLEAN, "true")
    if named:
        if not jsc.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not jsc.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return jsc.getCheckpointDir().get()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it from there.

    A reliable checkpoint survives lost executors and is deleted when nothing
    refers to it any more.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names, whatever else there is."""
    importable(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed c0, c1 ... so that no name can clash, and the new name of each."""
    importable(docs.sparkSession)
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def named_again(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that :func:`numbered` renamed, under their own names."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))
