"""The shared folder of a job, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is what `spark.checkpoint.dir` names. Only a local session may go without:
    then one temporary folder is made for the process.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="roaskit-"))
    return _local_root[0]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/roaskit/{label}-{uuid.uuid4().hex}"


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that readers see whole, old or new: written under a draft name, then renamed over the old one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    draft = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, kinds)


def read_text(spark: SparkSession, path: str) -> str | None:
    """What `replace_text` wrote, or None where there is no such file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where several branches of a plan need the same reduced table: the raw
    facts are scanned once, a lost executor costs a re-read and not a re-run, and
    the Parquet footers give the planner true sizes for its broadcast decisions.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
