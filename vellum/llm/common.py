"""What the operators share: the scratch folder, bucket counts, Arrow helpers."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_made: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a temporary one in local mode; on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession, *, since: int = 0) -> None:
    """Deletes the scratch tables that this session has made, but for the first ``since``; results that still read them must be written before."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = _made.get(spark, [])
    for path in paths[since:]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del paths[since:]


def scratch_tables(spark: SparkSession) -> int:
    """How many there are: what clean_up() takes as since, to delete only what comes after."""
    return len(_made.get(spark, []))


def bucket_count(spark: SparkSession, per_partition: int = 4) -> int:
    """Buckets that split hot groups: some for each shuffle partition, so the cluster's own setting scales them."""
    return max(64, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def read_bytes(path: str) -> bytes:
    """A model or vocabulary file of the driver; callers ship the bytes to executors, which need no copy of the file."""
    with open(path, "rb") as f:
        return f.read()
