"""Tables that outlive a step: Parquet below the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a local session without one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
    return _OWN[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table; one that is gone already, or a session that has ended, is no error."""
    with contextlib.suppress(Exception):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Scratch tables of the steps that are under way, innermost last.
_STEPS: list[list[Scratch]] = []


@contextlib.contextmanager
def one_step() -> Iterator[None]:
    """A step whose result is written when it ends: all scratch tables that were made on the way go with it."""
    _STEPS.append([])
    try:
        yield
    finally:
        for made in _STEPS.pop():
            drop_path(made.spark, made.root)


class Scratch:
    """Written tables of one operator call. They last as long as the session or the step around them,
    because what is returned is lazy; ``drop`` frees those that only a finished part needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(drop_path, spark, self.root)
        if _STEPS:
            _STEPS[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        drop_path(self.spark, self.path(name))
