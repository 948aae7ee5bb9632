"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes the shuffle files of a query as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local master gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sentrel-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_watching: list[list[Scratch]] = []


@contextmanager
def scratch_made() -> Iterator[list[Scratch]]:
    """Collects the Scratch objects that are made inside the block, so that their tables can go once a result is stored."""
    made: list[Scratch] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.remove(made)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/sentrel-{uuid.uuid4().hex}"
        self.paths: set[str] = set()
        for made in _watching:
            made.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table. The shuffle files that it took go with the query, as what comes after reads the table."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with settings(self.spark, {CLEANUP: "true"}):
            df.write.parquet(path)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sentrel_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        self._delete({df._sentrel_path for df in frames} & self.paths)

    def keep(self, *frames: DataFrame) -> None:
        """Deletes all tables of this scratch but these: those that a result still reads."""
        self._delete(self.paths - {df._sentrel_path for df in frames})

    def _delete(self, names: set[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        self.paths = self.paths - names
